"""Word shingles of Arrow text columns, hashed with numpy over whole batches.

Words are runs of ASCII letters and digits (A-Z as a-z) and of any bytes beyond ASCII. Hashes are polynomials modulo
2^64 over bytes, words and shingles, taken from running sums, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
BYTE_BASE, TEXT_BASES, SHINGLE_BASE = 0x100000001B3, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
FOLD = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, size: int) -> None:
        if size > len(self.up):
            size = max(1 << 18, 1 << (size - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def ranges(self, values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Polynomial hash of values[start:stop] for every range."""
        self.grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:len(values)], out=sums[1:])
        return (sums[stops] - sums[starts]) * self.down[starts]


BYTES, TEXTS = Powers(BYTE_BASE), tuple(Powers(b) for b in TEXT_BASES)


def slices(column: pa.Array, most_bytes=1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of parts of a string column, cut by size; no part is split inside a row."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
        at = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where the words of each text begin (one more entry than texts)."""
    folded = FOLD[data]
    inside = folded != 0
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[(ends > 0)] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = mix(BYTES.ranges(folded, starts, stops) + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def text_keys(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128-bit key of the word sequence of every text; None for a text without words."""
    halves = [mix(p.ranges(hashes, bounds[:-1], bounds[1:]) + np.diff(bounds).astype(np.uint64)) for p in TEXTS]
    both = np.column_stack(halves).astype(">u8").tobytes()
    filled = bounds[1:] > bounds[:-1]
    return [both[16 * i:16 * i + 16] if filled[i] else None for i in range(len(filled))]


def shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times), sorted by text and shingle; a text of fewer than SIZE words is one shingle."""
    counts = np.diff(bounds)
    text_of = np.repeat(np.arange(len(counts)), counts)
    powers = [np.uint64(pow(SHINGLE_BASE, k + 1, 1 << 64)) for k in range(SIZE)]
    texts, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = len(hashes) - SIZE + 1
    if n > 0:
        whole = text_of[:n] == text_of[SIZE - 1:]
        rolled = np.zeros(n, dtype=np.uint64)
        for k, power in enumerate(powers):
            rolled += hashes[k:k + n] * power
        texts, found = text_of[:n][whole], mix(rolled[whole])
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        single = [sum(int(h) * int(powers[k]) for k, h in enumerate(hashes[bounds[i]:bounds[i + 1]])) + int(counts[i])
                  for i in short]
        texts = np.concatenate((texts, short))
        found = np.concatenate((found, mix(np.array([x & (1 << 64) - 1 for x in single], dtype=np.uint64))))
    order = np.lexsort((found, texts))
    texts, found = texts[order], found[order]
    fresh = np.ones(len(texts), dtype=bool)
    fresh[1:] = (texts[1:] != texts[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(fresh)
    return texts[at], found[at], np.diff(np.append(at, len(texts)))
