"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format) and rebuilt as a tokenizer: normaliser, metaspace marker, unigram
scores or BPE merges, byte fallback. Whole texts are encoded in multithreaded batches; every text is decoded again and
compared, and every text is also encoded by the sentencepiece library and the ids compared. A caller may restrict that
last check to one text in ``parity_every`` (by its checksum).

Null texts count as empty; empty texts have no tokens. Repeated rows get the same result each. Other columns are not
looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers

from hopframe.llm.common import map_texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the file format
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of a protobuf message; sub-messages and strings as bytes, fixed32 as float."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at:at + 4])[0], at + 4
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        else:
            raise ValueError(f"field type {kind} is not in a model file")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with the marker in front are supported")
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""),
                   bool(normal.get(3, 1)), bool(normal.get(4, 1)))

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def normalizer(self) -> normalizers.Sequence:
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def merges(self) -> list[tuple[str, str]]:
        """All ways to join two pieces to a third, best third first (merge order is the order of scores)."""
        known = {piece: i for i, (piece, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, i in known.items():
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((-self.pieces[i][1], i, left, right, piece[:cut], piece[cut:]))
        return [x[4:] for x in sorted(found)]

    def tokenizer(self, normalize=True) -> Tokenizer:
        unknown = self.pieces[self.unknown][0]
        if self.kind == BPE:
            vocabulary = {piece: i for i, (piece, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocabulary, self.merges(), unk_token=unknown, fuse_unk=True,
                              byte_fallback=self.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        made = Tokenizer(core)
        if normalize:
            made.normalizer = self.normalizer()
        return made


class Codec:
    """Encoder and decoder of a model file."""

    def __init__(self, data: bytes, threads: int = 2):
        # Read by the library's thread pool when it starts; Spark runs one such process per task slot.
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = Model.parse(data)
        self.normal = self.model.normalizer()
        self.plain = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        self.raw = self.model.tokenizer(normalize=False)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = [self._bytes(piece, kind) for piece, _, kind in self.model.pieces]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.encode()

    def normalize(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.normal.normalize_str(text) if text else ""

    def encode(self, texts: list[str]) -> list[list[int]]:
        normal = [self.normalize(t) for t in texts]
        return [made.ids for made in self.raw.encode_batch_fast(normal, add_special_tokens=False)]

    def parity(self, text: str, ids: list[int], every: int) -> bool | None:
        """Whether the sentencepiece library gives the same ids; None for texts that are not picked."""
        if every > 1 and zlib.crc32(text.encode()) % every:
            return None
        return self.check.encode(text) == ids

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def expected(self, text: str) -> str:
        """What decoding the ids of a text gives: the normalised text without markers."""
        text = self.normalize(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _codec(data: bytes) -> Codec:
    """One codec per worker process and model."""
    key = hash(data)
    if _CODECS.get("key") != key:
        _CODECS.update(key=key, codec=Codec(data))
    return _CODECS["codec"]


_CODECS: dict = {}


def load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, id_col="doc_id", text_col="text", keep=(), parity_every=1) -> DataFrame:
    """``id_col``, the columns in ``keep``, n_tokens, ids, round_trip (decoding gives the normalised text back) and
    parity (the sentencepiece library gives the same ids; null only for texts that a ``parity_every`` above 1 leaves out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, some hundred kB

    def compute(texts: list[str | None]) -> dict:
        codec = _codec(shared.value)
        texts = [text or "" for text in texts]
        ids = codec.encode(texts)
        offsets = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([np.array(x, dtype=np.int32) for x in ids])
        return {"n_tokens": np.diff(offsets),
                "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                "round_trip": [codec.decode(x) == codec.expected(text) for x, text in zip(ids, texts)],
                "parity": [codec.parity(text, x, parity_every) for x, text in zip(ids, texts)]}

    names = [id_col, *[c for c in keep if c not in (id_col, text_col)]]
    return map_texts(docs.select(*names, text_col), text_col,
                     "n_tokens long, ids array<int>, round_trip boolean, parity boolean", compute,
                     keep_text=text_col in keep)


def decode(encoded: DataFrame, model: bytes, id_col="doc_id", ids_col="ids") -> DataFrame:
    """``id_col`` and text from ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def compute(lists: list) -> dict:
        codec = _codec(shared.value)
        return {"text": [None if ids is None else codec.decode(ids) for ids in lists]}

    return map_texts(encoded.select(id_col, F.col(ids_col).alias("_ids")), "_ids", "text string", compute)
