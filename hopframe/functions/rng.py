"""Random columns that depend only on (seed, stream, keys), never on partitioning.

``rand(seed)`` changes when the data is split differently or a task is retried on
another partition; a hash of the row's own key does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO53 = float(1 << 53)
TWO52 = float(1 << 52)


def hash_bits(seed: int, stream: str, *keys: Column, algo: str = "xxhash64") -> Column:
    """Non-negative hash: 63 bits with xxhash64, 52 bits with md5.

    md5 is slower but other SQL engines have it, so results can be recomputed elsewhere.
    """
    if algo == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 1)


def uniform(seed: int, stream: str, *keys: Column, algo: str = "xxhash64") -> Column:
    """Uniform double in [0, 1)."""
    bits = hash_bits(seed, stream, *keys, algo=algo)
    if algo == "md5":
        return bits.cast("double") / F.lit(TWO52)
    return F.shiftrightunsigned(bits, 10).cast("double") / F.lit(TWO53)


def int_between(u: Column, low, high) -> Column:
    """Integer in [low, high] from a uniform in [0, 1)."""
    low_c = low if isinstance(low, Column) else F.lit(low)
    high_c = high if isinstance(high, Column) else F.lit(high)
    width = (high_c - low_c + F.lit(1)).cast("double")
    return low_c.cast("bigint") + F.floor(u * width).cast("bigint")


def long_between(seed: int, stream: str, low: int, high: int, *keys: Column, algo: str = "xxhash64") -> Column:
    """Long in [low, high], any range up to all 64 bits: a 64-bit hash modulo the width, in exact decimals."""
    width = high - low + 1
    if width <= 0:
        raise ValueError(f"empty range {low}..{high}")

    def exact(value) -> Column:
        return (value if isinstance(value, Column) else F.lit(str(value))).cast("decimal(38,0)")

    if algo == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
        bits = exact(F.conv(F.substring(F.md5(text), 1, 16), 16, 10))
    else:
        bits = exact(F.xxhash64(F.lit(seed), F.lit(stream), *keys)) + exact(1 << 63)
    return (exact(low) + bits % exact(width)).cast("bigint")


def pick(values: list, u: Column) -> Column:
    """One element of a literal list."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * F.lit(float(len(values)))) + 1).cast("int"))


def standard_normal(u1: Column, u2: Column) -> Column:
    """Box–Muller; ``1 - u1`` keeps the logarithm finite."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
