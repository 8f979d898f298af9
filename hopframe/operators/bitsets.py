"""Sets of values as bitmaps that are merged like sums.

Values are numbered, frequent ones first, and a set becomes a few rows ``key, page, w0 .. w15``: one row per page of
1024 numbers, one bit per value. A union is a ``bit_or`` per word, which Spark combines map-side, so a set carried over
an edge costs its pages and not its members, and a hub with thousands of values does not multiply the rows of everybody
who reaches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.operators.skew import splittable

WORDS = [f"w{k}" for k in range(16)]
BITS = 64
PAGE = BITS * len(WORDS)
# Values are numbered in parallel in so many groups; number = rank in the group * GROUPS + group.
GROUPS = 64


def numbered(values: DataFrame, value: str) -> DataFrame:
    """``value, number`` for every distinct value but NULL; the more frequent, the smaller."""
    counted = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_times"))
    group = F.pmod(F.xxhash64(value), F.lit(GROUPS))
    order = Window.partitionBy("_group").orderBy(F.col("_times").desc(), value)
    return (counted.withColumn("_group", group)
            .select(F.col(value).alias("value"),
                    ((F.row_number().over(order) - 1) * GROUPS + F.col("_group")).cast("bigint").alias("number")))


def _merged(rows: DataFrame, words: list) -> DataFrame:
    return rows.groupBy("key", "page").agg(*words)


def build(members: DataFrame, key: str, value: str, numbers: DataFrame) -> DataFrame:
    """``key, page, w0 ..``: the set of values of every key."""
    n, bit = F.col("number"), F.expr(f"shiftleft(1L, CAST(number % {BITS} AS int))")
    rows = (members.select(F.col(key).alias("key"), F.col(value).alias("_v"))
            .join(splittable(numbers), F.col("_v") == F.col("value"))
            .select("key", F.floor(n / PAGE).alias("page"), F.floor(n % PAGE / BITS).alias("_w"), bit.alias("_bit")))
    zero = F.lit(0).cast("bigint")
    return _merged(rows, [F.coalesce(F.bit_or(F.when(F.col("_w") == k, F.col("_bit"))), zero).alias(w)
                          for k, w in enumerate(WORDS)])


def pull(links: DataFrame, near: str, far: str, sets: DataFrame) -> DataFrame:
    """The union, per ``near``, of the sets of all its ``far`` ends."""
    v = splittable(sets.withColumnRenamed("key", "_far"))
    rows = (links.select(F.col(near).alias("key"), F.col(far).alias("_link"))
            .join(v, F.col("_link") == F.col("_far")).select("key", "page", *WORDS))
    return _merged(rows, [F.bit_or(w).alias(w) for w in WORDS])


def sizes(sets: DataFrame) -> DataFrame:
    """``key, n``: members of every set that has any."""
    return sets.groupBy("key").agg(F.sum(sum(F.bit_count(w) for w in WORDS)).cast("bigint").alias("n"))


def members(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """``key, value``, one row per member."""
    word = F.posexplode(F.array(*WORDS)).alias("_w", "_bits")
    bits = F.expr(f"""filter(sequence(0, {BITS - 1}), b -> (shiftright(_bits, b) & 1L) = 1L)""")
    rows = (sets.select("key", "page", word).filter("_bits <> 0")
            .select("key", "page", "_w", F.explode(bits).alias("_b"))
            .select("key", (F.col("page") * PAGE + F.col("_w") * BITS + F.col("_b")).alias("_n")))
    return rows.join(splittable(numbers), F.col("_n") == F.col("number")).select("key", "value")
