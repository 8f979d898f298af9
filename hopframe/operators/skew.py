"""Supernodes: finding them and joining through them without one giant task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hot keys that are broadcast at most: some megabytes of ids.
MARKS = 100_000
# Tasks per core where rows are spread evenly; more of them cost more to start than they even out.
WAVES = 4


def supernodes(edges: DataFrame, threshold: int, end: str = "src") -> DataFrame:
    """Vertices with at least ``threshold`` edges at ``end``: ``id, degree``.

    At most |E| / threshold rows, so the result stays small for a sensible threshold.
    """
    return (edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
            .filter(F.col("degree") >= threshold))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows by hash of ``keys`` in ``spark.sql.shuffle.partitions`` tasks, or without keys evenly in ``WAVES``
    tasks per core.

    The runtime merges small shuffle partitions by their compressed bytes. Rows that are few and cheap to store but dear
    to work on, such as numbers that grow into many edges or paths that are sorted, would end up in a handful of tasks;
    a stated number of partitions is left alone.
    """
    spark = df.sparkSession
    if keys:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    return df.repartition(WAVES * spark.sparkContext.defaultParallelism)


def splittable(aggregated: DataFrame) -> DataFrame:
    """The same rows behind an exchange of their own.

    A join reuses the partitioning of an aggregate on its key, and then the runtime cannot split a hot key on the other
    side, since that needs plain shuffles on both. One row per key is cheap to move once more.
    """
    return aggregated.hint("rebalance")


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                spread_by: str, hot: DataFrame, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join where the ``hot`` keys (``id``, one row each) of ``right`` are cut into ``salts`` slices.

    Rows of ``right`` at a hot key get a slice number from a hash of ``spread_by``; rows
    of ``left`` at a hot key are copied once per slice. Every pair meets exactly once, so
    the result equals the plain join. Other keys keep one slice and no copies.

    The rows are marked by a list of the hot keys. Its length is checked: up to ``MARKS`` ids are broadcast, so no row
    is shuffled by a hot key before it has its slice. A longer list comes from a threshold so low that no key is large
    in comparison; it is joined by shuffle.
    """
    listed = hot.select(F.col("id").alias("_hot"))
    if listed.limit(MARKS + 1).count() <= MARKS:
        listed = F.broadcast(listed)

    def marked(df: DataFrame, key: str) -> DataFrame:
        return df.join(listed, df[key] == F.col("_hot"), "left")

    slices = F.sequence(F.lit(0), F.lit(salts - 1))
    lhs = (marked(left, left_key)
           .withColumn("_ls", F.explode(F.when(F.col("_hot").isNotNull(), slices).otherwise(F.array(F.lit(0)))))
           .drop("_hot"))
    rhs = (marked(right, right_key)
           .withColumn("_rs", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
                       .otherwise(F.lit(0)))
           .drop("_hot"))
    cond = (F.col(left_key) == F.col(right_key)) & (F.col("_ls") == F.col("_rs"))
    return lhs.join(rhs, cond, how).drop("_ls", "_rs")


def split_copies(counted: DataFrame, count_col: str, index_col: str,
                 chunk: int = 1 << 16) -> DataFrame:
    """Turn ``rows + count`` back into ``count`` numbered copies (1..count).

    A row with more than ``chunk`` copies is first cut into chunks that are spread over
    the cluster, so no task expands an unbounded number of copies.
    """
    cols = [c for c in counted.columns if c != count_col]
    c = F.col(count_col)
    few = (counted.filter(c <= chunk)
           .select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), c)).alias(index_col)))
    many = (counted.filter(c > chunk)
            .select(*cols, count_col,
                    F.explode(F.sequence(F.lit(0).cast("bigint"),
                                         F.floor((c - 1) / chunk).cast("bigint"))).alias("_chunk"))
            .repartition(F.col("_chunk"), *[F.col(x) for x in cols])
            .select(*cols, F.explode(F.sequence(
                F.col("_chunk") * chunk + 1,
                F.least(c, (F.col("_chunk") + 1) * chunk))).alias(index_col)))
    return few.unionByName(many)


def first_per(df: DataFrame, key: str, order: list[Column], k: int, spread_by: str, rank: str = "_rn",
              slices: int = 64) -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1 in ``rank``.

    Up to a threshold Spark drops the rest before the shuffle; beyond it, the rows of a key are first ranked in
    ``slices`` by a hash of ``spread_by``, so that a key with very many rows is no single task. Both give the same rows.
    """
    at_once = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > at_once:
        part = Window.partitionBy(key, "_slice").orderBy(*order)
        df = (df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)))
              .withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= k).drop("_slice", "_part"))
    whole = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)
