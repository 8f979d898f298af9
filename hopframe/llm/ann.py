"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of vectors. Every vector is represented by its ranking of the pivots, nearest first, and
posted in the inverted files of its nearest pivots. A query walks the files of its own nearest pivots, the rows found
are ranked by the footrule distance of the (truncated) rankings, and the best share is compared exactly.

The index is dealt into shards by hash; every shard has its own inverted files, and every query visits every shard, in
blocks of queries. A share of each shard is reranked, not a fixed number, so recall does not fall as data grows. More
than k + 1 copies of a vector cannot all be among the k nearest of anything, so only the k + 1 smallest ids of equal
vectors are indexed; this is exact and keeps a hot vector from filling a shard.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, neither
do rows without an id. Ties go to the smaller id. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import sample_rows


def usable(table: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")) \
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0)) \
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) \
        .where(F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def choose_pivots(rows: DataFrame, pivots: int, seed=3) -> np.ndarray:
    """Distinct vectors of the rows with the smallest hash of their id; at most ``pivots`` rows reach the driver."""
    found = sample_rows(rows, "vec_id", seed, pivots).collect()
    if not found:
        return np.zeros((0, 0))
    return np.unique(np.array([r["v"] for r in found], dtype=np.float64), axis=0)


def rankings(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector: pivots nearest first, and the rank of every pivot."""
    far = (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * vectors @ pivots.T
    order = np.argsort(far, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return order, ranks


class Shard:
    """Inverted files over the rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, posted: int, length: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        order, ranks = rankings(self.vectors, pivots)
        self.ranks = np.minimum(ranks, length).astype(np.int16)
        rows = np.repeat(np.arange(len(ids)), min(posted, order.shape[1]))
        keys = order[:, :posted].ravel()
        sort = np.argsort(keys, kind="stable")
        ends = np.searchsorted(keys[sort], np.arange(len(pivots) + 1))
        self.files = [rows[sort[ends[p]:ends[p + 1]]] for p in range(len(pivots))]

    def candidates(self, order: np.ndarray, ranks: np.ndarray, visited: int, share: float, least: int) -> np.ndarray:
        """Rows to compare: the share with the smallest footrule distance, rows of the visited files first, all ties
        at the last distance included."""
        size = len(self.ids)
        keep = max(least, int(np.ceil(share * size)))
        if keep >= size:
            return np.arange(size)
        posted = np.zeros(size, dtype=bool)
        for pivot in order[:visited]:
            posted[self.files[pivot]] = True
        rows = np.flatnonzero(posted)
        if len(rows) < keep:
            rows = np.arange(size)
        footrule = np.abs(self.ranks[rows] - ranks).sum(axis=1, dtype=np.int32)
        if len(rows) == size:
            footrule = footrule + np.where(posted, 0, 1 << 24)
        last = np.partition(footrule, keep - 1)[keep - 1]
        return rows[footrule <= last]


def nearest(table: DataFrame, queries: Column, k=10, id_col="vec_id", vector_col="embedding", pivots=256, posted=4,
            visited=64, length=128, share=0.15, least=64, shard_rows=4096, query_rows=1024) -> DataFrame:
    """query_id, rank, vec_id, score for the rows on which ``queries`` holds, by Euclidean distance.

    ``pivots``: sample size; ``posted``: inverted files a vector is in; ``visited``: files a query walks; ``length``:
    ranks from here on count as equal; ``share`` and ``least``: rows of a shard to compare exactly.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col)
    centres = spark.sparkContext.broadcast(choose_pivots(rows, pivots))  # pivots * length of a vector
    copies = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    asked = rows.withColumnRenamed("vec_id", id_col).where(queries).withColumnRenamed(id_col, "vec_id")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))

    def spread(salt: int, number: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(number)).cast("int")

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    left = indexed.withColumn("shard", spread(5, shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", spread(6, blocks)).withColumn("shard", every(shards))
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                          "score": pd.Series(dtype="float64")})

    def search(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return empty
        index = Shard(have["vec_id"].to_numpy(), np.stack(have["v"].to_numpy()).astype(np.float64), centres.value,
                      posted, length)
        targets = np.stack(ask["v"].to_numpy()).astype(np.float64)
        order, ranks = rankings(targets, centres.value)
        ranks = np.minimum(ranks, length).astype(np.int16)
        out = []
        for i, query in enumerate(ask["vec_id"].to_numpy()):
            found = index.candidates(order[i], ranks[i], visited, share, least)
            found = found[index.ids[found] != query]
            far = np.sqrt(((index.vectors[found] - targets[i]) ** 2).sum(axis=1))
            best = np.lexsort((index.ids[found], far))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": index.ids[found[best]], "score": far[best]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")) \
        .applyInPandas(search, "query_id long, vec_id long, score double").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
