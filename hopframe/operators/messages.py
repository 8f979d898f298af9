"""Backward propagation: per-vertex sums instead of per-traverser rows.

A question such as "how many blocked instruments lie three hops away" only needs a
number per vertex. Walking the hops from the end towards the seed keeps one row per
vertex at every step, so a hub with millions of edges costs one row, not one row per
traverser that reaches it. Multiplicity is exactly the bag multiplicity of the forward
traversal because sums distribute over paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.operators.skew import splittable


def pull(edges: DataFrame, values: DataFrame, measures: list[str],
         near: str = "src", far: str = "dst") -> DataFrame:
    """``id, <measures>``: for each vertex, the far-end measures summed over its edges.

    ``values`` has one row per vertex (``id`` plus the measures). Both sides of the join are
    plain shuffles, so a hub's edges are split over tasks, and the sum is combined map-side.
    """
    v = splittable(values.select(F.col("id").alias("_far"), *measures))
    return (edges.select(F.col(near).alias("id"), F.col(far).alias("_key"))
            .join(v, F.col("_key") == F.col("_far"))
            .groupBy("id").agg(*[F.sum(m).alias(m) for m in measures]))


def walk_counts(edges: DataFrame, depth: int, ends: DataFrame | None = None,
                near: str = "src", far: str = "dst") -> DataFrame:
    """``id, n``: number of walks of exactly ``depth`` edges that start at each vertex.

    ``ends`` (``id``) restricts where a walk may stop. One row per vertex at every step, so
    a hub costs its edges once, not its in-edges times its out-edges.
    """
    if ends is None:
        values = edges.groupBy(F.col(near).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        depth -= 1
    else:
        values = ends.select("id", F.lit(1).cast("bigint").alias("n"))
    for _ in range(depth):
        values = pull(edges, values, ["n"], near, far)
    return values


def total_per_seed(seeds: DataFrame, values: DataFrame, measures: list[str]) -> DataFrame:
    """Left-join sums onto every seed; a count of nothing is 0."""
    v = values.select(F.col("id").alias("_id"), *measures)
    return (seeds.join(v, seeds["seed"] == F.col("_id"), "left").drop("_id")
            .select(*seeds.columns, *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m)
                                      for m in measures]))
