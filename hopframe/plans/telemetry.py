"""Latency-bucket queries: quantiles from cumulative ``le`` buckets and heat maps.

Buckets: ``<series columns>, le DOUBLE (Infinity for the last), count`` cumulative in ``le``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_quantile(buckets: DataFrame, series: list[str], q: float) -> DataFrame:
    """``<series>, value``: linear interpolation inside the bucket that holds the rank.

    The lowest bucket starts at 0 (or is taken as its bound if that is not positive); a
    rank in the unbounded bucket gives the largest finite bound; no observations give NULL.
    A series has a fixed, small number of buckets, so its window stays small.
    """
    w = Window.partitionBy(*series).orderBy("le")
    whole = Window.partitionBy(*series)
    le, c = F.col("le"), F.col("count").cast("double")
    rows = (buckets.withColumn("_prev_le", F.lag("le").over(w)).withColumn("_prev", F.lag("count").over(w))
            .withColumn("_total", F.max("count").over(whole).cast("double")))
    rank = F.col("_total") * F.lit(q)
    start = F.coalesce("_prev_le", F.lit(0.0))
    before = F.coalesce(F.col("_prev").cast("double"), F.lit(0.0))
    inside = start + (le - start) * (rank - before) / F.nullif(c - before, F.lit(0.0))
    value = (F.when(F.col("_total") == 0, F.lit(None).cast("double"))
             .when(le == F.lit(float("inf")), F.col("_prev_le"))
             .when(F.col("_prev_le").isNull() & (le <= 0), le)
             .otherwise(F.coalesce(inside, start)))
    hit = rows.filter(c >= rank).withColumn("_value", value)
    return hit.groupBy(*series).agg(F.min_by("_value", "le").alias("value"))


def average_quantile(buckets: DataFrame, series: list[str], by: str, q: float) -> DataFrame:
    """``<by>, value``: the mean of the series quantiles."""
    return bucket_quantile(buckets, series, q).groupBy(by).agg(F.avg("value").alias("value"))


def heat_map(buckets: DataFrame) -> DataFrame:
    """``le, count``: totals per bucket bound over all series."""
    return buckets.groupBy("le").agg(F.sum("count").alias("count"))


def to_buckets(obs: DataFrame, series: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets from raw observations.

    Each observation falls in one bucket; the counts are cumulated per series afterwards,
    so nothing is multiplied by the number of bounds.
    """
    limits = [*bounds, float("inf")]
    arr = F.array(*[F.lit(b) for b in limits])
    slot = F.size(F.filter(arr, lambda b: b < F.col(value).cast("double"))) + 1
    per = obs.groupBy(*series, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    grid = (per.select(*series).distinct()
            .select(*series, F.posexplode(arr).alias("_pos", "le")).withColumn("_slot", F.col("_pos") + 1))
    filled = grid.join(per, [*series, "_slot"], "left")
    w = Window.partitionBy(*series).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*series, "le", F.sum(F.coalesce("_n", F.lit(0))).over(w).cast("bigint").alias("count"))
