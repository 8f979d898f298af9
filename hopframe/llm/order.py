"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.session import materialize

# monotonically_increasing_id holds the partition above this bit and the row's place in it below.
PART_BIT = 33


def with_places(df: DataFrame, order: list[Column], name: str, place="_place") -> DataFrame:
    """``df`` as a written table with the long ``place`` of every row in ``order``, from 0.

    The rows are range-partitioned and sorted within their partitions; a partition's first place is the number of rows
    before it, taken from one count per partition. Equal rows are told apart by an arbitrary number, so many equal rows
    spread over several partitions. Null keys follow the sort order that ``order`` asks for; an empty table has no
    places. Columns beginning with ``_or_`` are reserved.
    """
    full = [*order, F.col("_or_row")]
    dealt = df.withColumn("_or_row", F.monotonically_increasing_id()).repartitionByRange(*full) \
        .sortWithinPartitions(*full).withColumn("_or_at", F.monotonically_increasing_id()).drop("_or_row")
    table = materialize(dealt, name).withColumn("_or_part", F.shiftright("_or_at", PART_BIT))
    before = Window.orderBy("_or_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, at most spark.sql.shuffle.partitions of them.
    starts = table.groupBy("_or_part").agg(F.count("*").alias("_or_rows")) \
        .select("_or_part", F.coalesce(F.sum("_or_rows").over(before), F.lit(0)).alias("_or_start"))
    inside = F.col("_or_at").bitwiseAND((1 << PART_BIT) - 1)
    return table.join(F.broadcast(starts), "_or_part") \
        .withColumn(place, F.col("_or_start") + inside).drop("_or_part", "_or_at", "_or_rows", "_or_start")
