"""Scoring of incoming payments and application of a driver feed.

Sinks are written per micro-batch under ``batch=<id>`` with overwrite, so a batch that is
replayed after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hopframe.functions.scalars import mean_of_cents
from hopframe.model import PropertyGraph
from hopframe.operators.update import assign_drivers
from hopframe.plans import fraud
from hopframe.session import fresh_path, materialize


def _start(stream: DataFrame, apply, checkpoint: str, continuous: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def score_beneficiaries(stream: DataFrame, g: PropertyGraph, out: str, checkpoint: str,
                        every: str | None = None, store: str | None = None) -> StreamingQuery:
    """Write ``payment, status`` (known / second_degree / first_time) for each payment.

    ``stream``: payment, person, target. The look-up tables lie in ``store``, where ``fraud.refresh_index`` adds
    versions at any time; without it a first version is written once per start. Each batch takes the newest complete
    version and reads only the buckets of its own persons and targets. No closure of all second-degree pairs is ever
    built.
    """
    spark = stream.sparkSession
    if store is None:
        store = fresh_path(spark, "beneficiary-index")
        fraud.refresh_index(g, store)

    def score(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            index = fraud.newest_index(spark, store).only(held)
            fraud.beneficiary_status(g, held, index).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            held.unpersist()

    return _start(stream.select("payment", "person", "target"), score, checkpoint, every)


def velocity_scores(stream: DataFrame, g: PropertyGraph) -> DataFrame:
    """Stream–static join: each payment with its sender's mean amount and the ratio to it.

    ``stream``: payment, vpa, cents. A sender without history has NULL mean and ratio. The means are stored once per
    start, not computed again for every batch.
    """
    mean = materialize(fraud.sender_totals(g), "sender-totals").select(
        F.col("id").alias("_v"), mean_of_cents(F.col("tx_cents"), F.col("tx_n")).alias("mean_amount"))
    amount = F.col("cents").cast("double") / F.lit(100).cast("double")
    return (stream.join(mean, F.col("vpa") == F.col("_v"), "left")
            .select("payment", "vpa", "cents", "mean_amount",
                    F.when(F.col("mean_amount") != 0, amount / F.col("mean_amount")).alias("ratio")))


def hourly_velocity(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Per sender and window: number of payments and total; payments later than ``late`` drop.

    ``upsert_windows`` serves open windows too; in append mode a window appears once the watermark has passed its end.
    """
    return (stream.withWatermark("ts", late)
            .groupBy(F.window("ts", width), "vpa")
            .agg(F.count(F.lit(1)).alias("payments"), F.sum("cents").alias("total_cents"))
            .select(F.col("window.start").alias("window_start"), "vpa", "payments", "total_cents"))


def upsert_windows(windows: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Serve windows before they close: every batch writes the new state of the windows it has touched.

    A batch that is replayed replaces its own folder. ``current_windows`` reads the latest state of each window.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def current_windows(spark: SparkSession, out: str) -> DataFrame:
    """``window_start, vpa, payments, total_cents``: the state of the last batch that touched a window."""
    states = spark.read.option("basePath", out).schema(
        "window_start timestamp, vpa string, payments bigint, total_cents bigint, batch bigint").parquet(f"{out}/batch=*")
    last = F.max(F.struct("batch", "payments", "total_cents")).alias("_last")
    return states.groupBy("window_start", "vpa").agg(last).select(
        "window_start", "vpa", "_last.payments", "_last.total_cents")


def to_parquet(result: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append-mode file sink (exactly once through its own log)."""
    writer = (result.writeStream.format("parquet").outputMode("append")
              .option("path", out).option("checkpointLocation", checkpoint))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def collect_assignments(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Store a feed of ``order_id, driver_id, assigned_date``, one folder per batch.

    Repeats inside a batch are merged; across batches ``applied`` keeps one row per
    (order, driver), so replaying or re-sending an assignment changes nothing.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy("order_id", "driver_id").agg(F.min("assigned_date").alias("assigned_date"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(stream.select("order_id", "driver_id", "assigned_date"), keep, checkpoint, every)


def applied(g: PropertyGraph, out: str, replace_old: bool = False) -> PropertyGraph:
    """The graph with all collected assignments applied."""
    spark = next(iter(g.vertices.values())).sparkSession
    rows = (spark.read.schema("order_id string, driver_id string, assigned_date bigint").parquet(f"{out}/batch=*")
            .groupBy("order_id", "driver_id").agg(F.min("assigned_date").alias("assigned_date")))
    return assign_drivers(g, rows, replace_old)
