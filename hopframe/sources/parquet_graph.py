"""The columnar form of a graph: one Parquet folder per label, and join-ready adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hopframe.model import EdgeTable, PropertyGraph, union_all
from hopframe.operators.skew import supernodes

ANY = "_"
TABLES = "kind string, label string, start string, end string, path string, rows bigint"


def write_graph(g: PropertyGraph, root: str) -> dict[tuple[str, str], int]:
    """Write every label and a list of what was written; returns ``(kind, label) -> rows`` counted during the write."""
    written = []

    def save(kind: str, label: str, df: DataFrame, start: str | None = None, end: str | None = None) -> None:
        path = f"{kind}/label={label}" + (f"/from={start or ANY}/to={end or ANY}" if kind == "edge" else "")
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{root}/{path}")
        written.append((kind, label, start, end, path, seen.get["rows"]))

    for label, v in g.vertices.items():
        save("vertex", label, v)
    for t in g.edges:
        save("edge", t.label, t.df, t.src_label, t.dst_label)
    spark = next(df.sparkSession for df in [*g.vertices.values(), *(t.df for t in g.edges)])
    spark.createDataFrame(written, TABLES).coalesce(1).write.parquet(f"{root}/tables")
    counts: dict[tuple[str, str], int] = {}
    for kind, label, *_, rows in written:
        counts[(kind, label)] = counts.get((kind, label), 0) + rows
    return counts


def read_graph(spark: SparkSession, root: str) -> PropertyGraph:
    """Read what ``write_graph`` wrote, by its list of tables (one row per label and pair of end labels)."""
    listed = spark.read.schema(TABLES).parquet(f"{root}/tables").orderBy("path").collect()
    frames = [(r, spark.read.parquet(f"{root}/{r['path']}")) for r in listed]
    return PropertyGraph({r["label"]: df for r, df in frames if r["kind"] == "vertex"},
                         tuple(EdgeTable(r["label"], df, r["start"], r["end"]) for r, df in frames if r["kind"] == "edge"))


def save_adjacency(g: PropertyGraph, prefix: str, root: str, buckets: int) -> PropertyGraph:
    """Store every edge table twice, bucketed by ``src`` and by ``dst``, for hops in either direction.

    A hop joins on the copy of the end it stands on and reads co-located files without shuffling the edges. A bucket
    holds whole vertices, so the edges of hubs, vertices with more than a bucket's share of the edges, lie in a plain
    table of their own, whose join Spark can split; there are fewer hubs than ``buckets``, so their list is broadcast.
    The tables are named ``<prefix>_<label>_<i>_by_src`` and ``.._by_dst``.
    """
    tables = []
    for i, t in enumerate(g.edges):
        stored = {}
        share = t.df.count() // buckets + 1
        for end in ("src", "dst"):
            name = f"{prefix}_{t.label.lower()}_{i}_by_{end}"
            hubs = F.broadcast(supernodes(t.df, share, end).select(F.col("id").alias(end)))
            (t.df.join(hubs, end, "left_anti").select(*t.df.columns).repartition(buckets, end)
             .write.bucketBy(buckets, end).sortBy(end).option("path", f"{root}/{name}").format("parquet").saveAsTable(name))
            t.df.join(hubs, end, "left_semi").write.parquet(f"{root}/{name}_hubs")
            spark = t.df.sparkSession
            stored[end] = (spark.table(name), spark.read.schema(t.df.schema).parquet(f"{root}/{name}_hubs"))
        df = union_all(stored["src"])
        tables.append(EdgeTable(t.label, df, t.src_label, t.dst_label, stored))
    return g.with_edges(tables)
