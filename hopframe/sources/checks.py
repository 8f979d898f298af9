"""Preflight checks: duplicate vertices, dangling edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.model import PropertyGraph


class DuplicateVertexError(ValueError):
    pass


def duplicate_ids(vertices: DataFrame) -> DataFrame:
    """``id, copies`` for ids that occur more than once."""
    return (vertices.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def resolve_duplicates(vertices: DataFrame, policy: str = "fail") -> DataFrame:
    """One row per id.

    ``fail``   raise if any id repeats (runs a small job)
    ``first``  keep the smallest row in column order
    ``merge``  smallest non-null value per property
    All copies of an id are reduced map-side, so a heavily repeated id is no hot task.
    """
    props = [c for c in vertices.columns if c != "id"]
    if policy == "fail":
        bad = duplicate_ids(vertices).limit(1).collect()
        if bad:
            raise DuplicateVertexError(f"vertex id {bad[0]['id']!r} occurs {bad[0]['copies']} times")
        return vertices
    if policy == "first":
        if not props:
            return vertices.distinct()
        kept = vertices.groupBy("id").agg(F.min(F.struct(*props)).alias("_r"))
        return kept.select("id", *[F.col(f"_r.{p}").alias(p) for p in props])
    if policy == "merge":
        if not props:
            return vertices.distinct()
        return vertices.groupBy("id").agg(*[F.min(p).alias(p) for p in props])
    raise ValueError(f"unknown duplicate policy {policy!r}")


def dangling_edges(g: PropertyGraph, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex.

    The distinct ends are checked first; the edges are then matched against the few
    missing ids instead of against all vertices.
    """
    ids = g.vertex_view(None, ()).select(F.col("id").alias("_v"))
    ends = (edges.select(F.explode(F.array("src", "dst")).alias("_end")).distinct())
    missing = ends.join(ids, F.col("_end") == F.col("_v"), "left_anti")
    bad_src = edges.join(missing, F.col("src") == F.col("_end"), "left_semi")
    bad_dst = (edges.join(missing, F.col("dst") == F.col("_end"), "left_semi")
               .join(missing, F.col("src") == F.col("_end"), "left_anti"))
    return bad_src.unionByName(bad_dst)


def validate(g: PropertyGraph) -> DataFrame:
    """``stage, label, problems``: ids per vertex label that occur twice, in this or in another label, and dangling
    edges per edge label."""
    repeated = g.vertex_view(None, ()).select("id", "label").groupBy("id").agg(
        F.count(F.lit(1)).alias("copies"), F.collect_set("label").alias("labels")).filter("copies > 1")
    per_label = repeated.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    known = g.edges[0].df.sparkSession if g.edges else next(iter(g.vertices.values())).sparkSession
    names = known.createDataFrame([(x,) for x in g.vertices], "label string")
    parts = [names.join(per_label, "label", "left").select(
        F.lit("vertex validation").alias("stage"), "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("problems"))]
    bad = dangling_edges(g, g.edge_view(None, ()))
    labels = sorted({t.label for t in g.edges})
    parts.append(bad.agg(*[F.count(F.when(F.col("label") == x, 1)).alias(f"c{i}") for i, x in enumerate(labels)])
                 .select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"c{i}").alias("problems"))
                                             for i, x in enumerate(labels)])).alias("r"))
                 .select(F.lit("edge validation").alias("stage"), "r.label", "r.problems"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
