"""Node and link tables for drawing a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.functions.display import link_label, node_label
from hopframe.model import PropertyGraph
from hopframe.plans.orders import path_elements


def nodes(g: PropertyGraph, ids: DataFrame | None = None) -> DataFrame:
    """``id, label, type, props``: display label, vertex label, properties as JSON."""
    v = g.vertex_view()
    if ids is not None:
        v = v.join(ids.select(F.col("id").alias("_k")).distinct(), F.col("id") == F.col("_k"), "left_semi")
    props = [c for c in v.columns if c not in ("id", "label")]
    return v.select("id", node_label(v.columns).alias("label"), F.col("label").alias("type"),
                    F.to_json(F.struct(*props)).alias("props") if props else F.lit("{}").alias("props"))


def links(g: PropertyGraph, ids: DataFrame | None = None, style: str = "amount") -> DataFrame:
    """``id, source, target, type, label``."""
    e = g.edge_view()
    if ids is not None:
        e = e.join(ids.select(F.col("id").alias("_k")).distinct(), F.col("eid") == F.col("_k"), "left_semi")
    return e.select(F.col("eid").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"),
                    F.col("label").alias("type"), link_label(e.columns, style).alias("label"))


def subgraph(g: PropertyGraph, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a ``seed, path`` (or ``path``) result; a pair of joins, no round trip."""
    if "seed" not in paths.columns:
        paths = paths.select(F.lit("").alias("seed"), "path")
    parts = path_elements(paths)
    return (nodes(g, parts.filter(F.col("kind") == "v")), links(g, parts.filter(F.col("kind") == "e")))
