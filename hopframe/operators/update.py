"""Graph updates as new DataFrames; write the result to apply it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.model import EdgeTable, PropertyGraph
from hopframe.sources.checks import dangling_edges

ASSIGNED = "ASSIGNED_TO_DRIVER"


def add_vertices(g: PropertyGraph, label: str, rows: DataFrame) -> PropertyGraph:
    old = g.vertices.get(label)
    new = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    return g.with_vertices(label, new)


def add_edges(g: PropertyGraph, label: str, rows: DataFrame, src_label: str | None = None,
              dst_label: str | None = None, check: bool = True) -> PropertyGraph:
    """Append edges (``src, dst, props``; ``eid`` made from ``label``, ends and a hash if absent).

    With ``check``, rows whose ends do not exist are left out (an anti-join per end).
    """
    if "eid" not in rows.columns:
        from hopframe.sources.csv_graph import with_edge_ids

        rows = with_edge_ids(rows, label)
    if check:
        rows = rows.join(dangling_edges(g, rows).select(F.col("eid").alias("_bad")),
                         F.col("eid") == F.col("_bad"), "left_anti")
    tables, merged = [], False
    for t in g.edges:
        if not merged and (t.label, t.src_label, t.dst_label) == (label, src_label, dst_label):
            t, merged = replace(t, df=t.df.unionByName(rows, allowMissingColumns=True)), True
        tables.append(t)
    if not merged:
        tables.append(EdgeTable(label, rows, src_label, dst_label))
    return g.with_edges(tables)


def add_edges_by_key(g: PropertyGraph, label: str, rows: DataFrame, src: tuple[str, str],
                     dst: tuple[str, str], src_key: str, dst_key: str) -> PropertyGraph:
    """Append edges whose ends are given by property values.

    ``src``/``dst`` are (vertex label, property); ``src_key``/``dst_key`` the columns of
    ``rows`` that hold the values. A value that matches nothing adds no edge.
    """
    s = g.vertices[src[0]].select(F.col(src[1]).alias("_sk"), F.col("id").alias("src"))
    d = g.vertices[dst[0]].select(F.col(dst[1]).alias("_dk"), F.col("id").alias("dst"))
    extra = [c for c in rows.columns if c not in (src_key, dst_key)]
    matched = (rows.join(s, F.col(src_key) == F.col("_sk")).join(d, F.col(dst_key) == F.col("_dk"))
               .select("src", "dst", *extra))
    return add_edges(g, label, matched, src[0], dst[0], check=False)


def set_property(g: PropertyGraph, label: str, updates: DataFrame, key: str) -> PropertyGraph:
    """Overwrite ``key`` where ``updates`` (``id, <key>``) has a value.

    Of several values for one id the largest is taken, so no vertex is ever doubled; that
    aggregate already partitions by id, as the join needs.
    """
    u = updates.groupBy(F.col("id").alias("_u")).agg(F.max(key).alias("_new"))
    v = g.vertices[label]
    old = F.col(key) if key in v.columns else F.lit(None)
    cols = [F.coalesce("_new", old).alias(c) if c == key else F.col(c) for c in v.columns]
    if key not in v.columns:
        cols.append(F.col("_new").alias(key))
    return g.with_vertices(label, v.join(u, F.col("id") == F.col("_u"), "left").select(*cols))


def assign_drivers(g: PropertyGraph, assignments: DataFrame, replace_old: bool = False) -> PropertyGraph:
    """Append DELIVERED_BY edges and mark the orders as assigned.

    ``assignments``: order_id, driver_id, assigned_date. Assignments that name an unknown
    order or driver change nothing, and a repeated assignment counts once. The old driver edge stays unless ``replace_old``.
    """
    orders = g.vertices["FoodOrder"].select(F.col("id").alias("_o"))
    drivers = g.vertices["Driver"].select(F.col("id").alias("_d"))
    ok = (assignments.join(orders, F.col("order_id") == F.col("_o"), "left_semi")
          .join(drivers, F.col("driver_id") == F.col("_d"), "left_semi")
          .select("order_id", "driver_id", "assigned_date").distinct())
    rows = ok.select(
        F.concat_ws("#", F.lit("DELIVERED_BY"), "order_id", "driver_id",
                    F.col("assigned_date").cast("string")).alias("eid"),
        F.col("order_id").alias("src"), F.col("driver_id").alias("dst"), "assigned_date")
    if replace_old:
        taken = ok.select(F.col("order_id").alias("_t")).distinct()
        g = g.with_edges([replace(t, df=t.df.join(taken, F.col("src") == F.col("_t"), "left_anti"))
                          if t.label == "DELIVERED_BY" else t for t in g.edges])
    g = add_edges(g, "DELIVERED_BY", rows, "FoodOrder", "Driver", check=False)
    status = ok.select(F.col("order_id").alias("id"), F.lit(ASSIGNED).alias("status"))
    return set_property(g, "FoodOrder", status, "status")


def drop_vertices(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Remove the vertices and every edge that touches them."""
    gone = ids.select(F.col("id").alias("_g")).distinct()
    verts = {k: v.join(gone, F.col("id") == F.col("_g"), "left_anti") for k, v in g.vertices.items()}
    tables = [replace(t, df=t.df.join(gone, F.col("src") == F.col("_g"), "left_anti")
                      .join(gone, F.col("dst") == F.col("_g"), "left_anti")) for t in g.edges]
    return replace(g, vertices=verts, edges=tuple(tables))
