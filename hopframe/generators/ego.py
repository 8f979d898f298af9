"""Ego networks: ego -> alters -> leaves, each identified by its place under its ego."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions.rng import uniform
from hopframe.functions.scalars import padded_id
from hopframe.generators.degrees import degree
from hopframe.generators.scale_free import expand, numbered
from hopframe.generators.values import provided_columns
from hopframe.model import EdgeTable, PropertyGraph, union_all


def edge_label(src: str, dst: str, conn: Mapping, invert: bool) -> str:
    a, b = (dst, src) if invert else (src, dst)
    return conn.get("label") or f"REL_{a.upper()}_TO_{b.upper()}"


def check_config(config: Mapping) -> None:
    if not config.get("EgoNode") or not config.get("AlterNodes"):
        raise ValueError("config needs EgoNode and AlterNodes")
    nodes = [config["EgoNode"], *config["AlterNodes"].values()]
    for node in nodes:
        if not isinstance(node.get("label"), str) or not node["label"]:
            raise ValueError("every node needs a label")
        conns = node.get("connections")
        if conns is not None and len(conns) == 0:
            raise ValueError("connections may be absent but not empty")
        for name, conn in (conns or {}).items():
            if not isinstance(conn.get("degree"), Mapping):
                raise TypeError(f"connection {name}: degree must be a mapping")
            if name != "EgoNode" and name not in config["AlterNodes"]:
                raise ValueError(f"connection {name}: unknown node type")


def generate(spark: SparkSession, n: int | DataFrame, config: Mapping, share_percent: float = 0.0,
             invert: bool = False, seed: int = 42, partitions: int | None = None) -> PropertyGraph:
    """``n`` egos with their alters and leaves; ``n`` is a count or a DataFrame of ego numbers ``n``.

    With chance ``share_percent`` a leaf is also linked from its ego, with the same edge
    properties. ``invert`` swaps the ends of every edge and its label. Ids are
    ``<label><19-digit ego>`` plus the position below the ego, unique without any counter.
    """
    check_config(config)
    ego_conf, alters = config["EgoNode"], config["AlterNodes"]
    ego_label = ego_conf["label"]
    egos = numbered(spark, n, 0)
    base = (egos.repartition(partitions) if partitions else egos).select(F.col("n").alias("ego"))
    ego_id = padded_id(ego_label, F.col("ego"))

    vertices: dict[str, list[DataFrame]] = {ego_label: [base.select(
        ego_id.alias("id"), *provided_columns(ego_conf.get("properties"), seed, ego_label, F.col("ego")))]}
    edges: list[EdgeTable] = []

    def add_edges(rows: DataFrame, label: str, src_label: str, dst_label: str, props: list[str]):
        a, b = ("dst", "src") if invert else ("src", "dst")
        ends = (dst_label, src_label) if invert else (src_label, dst_label)
        df = rows.select(F.concat_ws("#", F.lit(label), "_from", "_to").alias("eid"),
                         F.col("_from").alias(a), F.col("_to").alias(b), *props)
        edges.append(EdgeTable(label, df.select("eid", "src", "dst", *props), *ends))

    for name, conn in (ego_conf.get("connections") or {}).items():
        node = alters.get(name)
        if node is None:
            continue
        label, stream = node["label"], f"{ego_label}>{name}"
        count = degree(conn["degree"], seed, stream, F.col("ego"))
        placed = expand(base.select("ego", count.alias("_k")), "_k", "i", conn["degree"].get("max")).drop("_k")
        alter_id = F.concat(padded_id(label, F.col("ego")), F.lit(f"/{name}."), F.col("i").cast("string"))
        placed = placed.withColumn("aid", alter_id)
        vertices.setdefault(label, []).append(placed.select(
            F.col("aid").alias("id"), *provided_columns(node.get("properties"), seed, label, F.col("aid"))))
        eprops = conn.get("properties") or {}
        add_edges(placed.select(ego_id.alias("_from"), F.col("aid").alias("_to"),
                                *provided_columns(eprops, seed, stream, F.col("aid"))),
                  edge_label(ego_label, name, conn, invert), ego_label, label, list(eprops))

        for leaf, leaf_conn in (node.get("connections") or {}).items():
            leaf_node = alters.get(leaf)
            if leaf_node is None or leaf == ego_label:
                continue
            leaf_label, leaf_stream = leaf_node["label"], f"{stream}>{leaf}"
            k = degree(leaf_conn["degree"], seed, leaf_stream, F.col("ego"), F.col("i"))
            leaves = expand(placed.select("ego", "aid", k.alias("_k")), "_k", "j",
                            leaf_conn["degree"].get("max")).drop("_k")
            leaf_id = F.concat(padded_id(leaf_label, F.col("ego")), F.lit("/"),
                               F.substring_index("aid", "/", -1), F.lit(f"/{leaf}."), F.col("j").cast("string"))
            leaves = leaves.withColumn("lid", leaf_id)
            vertices.setdefault(leaf_label, []).append(leaves.select(
                F.col("lid").alias("id"),
                *provided_columns(leaf_node.get("properties"), seed, leaf_label, F.col("lid"))))
            lprops = leaf_conn.get("properties") or {}
            with_props = leaves.select("ego", "aid", "lid",
                                       *provided_columns(lprops, seed, leaf_stream, F.col("lid")))
            add_edges(with_props.select(F.col("aid").alias("_from"), F.col("lid").alias("_to"), *lprops),
                      edge_label(name, leaf, leaf_conn, invert), label, leaf_label, list(lprops))
            if share_percent > 0:
                shared = with_props.filter(
                    uniform(seed, f"{leaf_stream}/share", F.col("lid")) < F.lit(share_percent / 100.0))
                add_edges(shared.select(ego_id.alias("_from"), F.col("lid").alias("_to"), *lprops),
                          edge_label(ego_label, leaf, leaf_conn, invert), ego_label, leaf_label, list(lprops))
    return PropertyGraph({k: union_all(v) for k, v in vertices.items()}, tuple(edges))
