"""Multi-type scale-free graphs without a shuffle of edges.

A vertex's degree, its targets and all properties are functions of its own number, so
every task makes its share of vertices and edges independently.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions.rng import hash_bits, uniform
from hopframe.functions.scalars import padded_id
from hopframe.generators.degrees import zipf_degree
from hopframe.generators.values import check_spec, property_columns
from hopframe.model import EdgeTable, PropertyGraph
from hopframe.operators.skew import spread

CHUNK = 1 << 13
WALK, WALKS = 8, 32


@dataclass(frozen=True)
class VertexType:
    name: str
    percent: float
    properties: Mapping[str, Mapping]


@dataclass(frozen=True)
class EdgeType:
    label: str
    key: str
    src: str
    dst: str
    properties: Mapping[str, Mapping]


def parse_config(config: Mapping) -> tuple[list[VertexType], list[EdgeType]]:
    """Types from the nested config; percents must total 100 and property specs be valid."""
    verts = [VertexType(name, c["percent"], c.get("properties") or {}) for name, c in config["vertices"].items()]
    edges = [EdgeType(label, key, c["from"], c["to"], c.get("properties") or {})
             for label, group in config["edges"].items() for key, c in group.items()]
    total = sum(v.percent for v in verts)
    if total != 100:
        raise ValueError(f"vertex percents total {total}, not 100")
    names = {v.name for v in verts}
    for e in edges:
        if e.src not in names or e.dst not in names:
            raise ValueError(f"edge type {e.key}: unknown vertex type")
    for owner, props in [(v.name, v.properties) for v in verts] + [(e.key, e.properties) for e in edges]:
        for name, spec in props.items():
            check_spec(f"{owner}.{name}", spec)
    return verts, edges


def vertex_ranges(n: int, verts: list[VertexType]) -> dict[str, tuple[int, int]]:
    """Contiguous id ranges, int(n * percent / 100) each; the last type takes the remainder."""
    out, at = {}, 0
    for i, v in enumerate(verts):
        size = int(n * (v.percent / 100)) if i < len(verts) - 1 else n - at
        out[v.name] = (at, at + size)
        at += size
    return out


def numbered(spark: SparkSession, keys: int | DataFrame, first: int = 1) -> DataFrame:
    """A DataFrame of numbers ``n``: the one given, or ``first``, ``first`` + 1, ... for a count.

    Numbers given are spread evenly over the cluster: they are small and may lie in one file, but much grows from each.
    """
    if isinstance(keys, int):
        return spark.range(first, first + keys).select(F.col("id").alias("n"))
    return spread(keys.select(F.col("n").cast("bigint").alias("n")))


def distinct_targets(src: Column, i: Column, pool: int, seed: int, stream: str, algo: str = "xxhash64") -> Column:
    """The i-th (0-based) target of ``src`` in [0, pool); distinct for i < pool.

    A keyed permutation per source: six Feistel rounds over the smallest square of a power of two that holds the pool,
    walked on from ``i`` until the result lies in the pool. A permutation has no repeats, so none need removing.
    """
    if pool <= 1:
        return F.lit(0).cast("bigint") + i * 0
    half = max(1, ((pool - 1).bit_length() + 1) // 2)
    low = F.lit((1 << half) - 1).cast("bigint")

    def rounds(x: Column) -> Column:
        start = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(low).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(6)), start,
            lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(
                hash_bits(seed, f"{stream}/permute", src, k, s["r"], algo=algo).bitwiseAND(low)).alias("r")),
            lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))

    # The square is less than four times the pool, so WALKS times WALK steps leave a value outside with a probability
    # below 10^-30; that would be an error, not a target. Most values need few steps, so the walk is looked at in parts.
    def walk(y: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, lambda z, _: F.when(z < pool, z).otherwise(rounds(z)))

    # The check is the last step of the walk, so that the walk is evaluated once per target.
    outside = F.raise_error(F.lit("a target stayed outside its pool")).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), rounds(i.cast("bigint")),
                       lambda y, _: F.when(y < pool, y).otherwise(walk(y)),
                       lambda y: F.when(y < pool, y).otherwise(outside))


def out_degrees(vertices: DataFrame, gamma: float, n_src: int, seed: int, stream: str,
                algo: str = "xxhash64") -> DataFrame:
    """``n, degree`` for a DataFrame of vertex numbers ``n``."""
    u = uniform(seed, f"{stream}/degree", F.col("n"), algo=algo)
    return vertices.select("n", zipf_degree(u, gamma, n_src).alias("degree"))


def expand(degs: DataFrame, count: str, index: str, most: int | None = None) -> DataFrame:
    """One row per (row, 0 <= index < count); ``most`` bounds the counts if known.

    Rows with more than ``CHUNK`` edges are cut into chunks spread over the cluster, so a
    hub is generated by many tasks; the others are expanded where they are.
    """
    c = F.col(count)
    few = degs.filter((c > 0) & (c <= CHUNK)).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), c - 1)).alias(index))
    if most is not None and most <= CHUNK:
        return few
    chunks = degs.filter(c > CHUNK).select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((c - 1) / CHUNK).cast("bigint"))).alias("_chunk"))
    hubs = spread(chunks).select(*degs.columns, F.explode(F.sequence(
        F.col("_chunk") * CHUNK, F.least(c, (F.col("_chunk") + 1) * CHUNK) - 1)).alias(index))
    return few.unionByName(hubs)


def target_table(sources: DataFrame, e_key: str, src_type: str, dst_type: str,
                 ranges: Mapping[str, tuple[int, int]], gamma: float, seed: int,
                 allow_loops: bool = False, algo: str = "xxhash64") -> DataFrame:
    """``s, t``: vertex numbers of the edges of one edge type."""
    lo, hi = ranges[dst_type]
    same = src_type == dst_type and not allow_loops
    pool = hi - lo - (1 if same else 0)
    n_src = ranges[src_type][1] - ranges[src_type][0]
    if pool <= 0:
        return sources.select(F.col("n").alias("s"), F.col("n").alias("t")).filter(F.lit(False))
    degs = out_degrees(sources, gamma, n_src, seed, e_key, algo).select(
        F.col("n").alias("s"), F.least("degree", F.lit(pool).cast("bigint")).alias("_k"))
    t = distinct_targets(F.col("s"), F.col("_i"), pool, seed, e_key, algo) + F.lit(lo).cast("bigint")
    pairs = expand(degs, "_k", "_i", pool).select("s", t.alias("t"))
    if same:
        pairs = pairs.withColumn("t", F.when(F.col("t") >= F.col("s"), F.col("t") + 1).otherwise(F.col("t")))
    return pairs


def generate(spark: SparkSession, n: int | DataFrame, config: Mapping, gamma: float = 2.5, seed: int = 42,
             allow_loops: bool = False, partitions: int | None = None) -> PropertyGraph:
    """Scale-free graph of ``n`` vertices; ``outDegree`` is the realised out-degree.

    ``n`` is a count or a DataFrame of vertex numbers ``n`` (0, 1, ... without gaps).
    """
    verts, etypes = parse_config(config)
    ranges = vertex_ranges(n if isinstance(n, int) else n.count(), verts)

    def numbers(name):
        lo, hi = ranges[name]
        if not isinstance(n, int):
            return numbered(spark, n).filter((F.col("n") >= lo) & (F.col("n") < hi))
        return spark.range(lo, hi, 1, partitions).select(F.col("id").alias("n")) if partitions else \
            spark.range(lo, hi).select(F.col("id").alias("n"))

    vertices = {}
    for v in verts:
        total = F.lit(0).cast("bigint")
        for e in etypes:
            if e.src == v.name:
                lo, hi = ranges[e.dst]
                pool = hi - lo - (1 if e.src == e.dst and not allow_loops else 0)
                k = zipf_degree(uniform(seed, f"{e.key}/degree", F.col("n")), gamma,
                                ranges[v.name][1] - ranges[v.name][0])
                total = total + F.least(k, F.lit(max(pool, 0)).cast("bigint"))
        vertices[v.name] = numbers(v.name).select(
            padded_id(v.name, F.col("n")).alias("id"), total.cast("int").alias("outDegree"),
            *property_columns(v.properties, seed, v.name, F.col("n")))
    edges = []
    for e in etypes:
        pairs = target_table(numbers(e.src), e.key, e.src, e.dst, ranges, gamma, seed, allow_loops)
        eid = F.concat_ws("#", F.lit(e.key), F.col("s").cast("string"), F.col("t").cast("string"))
        edges.append(EdgeTable(e.label, pairs.select(
            eid.alias("eid"), padded_id(e.src, F.col("s")).alias("src"), padded_id(e.dst, F.col("t")).alias("dst"),
            *property_columns(e.properties, seed, e.key, eid)), e.src, e.dst))
    return PropertyGraph(vertices, tuple(edges))
