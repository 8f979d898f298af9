"""Order and delivery look-ups, for every customer, order or restaurant at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.rng import uniform
from hopframe.functions.scalars import micros, or_unknown
from hopframe.model import PropertyGraph, union_all
from hopframe.operators.frontier import Frontier
from hopframe.operators.skew import first_per, spread
from hopframe.session import materialize

# Growth of the width for seeds whose kept prefixes gave too few paths.
WIDER = 4


def order_items(g: PropertyGraph) -> DataFrame:
    """``order_id, status, item, qty, price``: one row per CONTAINS edge, status attached.

    An order without items keeps one row with NULL item columns.
    """
    contains = g.edge_view(["CONTAINS"], ["qty"]).select(
        F.col("src").alias("_o"), F.col("dst").alias("_i"), "qty")
    items = g.vertices["MenuItem"].select(F.col("id").alias("_id"), F.col("name").alias("item"), "price")
    lines = contains.join(items, F.col("_i") == F.col("_id"))
    orders = g.vertices["FoodOrder"].select(F.col("id").alias("order_id"), or_unknown(F.col("status")).alias("status"))
    return (orders.join(lines, F.col("order_id") == F.col("_o"), "left")
            .select("order_id", "status", "item", "qty", "price"))


def _customer_orders(g: PropertyGraph) -> DataFrame:
    placed = g.edge_view(["PLACED"], ()).select(F.col("src").alias("customer"), F.col("dst").alias("_o"))
    orders = g.vertices["FoodOrder"].select(
        F.col("id").alias("order_id"), "order_date", or_unknown(F.col("status")).alias("status"))
    return placed.join(orders, F.col("_o") == F.col("order_id")).select(
        "customer", "order_id", "order_date", "status")


def latest_order(g: PropertyGraph) -> DataFrame:
    """``customer, order_id, order_date, status``: newest order, ties to the smallest id.

    One aggregate that combines map-side: a customer with millions of orders is reduced to
    one candidate per map task.
    """
    rows = _customer_orders(g)
    is_number = dict(rows.dtypes)["order_date"] in ("int", "bigint")
    when = F.col("order_date") if is_number else micros(F.col("order_date"))
    return (rows.groupBy("customer").agg(F.min(F.struct((-when).alias("_w"), "order_id", "order_date", "status"))
                                         .alias("_r"))
            .select("customer", "_r.order_id", "_r.order_date", "_r.status"))


def recent_orders(g: PropertyGraph, k: int = 5) -> DataFrame:
    """The ``k`` newest orders per customer with their rank."""
    order = [F.col("order_date").desc(), F.col("order_id")]
    return (first_per(_customer_orders(g), "customer", order, k, "order_id", "rank")
            .select("customer", "rank", "order_id", "order_date", "status"))


def restaurant_ratings(g: PropertyGraph, k: int = 10) -> DataFrame:
    """``restaurant, eid, rating, comment``: the first ``k`` ratings by edge id."""
    return (first_per(g.edge_view(["RATED"], ["rating", "comment"]), "dst", [F.col("eid")], k, "eid")
            .select(F.col("dst").alias("restaurant"), "eid", "rating", "comment"))


def random_ids(g: PropertyGraph, labels: list[str], n: int, seed: int = 0, algo: str = "xxhash64") -> DataFrame:
    """``label, id``: ``n`` random vertices per label, the same for the same seed.

    Each map task keeps its ``n`` smallest hashes per label before the shuffle.
    """
    ids = g.vertex_view(labels, ()).withColumn("_u", uniform(seed, "sample", F.col("id"), algo=algo))
    return first_per(ids, "label", [F.col("_u"), F.col("id")], n, "id").select("label", "id")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0, algo: str = "xxhash64") -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by hash of ``key``; a top-k plan, not a sort."""
    u = uniform(seed, "sample", F.col(key), algo=algo)
    return df.orderBy(u, F.col(key)).limit(n)


def neighbourhood(g: PropertyGraph, seeds: DataFrame, label: str, depth: int,
                  per_hop: int | None = None, max_paths: int | None = None) -> Frontier:
    """Simple paths of exactly ``depth`` hops, all of them unless capped.

    ``per_hop`` keeps that many edges of a vertex and ``max_paths`` that many paths of a seed, both in id order, so
    reruns agree.
    """
    if max_paths is not None:
        return smallest_walks(g, seeds, label, depth, max_paths, per_hop)
    start = g.seeded(seeds, [label]).with_path()
    return start.repeat(lambda f: f.both_e(cap=per_hop).other_v().simple_path(), depth)


def smallest_walks(g: PropertyGraph, seeds: DataFrame, label: str, depth: int, k: int,
                   per_hop: int | None = None) -> Frontier:
    """The ``k`` smallest simple paths of exactly ``depth`` hops per seed, grown as prefixes.

    A path sorts by its prefix first, so after every hop only the smallest prefixes of a seed go on, and a vertex
    offers each of them only its first edges. What is dropped sorts after everything that is kept. Prefixes may lead
    nowhere: a seed that lost some and has fewer than ``k`` paths is walked again with ``WIDER`` times the width. So the
    result is exact, and between hops a seed has at most width times width rows, whatever the hubs. Paths are long and
    compress well, so they are ranked, and their elements listed, in a stated number of tasks.
    """
    done, todo, width = [], seeds.select("seed").distinct(), k
    while True:
        f, lost = _grow(g, todo, label, depth, width, per_hop)
        enough = f.df.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
        short = materialize(lost.distinct().join(enough, "seed", "left_anti"), "walks-short")
        done.append(f.df.join(short, "seed", "left_anti"))
        if short.isEmpty():
            break
        todo, width = short, width * WIDER
    best = first_per(spread(union_all(done), "seed"), "seed", [F.col("path")], k, "cur").drop("_rn")
    return replace(f, df=best, seeds=seeds.select("seed"))


def _grow(g: PropertyGraph, seeds: DataFrame, label: str, depth: int, width: int,
          per_hop: int | None) -> tuple[Frontier, DataFrame]:
    """All paths below some bound per seed, and the ``seed`` of those that have paths beyond it."""
    f, lost = g.seeded(seeds, [label]).with_path(), []
    for _ in range(depth):
        if per_hop is None:
            # One edge more than wanted marks where the edges left out begin.
            e = f.both_e(cap=width + 1)
            over = F.min(F.when(F.col("_nth") > width, F.col("path"))).over(Window.partitionBy("seed"))
            rows = materialize(e.df.withColumn("_over", over), "walks-edges")
            lost.append(rows.filter(F.col("_nth") > width).select("seed"))
            e = replace(e, df=rows.filter("_over IS NULL OR path < _over"))
        else:
            e = f.both_e(cap=per_hop)
        f = e.other_v().simple_path()
        kept = materialize(first_per(spread(f.df, "seed"), "seed", [F.col("path")], width + 1, "cur"), "walks")
        lost.append(kept.filter(F.col("_rn") > width).select("seed"))
        f = replace(f, df=kept.filter(F.col("_rn") <= width).drop("_rn"))
    return f, union_all(lost)


def first_walks(g: PropertyGraph, seeds: DataFrame, label: str, depth: int, k: int,
                per_hop: int | None = None) -> DataFrame:
    """``seed, path``: the ``k`` smallest walks over all seeds together, one global cap.

    Seeds are walked in id order, ``k`` at first and ``WIDER`` times as many if those have too few walks.
    """
    ordered, many = seeds.select("seed").distinct().orderBy("seed"), k
    while True:
        some = materialize(ordered.limit(many), "walks-seeds")
        walks = smallest_walks(g, some, label, depth, k, per_hop).paths().orderBy("seed", "path").limit(k)
        if walks.count() == k or some.count() < many:
            return walks
        many *= WIDER


def neighbourhood_elements(g: PropertyGraph, seeds: DataFrame, label: str, depth: int, **caps) -> DataFrame:
    """``seed, kind, id``: distinct vertices (``v``) and edges (``e``) of the neighbourhood."""
    return path_elements(neighbourhood(g, seeds, label, depth, **caps).paths())


def path_elements(paths: DataFrame, key: str = "seed") -> DataFrame:
    """Split alternating paths by position parity into distinct ``key, kind, id``."""
    return (paths.select(key, F.posexplode("path").alias("_pos", "id"))
            .select(key, F.when(F.col("_pos") % 2 == 0, "v").otherwise("e").alias("kind"), "id")
            .distinct())
