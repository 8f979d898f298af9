"""Traversal semantics on small graphs, checked by hand or by brute force."""

import itertools
import random

import pytest
from conftest import pay_graph, rows
from pyspark.sql import functions as F

from hopframe.model import EdgeTable, PropertyGraph
from hopframe.operators import messages, quantiles, skew
from hopframe.operators.frontier import neq
from hopframe.plans import orders, payments


@pytest.fixture(scope="module")
def loops(spark):
    """Self-loop, parallel edges, a dead end, a NULL property and a vertex without edges."""
    return pay_graph(spark, [("U1", "Ann", 20), ("U2", None, 30)], [("A1", 1), ("A2", None), ("A3", 3), ("A4", 4)],
                     [("U1", "A1"), ("U2", "A2"), ("U1", "A3")],
                     [("e1", "A1", "A1", 100), ("e2", "A1", "A2", 200), ("e3", "A1", "A2", 300), ("e4", "A2", "A3", 400)])


def bag(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_bag_semantics_and_dedup(loops):
    out = loops.V("Account").out("Transaction")
    assert bag(out.ids(), "seed", "id") == [("A1", "A1"), ("A1", "A2"), ("A1", "A2"), ("A2", "A3")]
    assert bag(out.dedup().ids(), "seed", "id") == [("A1", "A1"), ("A1", "A2"), ("A2", "A3")]
    assert bag(out.bulk().df, "seed", "cur", "n") == [("A1", "A1", 1), ("A1", "A2", 2), ("A2", "A3", 1)]


def test_self_loop_appears_twice_in_both(loops):
    both = loops.V("Account", ids="A1").both("Transaction")
    assert bag(both.ids(), "id") == [("A1",), ("A1",), ("A2",), ("A2",)]
    assert bag(loops.V("Account", ids="A1").both_e("Transaction").other_v().ids(), "id") == bag(both.ids(), "id")


def test_counts_keep_empty_seeds(loops):
    n = loops.V("Account").out_e("Transaction").count()
    assert bag(n, "seed", "n") == [("A1", 3), ("A2", 1), ("A3", 0), ("A4", 0)]
    found = loops.V("Account").out("Transaction").exists()
    assert bag(found, "seed", "found") == [("A1", True), ("A2", True), ("A3", False), ("A4", False)]
    assert bag(loops.V("Account").out_e("Transaction").sum("cents"), "seed", "total") == [("A1", 600), ("A2", 400)]
    assert bag(loops.V("Account").out_e("Transaction").mean("cents"), "seed", "mean") == [("A1", 200.0), ("A2", 400.0)]


def test_empty_frontier(loops):
    none = loops.V("Account", ids="nobody").out("Transaction").out("Transaction")
    assert none.df.count() == 0 and none.count().count() == 0
    assert loops.V("User").in_("Transaction").df.count() == 0


def test_absent_property(loops):
    assert bag(loops.V("User").values("name"), "value") == [("Ann",)]
    assert bag(loops.V("User").has("name", neq("Bob")).ids(), "id") == [("U1",)]
    assert bag(loops.V("Account").properties("balance"), "id", "value") == [("A1", "1"), ("A3", "3"), ("A4", "4")]
    assert bag(loops.V("User", ids="U2").value_map("name", "age", as_map=True)
               .select(F.map_keys("value_map").alias("k")), "k") == [(["age"],)]


def test_paths(loops):
    p = loops.V("Account", ids="A1").with_path().out_e("Transaction").in_v().out_e("Transaction").in_v()
    got = sorted(tuple(r["path"]) for r in p.paths().collect())
    assert ("A1", "e1", "A1", "e1", "A1") in got and ("A1", "e3", "A2", "e4", "A3") in got and len(got) == 5
    assert sorted(tuple(r["path"]) for r in p.simple_path().paths().collect()) == [
        ("A1", "e2", "A2", "e4", "A3"), ("A1", "e3", "A2", "e4", "A3")]
    v = loops.V("Account", ids="A2").with_path().out("Transaction")
    assert [r["path"] for r in v.paths().collect()] == [["A2", "A3"]]


def test_repeat_drops_dead_ends(loops):
    two = loops.V("Account").repeat(lambda f: f.out("Transaction"), 2)
    assert bag(two.ids(), "seed", "id") == [("A1", "A1"), ("A1", "A2"), ("A1", "A2"), ("A1", "A3"), ("A1", "A3")]
    emitted = loops.V("Account", ids="A2").repeat(lambda f: f.out("Transaction"), 2, emit=True)
    assert bag(emitted.ids(), "id") == [("A3",)]


def test_has_label_prunes_and_mixed_ends(loops):
    f = loops.V("Account", ids="A1").both().has_label("User")
    assert bag(f.ids(), "id", "label") == [("U1", "User")]
    plan = f.df._jdf.queryExecution().optimizedPlan().toString()
    assert "cents" not in plan and "amount" not in plan
    assert bag(loops.V("User", ids="U1").out("owns").in_e().out_v().has_label("User").ids(), "id") == [("U1",), ("U1",)]


def test_unknown_endpoint_labels_fall_back_to_a_join(spark, loops):
    g = PropertyGraph(loops.vertices, tuple(EdgeTable(t.label, t.df) for t in loops.edges))
    assert bag(g.V("Account", ids="A1").both().has_label("User").ids(), "id") == [("U1",)]


def test_goto_and_tags(spark, loops):
    targets = spark.createDataFrame([("U1", "A4"), ("U2", "A1")], "seed string, id string")
    f = loops.V("User").as_("who", by="name").goto(targets, ["Account"]).as_("to")
    assert bag(f.select("who", "to"), "who", "to") == [("Ann", "A4")]


def test_where_on_edges_uses_the_side_entered(loops):
    f = loops.V("Account").both_e("Transaction").where(lambda e: e.other_v().has_id("A3"))
    assert bag(f.element_map(), "seed", "id") == [("A2", "e4")]


def test_hot_rows_are_marked_without_a_shuffle(spark, loops):
    hot = skew.supernodes(loops.edge_view(["Transaction"], ()), 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = loops.with_supernodes(hot, salts=3).V("Account").out("Transaction").df
        shuffles = [x for x in hop._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x]
        assert len(shuffles) == 2 and "_ls" in shuffles[0] and "_rs" in shuffles[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    many = spark.range(skew.MARKS + 1).selectExpr("string(id) AS id").union(hot.select("id"))
    assert rows(loops.with_supernodes(many, salts=3).V("Account").out("Transaction").ids()) == rows(
        loops.V("Account").out("Transaction").ids())


def test_salted_hop_equals_plain(loops):
    hot = skew.supernodes(loops.edge_view(["Transaction"], ()), 3)
    assert rows(hot) == [("A1", 3)]
    salted = loops.with_supernodes(hot, salts=3)
    a = salted.V("Account").out("Transaction").ids()
    assert bag(a, "seed", "id") == bag(loops.V("Account").out("Transaction").ids(), "seed", "id")


def test_split_copies_numbers_every_copy(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 25)], "k string, c bigint")
    got = skew.split_copies(df, "c", "i", chunk=4)
    assert rows(got) == sorted([("a", 1)] + [("b", i) for i in range(1, 8)] + [("c", i) for i in range(1, 26)])


def test_cap_keeps_first_edges(loops):
    f = loops.V("Account", ids="A1").both_e(cap=2)
    assert bag(f.ids(), "id") == [("e1",), ("e1",)]


def random_graph(spark, seed, n=7, m=24):
    rng = random.Random(seed)
    accounts = [f"A{i}" for i in range(n)]
    hub = accounts[0]
    pick = lambda: hub if rng.random() < 0.33 else rng.choice(accounts)
    owns = [(f"U{rng.randrange(n)}" if rng.random() < .3 else f"U{i}", a) for i, a in enumerate(accounts)]
    tx = [(f"t{i:02}", pick(), pick(), rng.randrange(1, 999)) for i in range(m)]
    g = pay_graph(spark, [(f"U{i}", f"n{i}", i) for i in range(n)], [(a, 0) for a in accounts], owns, tx)
    return g, [(f"owns#{i}", s, d) for i, (s, d) in enumerate(owns)] + [(e, s, d) for e, s, d, _ in tx], owns, tx


@pytest.mark.parametrize("pattern", [("out", "both", "both"), ("out", "both", "in"), ("both", "out", "both")])
def test_paths_between_against_brute_force(spark, pattern):
    g, edges, _, _ = random_graph(spark, 5)
    step = {"out": [(s, e, d) for e, s, d in edges], "in": [(d, e, s) for e, s, d in edges]}
    step["both"] = step["out"] + step["in"]
    users = [f"U{i}" for i in range(7)]
    want = sorted((a, b, (a, e1, v1, e2, v2, e3, b)) for a, b in itertools.permutations(users, 2)
                  for k1, e1, v1 in step[pattern[0]] if k1 == a for k2, e2, v2 in step[pattern[1]] if k2 == v1
                  for k3, e3, v3 in step[pattern[2]] if k3 == v2 and v3 == b)
    pairs = spark.createDataFrame(list(itertools.product(users, users)), "a string, b string")
    got = sorted((r["a"], r["b"], tuple(r["path"])) for r in payments.paths_between(g, pairs, pattern).collect())
    assert want and got == want


def test_walk_counts_against_forward_walk(spark):
    g, _, _, _ = random_graph(spark, 9)
    e = g.edge_view(["Transaction"], ())
    for depth in (1, 2, 3):
        forward = g.V("Account").repeat(lambda f: f.out("Transaction").bulk(), depth).count()
        back = messages.total_per_seed(g.V("Account").df.select("seed"), messages.walk_counts(e, depth), ["n"])
        assert rows(forward, "seed", "n") == rows(back, "seed", "n")


def test_neighbourhood_against_brute_force(spark):
    g, edges, _, _ = random_graph(spark, 3)
    inc = {}
    for e, s, d in edges:
        inc.setdefault(s, []).append((e, 0, d))
        inc.setdefault(d, []).append((e, 1, s))
    inc = {k: sorted(v)[:3] for k, v in inc.items()}

    def walk(path, depth):
        if depth == 0:
            yield tuple(path)
            return
        for e, _, far in inc.get(path[-1], []):
            if len({*path, e, far}) == len(path) + 2:
                yield from walk([*path, e, far], depth - 1)

    users = [f"U{i}" for i in range(7)]
    want = sorted((u, p) for u in users for p in sorted(walk([u], 3))[:4])
    seeds = g.vertices["User"].select(F.col("id").alias("seed"))
    f = orders.neighbourhood(g, seeds, "User", 3, per_hop=3, max_paths=4)
    assert sorted((r["seed"], tuple(r["path"])) for r in f.paths().collect()) == want


def test_smallest_walks_grow_as_prefixes(spark, monkeypatch):
    """A hub with a third of all edges, dead ends first in id order: widened until nothing is missing."""
    edges = [(f"e{i:04d}", "HUB" if i % 3 == 0 else f"U{i % 9}", f"L{i}" if i < 200 else f"U{i * 5 % 9}") for i in range(300)]
    g = PropertyGraph({"U": spark.createDataFrame([("HUB",), *((f"U{i}",) for i in range(9))], "id string")},
                      (EdgeTable("x", spark.createDataFrame(edges, "eid string, src string, dst string"), "U", "U"),))
    inc = {}
    for e, s, d in edges:
        inc.setdefault(s, []).append((e, d))
        inc.setdefault(d, []).append((e, s))

    def walk(path, depth):
        if depth == 0:
            yield tuple(path)
            return
        for e, far in inc.get(path[-1], []):
            if len({*path, e, far}) == len(path) + 2:
                yield from walk([*path, e, far], depth - 1)

    sizes = []
    real = orders.materialize
    monkeypatch.setattr(orders, "materialize", lambda df, name, **o: (sizes.append((name, (t := real(df, name, **o)))), t)[1])
    seeds = ["U1", "U4", "L3", "nobody"]
    df = spark.createDataFrame([(s,) for s in seeds], "seed string")
    for depth, k in ((2, 3), (3, 5)):
        sizes.clear()
        want = sorted((s, p) for s in seeds for p in sorted(walk([s], depth))[:k])
        got = orders.smallest_walks(g, df, "U", depth, k).paths().collect()
        assert sorted((r["seed"], tuple(r["path"])) for r in got) == want
        first = next(t for name, t in sizes if name == "walks-edges")
        assert max(r["count"] for r in first.groupBy("seed").count().collect()) <= k * (k + 1)
        total = orders.first_walks(g, df, "U", depth, k).collect()
        assert [(r["seed"], tuple(r["path"])) for r in total] == sorted(
            (s, p) for s in seeds for p in walk([s], depth))[:k]


def test_where_sees_paths_and_remembered_values(loops):
    f = loops.V("User").as_("who").with_path().out("owns")
    ahead = f.where(lambda x: x.out("Transaction").simple_path())
    assert bag(ahead.ids(), "seed", "id") == [("U1", "A1"), ("U2", "A2")]
    back = f.out("Transaction").where(lambda x: x.in_("Transaction").simple_path())
    assert bag(back.ids(), "id") == []
    named = f.where(lambda x: x.out("Transaction").as_("there").select("who", "there"))
    assert bag(named.ids(), "seed", "id") == [("U1", "A1"), ("U2", "A2")]
    edges = f.out_e("Transaction").where(lambda e: e.in_v().simple_path())
    assert bag(edges.ids(), "id") == [("e2",), ("e3",), ("e4",)]


def test_dedup_keeps_the_smallest_path(loops):
    f = loops.V("User").as_("who").with_path().out_e("owns").in_v().out_e("Transaction").in_v()
    least = {}
    for r in f.df.collect():
        key = (r["seed"], r["cur"])
        least[key] = min(least.get(key, r["path"]), r["path"])
    once = f.dedup()
    assert {(r["seed"], r["cur"]): r["path"] for r in once.df.collect()} == least
    assert bag(once.select("who"), "seed", "who") == sorted((s, s) for s, _ in least)


@pytest.mark.parametrize("margin", [0.02, 0.1])
@pytest.mark.parametrize("values", [[5], [3, 3, 3, 3], list(range(1000)), [0] * 400 + list(range(200)),
                                    [int(1.3 ** i) for i in range(40)] * 3])
def test_values_at_ranks(spark, monkeypatch, values, margin):
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
    order, n = sorted(values, reverse=True), len(values)
    ranks = sorted({1, n // 4 + 1, n // 2 + 1, n, n + 1})
    assert quantiles.values_at_ranks(df, "v", ranks, n) == [order[r - 1] if r <= n else None for r in ranks]


def test_fenced_mean_against_brute_force(spark):
    import math
    rng = random.Random(1)
    vals = [rng.randrange(1000) for _ in range(57)] + [90_000, 120_000]
    df = spark.createDataFrame([(v,) for v in vals], "t bigint")
    a = sorted(vals, reverse=True)
    q3, q1 = a[math.floor(len(a) * .25)], a[math.ceil(len(a) * .75)]
    kept = [x for x in a if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    row = payments.fenced_stats(df, "t").first()
    assert (row["q1"], row["q3"]) == (q1, q3) and row["mean"] == pytest.approx(sum(kept) / len(kept))


def test_pull_splits_a_hub(spark):
    """A vertex with two thirds of all edges: the join of ``pull`` must not end in one task."""
    from hopframe.operators.messages import pull

    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.range(0, 300_000, 1, 8).select(
            F.concat(F.lit("v"), F.col("id") % 5000).alias("src"),
            F.when(F.col("id") % 3 > 0, F.lit("hub")).otherwise(F.concat(F.lit("v"), F.col("id") % 7000)).alias("dst"))
        values = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        out = pull(edges, values, ["n"])
        total = out.agg(F.sum("n").cast("double")).first()[0]
        per = edges.groupBy("dst").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]
        assert total == per
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_first_rows_of_a_hub_for_any_k(spark):
    df = spark.range(0, 20_000, 1, 6).select(
        F.when(F.col("id") % 4 > 0, F.lit("hub")).otherwise(F.concat(F.lit("v"), F.col("id") % 50)).alias("key"),
        (F.col("id") * 7919 % 20_011).alias("o"), "id")
    for k in (3, 1500):
        got = rows(skew.first_per(df, "key", [F.col("o").desc(), F.col("id")], k, "id"), "key", "_rn", "id")
        by_key = {}
        for key, o, i in df.collect():
            by_key.setdefault(key, []).append((-o, i))
        assert got == sorted((key, n + 1, i) for key, v in by_key.items() for n, (_, i) in enumerate(sorted(v)[:k]))


def test_walks_of_many_seeds_are_ranked_and_listed_by_many_tasks(spark):
    seeds = spark.range(0, 200, 1, 1).select(F.concat(F.lit("c"), F.col("id")).alias("id"))
    edges = seeds.select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(f"r{i}") for i in range(4)])).alias("dst"))
    edges = edges.select(F.concat_ws(">", "src", "dst").alias("eid"), "src", "dst")
    ends = spark.createDataFrame([(f"r{i}",) for i in range(4)], "id string")
    g = PropertyGraph({"C": seeds, "R": ends}, (EdgeTable("e", edges, "C", "R"),))
    found = orders.neighbourhood(g, seeds.select(F.col("id").alias("seed")), "C", 1, per_hop=5, max_paths=3).paths()
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    elements = orders.path_elements(found)
    assert elements.select(F.spark_partition_id()).distinct().count() > 1
    assert rows(elements) == sorted((f"c{i}", k, x) for i in range(200) for k, x in [
        ("v", f"c{i}"), *[(k, x) for r in range(3) for k, x in (("e", f"c{i}>r{r}"), ("v", f"r{r}"))]])
