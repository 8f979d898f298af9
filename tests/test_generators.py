import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hopframe.functions.rng import long_between, uniform
from hopframe.generators import degrees, ego, food, payments, scale_free, values
from hopframe.plans import degree as dstats

CONFIG = {
    "vertices": {"A": {"percent": 33, "properties": {
        "i": {"type": "Int", "min": -5, "max": 5}, "l": {"type": "Long", "min": 20, "max": 2 ** 63 - 1},
        "d": {"type": "Double", "min": 0, "max": 2.8}, "b": {"type": "Bool", "true_chance": 15},
        "s": {"type": "String", "min_size": 2, "max_size": 6, "allowed_chars": "ab"},
        "t": {"type": "Date", "min_year": 1999, "max_year": 2001},
        "x": {"type": "List", "min_length": 0, "max_length": 3, "element": {"type": "Int", "min": 1, "max": 2}}}},
        "B": {"percent": 67, "properties": {}}},
    "edges": {"TO": {"A_TO_B": {"from": "A", "to": "B", "properties": {}},
                     "A_TO_A": {"from": "A", "to": "A", "properties": {"w": {"type": "Int", "min": 1, "max": 9}}}}}}


def test_scale_free_invariants(spark):
    n = 1000
    g = scale_free.generate(spark, n, CONFIG, gamma=1.6, seed=3)
    assert g.vertices["A"].count() == 330 and g.vertices["B"].count() == 670
    assert g.vertices["B"].agg(F.min("id")).first()[0] == "B" + f"{330:019d}"
    for t in g.edges:
        e = t.df
        assert e.groupBy("src", "dst").count().filter("count > 1").count() == 0
        assert e.join(g.vertices[t.dst_label], e.dst == F.col("id"), "left_anti").count() == 0
        if t.src_label == t.dst_label:
            assert e.filter("src = dst").count() == 0
        assert e.groupBy("src").count().agg(F.max("count")).first()[0] <= 329
    out = g.edge_view(None, ()).groupBy(F.col("src").alias("_s")).count()
    bad = g.vertices["A"].join(out, F.col("id") == F.col("_s"), "left").filter(
        F.coalesce("count", F.lit(0)) != F.col("outDegree"))
    assert bad.count() == 0 and g.vertices["B"].agg(F.max("outDegree")).first()[0] == 0
    a = g.vertices["A"]
    r = a.agg(F.min("i"), F.max("i"), F.min("l"), F.min("d"), F.max("d"), F.avg(F.col("b").cast("int")),
              F.min(F.length("s")), F.max(F.length("s")), F.min("t"), F.max("t"), F.min(F.size("x")),
              F.max(F.size("x"))).first()
    assert (r[0], r[1]) == (-5, 5) and r[2] >= 20 and 0 <= r[3] and r[4] <= 2.8 and 0.05 < r[5] < 0.3
    assert (r[6], r[7], r[10], r[11]) == (2, 6, 0, 3) and str(r[8])[:4] >= "1999" and str(r[9])[:4] <= "2001"
    kinds = {"i": "integer", "d": "double", "b": "boolean", "s": "string", "t": "date", "x": "list"}
    assert {(c["column"], c["bad"]) for c in values.check_values(a, kinds).collect()} == {(k, 0) for k in kinds}


def test_same_seed_same_rows_under_other_partitioning(spark):
    a = scale_free.generate(spark, 300, CONFIG, seed=3, partitions=1)
    b = scale_free.generate(spark, 300, CONFIG, seed=3, partitions=7)
    c = scale_free.generate(spark, 300, CONFIG, seed=4)
    assert rows(a.edge_view()) == rows(b.edge_view()) != rows(c.edge_view())
    assert rows(a.vertices["A"].drop("x")) == rows(b.vertices["A"].drop("x"))


def test_targets_cover_the_pool_and_hubs_are_cut(spark, monkeypatch):
    monkeypatch.setattr(scale_free, "CHUNK", 16)
    for pool in (1, 2, 7, 64, 97):
        src = spark.range(20).select(F.col("id").alias("n"), F.lit(pool).cast("bigint").alias("k"))
        t = scale_free.expand(src, "k", "i").select("n", scale_free.distinct_targets(F.col("n"), F.col("i"), pool, 1, "e")
                                                    .alias("t"))
        assert t.count() == 20 * pool and t.distinct().count() == 20 * pool
        assert tuple(t.agg(F.min("t"), F.max("t")).first()) == (0, pool - 1)


def test_no_shuffle_in_generation(spark):
    g = scale_free.generate(spark, 1000, CONFIG)
    assert "Exchange" not in g.edge_view()._jdf.queryExecution().executedPlan().toString()


def _one_file(spark, n):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("n"))


def _tasks(df):
    return df.select(F.spark_partition_id()).distinct().count()


def _plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_targets_of_sources_in_one_file_are_made_by_many_tasks(spark):
    few = _one_file(spark, 400)
    ranges = {"C": (0, 400), "P": (400, 500)}
    spread = scale_free.target_table(scale_free.numbered(spark, few), "buys", "C", "P", ranges, 2.0, 42)
    assert _tasks(spread) > 1
    assert rows(spread) == rows(scale_free.target_table(few, "buys", "C", "P", ranges, 2.0, 42))


def test_chunks_of_hubs_are_not_merged(spark, monkeypatch):
    monkeypatch.setattr(scale_free, "CHUNK", 16)
    hub = spark.range(0, 1, 1, 1).select(F.col("id").alias("n"), F.lit(1000).cast("bigint").alias("k"))
    e = scale_free.expand(hub, "k", "i")
    assert _tasks(e) > 1 and rows(e, "i") == [(i,) for i in range(1000)]


def test_degrees_and_walks_hash_their_row_once(spark):
    few = _one_file(spark, 4)
    degs = few.select(degrees.zipf_degree(uniform(1, "s", F.col("n")), 2.0, 100).alias("k"))
    assert _plan(degs).count("xxhash64") == 1
    walk = few.select(scale_free.distinct_targets(F.col("n"), F.lit(3), 97, 1, "e").alias("t"))
    assert _plan(walk).count("xxhash64") == 2  # the first step and one inside the loop


def test_payees_are_drawn_once_by_many_tasks(spark):
    few = _one_file(spark, 40)
    tx = payments.hub_transfers(scale_free.numbered(spark, few), 300)
    assert _tasks(tx) > 1 and rows(tx) == rows(payments.hub_transfers(few, 300))
    lines = _plan(tx).split("\n")
    assert min(i for i, x in enumerate(lines) if "payee/permute" in x) > min(i for i, x in enumerate(lines) if "explode" in x)


def test_egos_of_one_file_are_made_by_many_tasks(spark):
    from hopframe.catalog import CLUB_GRAPH

    few = _one_file(spark, 60)
    g, same = ego.generate(spark, few, CLUB_GRAPH, 30.0), ego.generate(spark, 60, CLUB_GRAPH, 30.0)
    assert all(_tasks(t.df) > 4 for t in g.edges)
    assert rows(g.edge_view(None, ()), "eid") == rows(same.edge_view(None, ()), "eid")


@pytest.fixture(scope="module")
def two_tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, key, n in (("customer", "c_custkey", 300), ("part", "p_partkey", 90)):
        spark.range(0, n, 1, 1).select(F.col("id").alias(key)).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_inverted_edges_are_compared_in_a_stated_number_of_tasks(spark, two_tables):
    from hopframe.catalog import QUERIES

    df = QUERIES["g10_inverted"](spark, two_tables)
    dealt = [x for x in _plan(df, "executedPlan").split("\n") if "hashpartitioning(src" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)
    assert rows(df) == [(0,)]


@pytest.mark.parametrize("name", ["g3_targets", "g3_target_checks"])
def test_target_queries_spread_their_sources(spark, two_tables, name):
    from hopframe.catalog import QUERIES

    df = QUERIES[name](spark, two_tables)
    assert "RoundRobinPartitioning" in _plan(df, "executedPlan")
    if name == "g3_target_checks":
        assert rows(df) == [(0, 0, 0)]


@pytest.mark.parametrize("change", [
    lambda c: c["vertices"]["A"].update(percent=30), lambda c: c["edges"]["TO"]["A_TO_B"].update(to="Z"),
    lambda c: c["vertices"]["A"]["properties"].update(i={"type": "Int", "min": 6, "max": 5}),
    lambda c: c["vertices"]["A"]["properties"].update(i={"type": "Int", "min": 0, "max": 2 ** 31}),
    lambda c: c["vertices"]["A"]["properties"].update(i={"type": "Map"}),
    lambda c: c["vertices"]["A"]["properties"].update(x={"type": "List", "min_length": 0, "max_length": 1,
                                                         "element": {"type": "List"}})])
def test_bad_configs(change):
    import copy
    c = copy.deepcopy(CONFIG)
    change(c)
    with pytest.raises(ValueError):
        scale_free.parse_config(c)


def test_long_range_is_exact(spark):
    df = spark.range(5000).select(long_between(1, "l", -(2 ** 63), 2 ** 63 - 1, F.col("id")).alias("v"),
                                  long_between(1, "m", -3, 3, F.col("id")).alias("w"))
    r = df.agg(F.min("v"), F.max("v"), F.min("w"), F.max("w"), F.countDistinct("v")).first()
    for low, high in ((-(2 ** 63), 0), (-10, 2 ** 63 - 1), (2 ** 62, 2 ** 63 - 1)):
        some = spark.range(2000).select(long_between(3, "x", low, high, F.col("id")).alias("v"))
        a, b, odd = some.agg(F.min("v"), F.max("v"), F.avg(F.abs(F.col("v") % 2))).first()
        assert low <= a < low + (high - low) / 50 and high - (high - low) / 50 < b <= high and 0.4 < odd < 0.6
    assert r[0] < -2 ** 62 and r[1] > 2 ** 62 and (r[2], r[3]) == (-3, 3) and r[4] == 5000


def test_uniform_is_uniform(spark):
    for algo in ("xxhash64", "md5"):
        r = spark.range(20000).select(uniform(9, "u", F.col("id"), algo=algo).alias("u")).agg(
            F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).first()
        assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - math.sqrt(1 / 12)) < 0.01 and r[2] >= 0 and r[3] < 1


@pytest.mark.parametrize("spec,mean,sd", [
    ({"dist": "fixed", "value": 2.5}, 2, 0), ({"dist": "fixed", "value": 2.5, "round": "ceil"}, 3, 0),
    ({"dist": "fixed", "value": 2.5, "round": "floor"}, 2, 0),
    ({"dist": "uniform", "low": 0, "high": 10}, 5, 2.9), ({"dist": "uniform", "median": 6, "sigma": 3}, 6, 1.75),
    ({"dist": "normal", "mean": 20, "sigma": 4}, 20, 4), ({"dist": "poisson", "lam": 6.44}, 6.44, 2.54),
    ({"dist": "poisson", "lam": 0}, 0, 0), ({"dist": "poisson", "lambda": 900}, 900, 30),
    ({"dist": "lognormal", "median": 6, "sigma": 0.3}, 6 * math.exp(0.045), 1.9)])
def test_degree_distributions(spark, spec, mean, sd):
    df = spark.range(20000).select(degrees.degree(spec, 7, "d", F.col("id")).alias("d"))
    r = df.agg(F.avg("d"), F.stddev("d"), F.min("d")).first()
    assert abs(r[0] - mean) < 0.12 + sd / 50 and abs(r[1] - sd) < 0.15 + sd / 50 and r[2] >= 0


def test_degree_defaults(spark):
    """Settings left out mean what they mean in the reference: uniform 1 +- 0.5, normal (1, 1), Poisson 1, median 1."""
    k = F.col("id")

    def same(spec, full):
        a, b = (degrees.degree(x, 7, "d", k) for x in (spec, full))
        assert spark.range(500).filter(a != b).count() == 0

    same({}, {"dist": "uniform", "median": 1, "sigma": 0.5})
    same({"dist": "UNIFORM", "low": 4}, {"dist": "uniform", "median": 1, "sigma": 0.5})
    same({"dist": "normal", "mean": 9}, {"dist": "normal", "mean": 9, "sigma": 1})
    same({"dist": "normal", "sigma": 2}, {"dist": "normal", "mean": 1, "sigma": 2})
    same({"dist": "poisson"}, {"dist": "poisson", "lambda": 1})
    same({"dist": "poisson", "lambda": 4}, {"dist": "poisson", "lam": 4})
    same({"dist": "lognormal", "meanlog": 2}, {"dist": "lognormal", "meanlog": 2, "sigma": 1})
    same({"dist": "lognormal"}, {"dist": "lognormal", "median": 1, "sigma": 1})


def test_degree_clip_and_errors(spark):
    df = spark.range(2000).select(degrees.degree({"dist": "normal", "mean": 3, "sigma": 5, "min": 1, "max": 6}, 7, "d",
                                                 F.col("id")).alias("d"))
    assert tuple(df.agg(F.min("d"), F.max("d")).first()) == (1, 6)
    for bad in ({"dist": "zeta"}, {"dist": "uniform", "low": 3, "high": 1}, {"dist": "normal", "mean": 1, "sigma": -1}, {"dist": "fixed"}, {"dist": "lognormal", "median": 0, "sigma": 1},
                {"dist": "fixed", "value": 1, "round": "up"}, {"dist": "fixed", "value": 1, "min": 4, "max": 3}):
        with pytest.raises(ValueError):
            degrees.degree(bad, 1, "d", F.lit(1))
    with pytest.raises(ValueError):
        degrees.zipf_degree(F.lit(0.5), 1.0, 10)


EGO = {"EgoNode": {"label": "Ego", "connections": {"Mid": {"degree": {"dist": "fixed", "value": 3}}}},
       "AlterNodes": {"Mid": {"label": "Mid", "connections": {
           "Leaf": {"degree": {"dist": "fixed", "value": 2},
                    "properties": {"w": {"generator": "pyint(min_value=1, max_value=99)", "type": "int",
                                         "prefer_unique": True}}}}},
           "Leaf": {"label": "Leaf", "properties": {"s": {"generator": "pystr(min_chars=3, max_chars=5)",
                                                          "type": "string"}}}}}


def test_ego_network(spark):
    g = ego.generate(spark, 200, EGO, share_percent=50, seed=1)
    assert {k: v.count() for k, v in g.vertices.items()} == {"Ego": 200, "Mid": 600, "Leaf": 1200}
    assert g.vertex_view(None, ()).select("id").distinct().count() == 2000
    per = {(t.label, t.src_label): t.df.count() for t in g.edges}
    assert per[("REL_EGO_TO_MID", "Ego")] == 600 and per[("REL_MID_TO_LEAF", "Mid")] == 1200
    assert 500 < per[("REL_EGO_TO_LEAF", "Ego")] < 700
    share = [t.df for t in g.edges if t.label == "REL_EGO_TO_LEAF"][0]
    tree = [t.df for t in g.edges if t.label == "REL_MID_TO_LEAF"][0]
    joined = share.alias("a").join(tree.alias("b"), F.col("a.dst") == F.col("b.dst"))
    assert joined.filter("a.w <> b.w").count() == 0 and joined.count() == share.count()
    flipped = ego.generate(spark, 200, EGO, share_percent=50, invert=True, seed=1)
    assert {t.label for t in flipped.edges} == {"REL_MID_TO_EGO", "REL_LEAF_TO_MID", "REL_LEAF_TO_EGO"}
    assert g.vertices["Leaf"].select("s").distinct().count() <= 20
    with pytest.raises(ValueError):
        ego.check_config({"EgoNode": {"label": "E", "connections": {}}, "AlterNodes": {"M": {"label": "M"}}})


def test_providers(spark):
    assert values.provider_call("pyint(min_value=-1, max_value=5)") == ("pyint", [], {"min_value": -1, "max_value": 5})
    assert values.provider_call("pylist(nb_elements=3, allowed_types=[str])")[2]["allowed_types"] == ["str"]
    for bad in ("a.b()", "x", "f(**k)", "f(g())"):
        with pytest.raises(ValueError):
            values.provider_call(bad)
    values.register_provider("percent", lambda u: F.floor(u * 100))
    specs = {"p": {"generator": "percent()", "type": "int"}, "b": {"generator": "pybool(80)", "type": "bool"},
             "l": {"generator": "pylist(nb_elements=4, allowed_types=[int])", "type": "list"},
             "u": {"generator": "pyint(min_value=0, max_value=999999999)", "type": "long", "prefer_unique": True}}
    df = spark.range(3000).select(*values.provided_columns(specs, 1, "s", F.col("id")))
    r = df.agg(F.countDistinct("p"), F.min(F.size("l")), F.countDistinct("u"), F.max("p")).first()
    assert r[0] <= 20 and r[1] == 4 and r[2] > 2950 and r[3] < 100


@pytest.mark.parametrize("nc,nr,nd,lo,hi", [(3, 2, 1, 1, 1), (50, 5, 4, 1, 5)])
def test_food_dataset(spark, nc, nr, nd, lo, hi):
    g = food.generate(spark, nc, nr, nd, lo, hi)
    assert g.vertices["CustomerProfile"].count() == nc and g.vertices["DeliveryAddress"].count() == nc
    orders = g.vertices["FoodOrder"].count()
    assert lo * nc <= orders <= hi * nc and g.vertices["FoodOrder"].select("id").distinct().count() == orders
    per = {t.label: t.df.count() for t in g.edges}
    assert per["HAS_ADDRESS"] == nc and per["PLACED"] == per["ORDERED_FROM"] == per["DELIVERED_BY"] == orders
    assert orders <= per["CONTAINS"] <= 3 * orders and per["RATED"] <= orders
    assert 5 * nr <= g.vertices["MenuItem"].count() <= 10 * nr
    for t in g.edges:
        for end, label in (("src", t.src_label), ("dst", t.dst_label)):
            assert t.df.join(g.vertices[label], F.col(end) == F.col("id"), "left_anti").count() == 0
    menu = g.edge_view(["CONTAINS"], ()).join(g.edge_view(["ORDERED_FROM"], ()).select(
        F.col("src").alias("o"), F.col("dst").alias("r")), F.col("src") == F.col("o"))
    assert menu.filter(~F.col("dst").contains(F.col("r"))).count() == 0


def test_payments_dataset(spark):
    g = payments.generate(spark, 40, hubs=2)
    tx = g.edge_view(["Transaction"], ["amount"])
    small = tx.filter(F.col("eid").startswith("Transaction"))
    assert small.filter("src = dst").count() == 0
    k = small.groupBy("src").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert 7 <= k[0] and k[1] <= 14 and k[2] == 40
    hub = tx.filter(F.col("eid").startswith("Hub")).groupBy("src", "dst").count()
    r = hub.groupBy("src").agg(F.count("*").alias("t"), F.min("count").alias("a"), F.max("count").alias("b")).collect()
    assert {x["src"] for x in r} == {"A41", "A42"} and all(5 <= x["t"] <= 8 and 9 <= x["a"] and x["b"] <= 25 for x in r)


def test_power_law_recovers_gamma(spark):
    for gamma in (2.2, 2.8):
        degs = scale_free.out_degrees(spark.range(40000).select(F.col("id").alias("n")), gamma, 40000, 5, "e")
        fit = dstats.fit_verdict(dstats.histogram(degs)).first()
        assert abs(fit["alpha"] - gamma) < 0.1 and fit["ks"] < 0.02 and fit["verdict"] != "log_normal"
    flat = spark.range(40000).select(degrees.degree({"dist": "lognormal", "median": 30, "sigma": 0.4}, 1, "d", F.col("id"))
                                     .alias("degree"))
    assert dstats.compare_lognormal(dstats.histogram(flat), 1.5, 5)["verdict"] == "log_normal"


def test_fit_is_the_best_of_all_starts(spark):
    """Every start tried one by one, with plain sums."""
    import numpy as np
    rng = np.random.default_rng(3)
    k = np.unique(np.concatenate((np.arange(1, 40), rng.integers(40, 5000, 60))))
    n = np.maximum(1, (20000 * k ** -2.1 * rng.uniform(0.7, 1.3, len(k))).astype(int))
    hist = spark.createDataFrame([(int(a), int(b)) for a, b in zip(k, n)], "degree bigint, n bigint").repartition(3)
    tried = []
    for i in range(len(k) - 1):
        kk, nn = k[i:].astype(float), n[i:].astype(float)
        a = float(dstats.best_alphas([nn.sum()], [(nn * np.log(kk)).sum()], [kk[0]])[0])
        grid = [float(-nn.sum() * np.log(dstats.zeta_tail(x, kk[0])) - x * (nn * np.log(kk)).sum()) for x in (a - .01, a, a + .01)]
        assert grid[1] >= max(grid)
        seen = np.cumsum(nn) / nn.sum()
        theory = 1 - np.array([dstats.zeta_tail(a, x + 1) for x in kk]) / dstats.zeta_tail(a, kk[0])
        below = 1 - np.array([dstats.zeta_tail(a, x) for x in kk]) / dstats.zeta_tail(a, kk[0])
        tried.append((max(np.abs(seen - theory).max(), np.abs(np.concatenate(([0], seen[:-1])) - below).max()), int(kk[0]), a, int(nn.sum())))
    want = min(tried)
    got = dstats.power_law_fit(hist, at_once=4).first()
    assert (got["xmin"], got["n_tail"]) == (want[1], want[3])
    assert got["ks"] == pytest.approx(want[0], abs=1e-9) and got["alpha"] == pytest.approx(want[2], abs=1e-6)


def test_zeta_tail():
    assert abs(dstats.zeta_tail(2.0, 1.0) - math.pi ** 2 / 6) < 1e-11
    assert abs(dstats.zeta_tail(4.0, 1.0) - math.pi ** 4 / 90) < 1e-12
    assert abs(float(dstats.log_zeta(2.5, 7.0)) - math.log(dstats.zeta_tail(2.5, 7.0))) < 1e-12
    assert abs(float(dstats.log_zeta(900.0, 50.0)) + 900 * math.log(50)) < 1e-6
    assert abs(dstats.zeta_tail(2.5, 3.0) - (dstats.zeta_tail(2.5, 1.0) - 1 - 2 ** -2.5)) < 1e-11


def test_degree_stats_and_bins(spark):
    degs = spark.createDataFrame([(f"v{i}", d) for i, d in enumerate([0, 0, 1, 2, 11, 12, 40, 1000])], "id string, degree bigint")
    h = dstats.histogram(degs)
    r = dstats.stats(h).first()
    assert (r["vertices"], r["edges"], r["max_degree"], r["min_degree"], r["median_degree"]) == (8, 1066, 1000, 0, 6.5)
    b = dstats.binned(h).collect()
    assert sum(x["vertices"] for x in b) == 4 and max(x["bin_end"] for x in b) == 1000
    assert sum(x["percent"] for x in dstats.binned(h, "linear").collect()) == pytest.approx(100)
    assert dstats.binned(h.filter("degree < 10")).count() == 0
