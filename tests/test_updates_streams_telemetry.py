import pytest
from conftest import rows
from pyspark.sql import functions as F

from hopframe.functions import scalars as C
from hopframe.model import EdgeTable, PropertyGraph
from hopframe.operators import update
from hopframe.plans import fraud, orders, telemetry
from hopframe.streaming import jobs


@pytest.fixture(scope="module")
def food(spark):
    def df(data, schema):
        return spark.createDataFrame(data, schema)

    return PropertyGraph(
        {"CustomerProfile": df([("c1", "Ann"), ("c2", "Bo")], "id string, name string"),
         "Driver": df([("d1",), ("d2",)], "id string"), "MenuItem": df([("m1", "Soup", 10.99)], "id string, name string, price double"),
         "FoodOrder": df([("o1", 100, "A"), ("o2", 200, None), ("o3", 200, "C")], "id string, order_date bigint, status string")},
        (EdgeTable("PLACED", df([("p1", "c1", "o1"), ("p2", "c1", "o2"), ("p3", "c1", "o3")],
                                "eid string, src string, dst string"), "CustomerProfile", "FoodOrder"),
         EdgeTable("CONTAINS", df([("k1", "o1", "m1", 2)], "eid string, src string, dst string, qty int"),
                   "FoodOrder", "MenuItem"),
         EdgeTable("DELIVERED_BY", df([("x1", "o1", "d1")], "eid string, src string, dst string"), "FoodOrder", "Driver")))


def test_order_lookups(food):
    assert rows(orders.latest_order(food), "customer", "order_id", "status") == [("c1", "o2", "Unknown")]
    recent = orders.recent_orders(food, 2)
    assert rows(recent, "rank", "order_id") == [(1, "o2"), (2, "o3")]
    items = {r["order_id"]: (r["status"], r["item"], r["qty"]) for r in orders.order_items(food).collect()}
    assert items == {"o1": ("A", "Soup", 2), "o2": ("Unknown", None, None), "o3": ("C", None, None)}


def test_assign_driver(spark, food):
    a = spark.createDataFrame([("o1", "d2", 5), ("o2", "nobody", 5), ("zz", "d1", 5)],
                              "order_id string, driver_id string, assigned_date bigint")
    kept = update.assign_drivers(food, a)
    assert rows(kept.edge_view(["DELIVERED_BY"], ()), "src", "dst") == [("o1", "d1"), ("o1", "d2")]
    assert {r["id"]: r["status"] for r in kept.vertices["FoodOrder"].collect()} == {
        "o1": "ASSIGNED_TO_DRIVER", "o2": None, "o3": "C"}
    assert rows(update.assign_drivers(food, a, True).edge_view(["DELIVERED_BY"], ()), "src", "dst") == [("o1", "d2")]


def test_add_set_drop(spark, food):
    g = update.add_vertices(food, "Driver", spark.createDataFrame([("d3", 4.5)], "id string, rating double"))
    assert g.vertices["Driver"].count() == 3 and "rating" in g.vertices["Driver"].columns
    g = update.add_edges(g, "DELIVERED_BY", spark.createDataFrame([("o2", "d3"), ("o2", "d9")], "src string, dst string"),
                         "FoodOrder", "Driver")
    assert rows(g.edge_view(["DELIVERED_BY"], ()), "src", "dst") == [("o1", "d1"), ("o2", "d3")]
    g = update.set_property(g, "Driver", spark.createDataFrame([("d1", 3.0), ("d1", 2.0)], "id string, rating double"), "rating")
    assert {r["id"]: r["rating"] for r in g.vertices["Driver"].collect()} == {"d1": 3.0, "d2": None, "d3": 4.5}
    g = update.drop_vertices(g, spark.createDataFrame([("o1",), ("d3",)], "id string"))
    assert g.edge_view(["DELIVERED_BY", "CONTAINS"], ()).count() == 0 and g.vertices["FoodOrder"].count() == 2


def test_bucket_quantile(spark):
    inf = float("inf")
    b = spark.createDataFrame(
        [("a", 1.0, 10), ("a", 2.0, 20), ("a", inf, 20), ("b", 1.0, 0), ("b", 2.0, 0), ("b", inf, 0),
         ("c", 1.0, 0), ("c", 2.0, 1), ("c", inf, 100), ("d", -1.0, 5), ("d", 1.0, 10), ("d", inf, 10)],
        "s string, le double, count bigint")
    got = dict(rows(telemetry.bucket_quantile(b, ["s"], 0.5).fillna(-99.0)))
    assert got == {"a": 1.0, "b": -99.0, "c": 2.0, "d": -1.0}
    assert dict(rows(telemetry.bucket_quantile(b.filter("s = 'a'"), ["s"], 0.95)))["a"] == pytest.approx(1.9)
    assert dict(rows(telemetry.heat_map(b)))[1.0] == 20


def test_scalars(spark):
    df = spark.createDataFrame([("2024-02-29", ["x"]), ("2023-02-29", ["x", "y"]), ("2024-1-1", []), (None, None)],
                               "d string, l array<string>")
    r = df.select(C.date_to_epoch_ms(F.col("d")), C.date_to_epoch_s(F.col("d")), C.is_iso_date(F.col("d")),
                  C.unwrap_single(F.col("l")), C.or_unknown(F.col("d"))).collect()
    assert tuple(r[0]) == (1709164800000, 1709164800, True, "x", "2024-02-29")
    assert (r[1][0], r[1][2], r[1][3]) == (None, False, None) and r[2][2] is False
    assert (r[3][0], r[3][2], r[3][4]) == (None, False, "Unknown")
    t = spark.range(1).select(C.epoch_ms_to_ts(F.lit(1709164800123)).alias("t"))
    assert str(t.select(F.col("t").cast("string")).first()[0]) == "2024-02-29 00:00:00.123"


@pytest.fixture(scope="module")
def pay(spark):
    def edge(rows_, more=""):
        return spark.createDataFrame(rows_, "eid string, src string, dst string" + more)

    return PropertyGraph(
        {"Person": spark.createDataFrame([("P1", False), ("P2", False)], "id string, fraud_flag boolean"),
         "BankAccount": spark.createDataFrame([("A1", False), ("A2", False)], "id string, fraud_block boolean"),
         "Card": spark.createDataFrame([], "id string, fraud_block boolean"),
         "VPA": spark.createDataFrame([("V1",), ("V2",), ("V3",)], "id string")},
        (EdgeTable("has_account", edge([("1", "P1", "A1"), ("2", "P2", "A2")]), "Person", "BankAccount"),
         EdgeTable("owns", edge([("3", "A1", "V1"), ("4", "A2", "V2")]), "BankAccount", "VPA"),
         EdgeTable("transaction", edge([("5", "V1", "V2", 1000), ("6", "V2", "V3", 3000)], ", cents bigint"), "VPA", "VPA")))


def test_scoring_stream_equals_batch_and_restarts(spark, pay, tmp_path):
    feed = f"{tmp_path}/feed"
    schema = "payment string, person string, vpa string, target string, cents bigint"
    spark.createDataFrame([("r1", "P1", "V1", "V2", 10), ("r2", "P1", "V1", "V3", 20)], schema).coalesce(1).write.json(feed)

    def go():
        s = spark.readStream.schema(schema).json(feed)
        jobs.score_beneficiaries(s, pay, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()

    go()
    spark.createDataFrame([("r3", "P2", "V2", "V1", 30)], schema).coalesce(1).write.mode("append").json(feed)
    go()
    got = dict(rows(spark.read.schema("payment string, status string").parquet(f"{tmp_path}/out/batch=*")))
    assert got == {"r1": "known", "r2": "second_degree", "r3": "first_time"}


def test_batches_use_the_newest_index_and_their_own_buckets(spark, pay, tmp_path):
    feed, store = f"{tmp_path}/feed", f"{tmp_path}/index"
    schema = "payment string, person string, vpa string, target string, cents bigint"
    fraud.refresh_index(pay, store)

    def go(payment):
        spark.createDataFrame([(payment, "P2", "V2", "V1", 30)], schema).coalesce(1).write.mode("append").json(feed)
        s = spark.readStream.schema(schema).json(feed)
        jobs.score_beneficiaries(s, pay, f"{tmp_path}/out", f"{tmp_path}/ck", store=store).awaitTermination()

    go("r1")
    more = spark.createDataFrame([("7", "V2", "V1", 500)], "eid string, src string, dst string, cents bigint")
    paid = pay.with_edges([*pay.edges, EdgeTable("transaction", more, "VPA", "VPA")])
    fraud.refresh_index(paid, store)
    go("r2")
    got = dict(rows(spark.read.schema("payment string, status string").parquet(f"{tmp_path}/out/batch=*")))
    assert got == {"r1": "first_time", "r2": "known"}

    n = 400
    edge = "eid string, src string, dst string"
    wide = PropertyGraph({}, (
        EdgeTable("has_account", spark.range(n).selectExpr("string(id) AS eid", "'P' || id AS src", "'A' || id AS dst")),
        EdgeTable("has_card", spark.createDataFrame([], edge)),
        EdgeTable("owns", spark.range(n).selectExpr("string(id) AS eid", "'A' || id AS src", "'V' || id AS dst")),
        EdgeTable("transaction", spark.range(5 * n).selectExpr(
            "string(id) AS eid", f"'V' || id % {n} AS src", f"'V' || id * 7 % {n} AS dst"))))
    fraud.refresh_index(wide, f"{tmp_path}/wide")
    index = fraud.newest_index(spark, f"{tmp_path}/wide")
    ten = spark.createDataFrame([(f"r{i}", f"P{i}", f"V{i + 50}") for i in range(10)],
                                "payment string, person string, target string")
    some = index.only(ten)
    for name in ("known", "into"):
        def folders(df):
            return {r[0].split("bucket=")[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}

        assert len(folders(getattr(index, name))) > 55 and len(folders(getattr(some, name))) <= 10
    assert rows(fraud.beneficiary_status(wide, ten, some)) == rows(fraud.beneficiary_status(wide, ten))


def test_open_windows_are_served_and_replays_change_nothing(spark, tmp_path):
    feed, out = f"{tmp_path}/feed", f"{tmp_path}/out"
    events = [(0, "a", 100), (30, "a", 50), (61, "a", 7), (10, "b", 1)], [(59, "a", 3), (65, "b", 2), (300, "b", 9)]

    def go(batch):
        spark.createDataFrame(batch, "m int, vpa string, cents bigint").coalesce(1).write.mode("append").json(feed)
        s = spark.readStream.schema("m int, vpa string, cents bigint").json(feed).select(
            F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)").alias("ts"), "vpa", "cents")
        jobs.upsert_windows(jobs.hourly_velocity(s, "2 hours"), out, f"{tmp_path}/ck").awaitTermination()
        return {(str(r[0])[11:13], r[1]): (r[2], r[3]) for r in jobs.current_windows(spark, out).collect()}

    assert go(events[0]) == {("00", "a"): (2, 150), ("01", "a"): (1, 7), ("00", "b"): (1, 1)}
    want = {("00", "a"): (3, 153), ("01", "a"): (1, 7), ("00", "b"): (1, 1), ("01", "b"): (1, 2), ("05", "b"): (1, 9)}
    assert go(events[1]) == want
    # A batch that is replayed overwrites its own folder.
    at = spark.read.option("basePath", out).parquet(f"{out}/batch=*").agg(F.max("batch")).first()[0]
    last = spark.read.parquet(f"{out}/batch={at}")
    spark.createDataFrame(last.collect(), last.schema).write.mode("overwrite").parquet(f"{out}/batch={at}")
    assert {(str(r[0])[11:13], r[1]): (r[2], r[3]) for r in jobs.current_windows(spark, out).collect()} == want


def test_velocity_stream(spark, pay, tmp_path):
    schema = "payment string, vpa string, cents bigint"
    spark.createDataFrame([("r1", "V1", 2000), ("r2", "V3", 5)], schema).write.json(f"{tmp_path}/in")
    scored = jobs.velocity_scores(spark.readStream.schema(schema).json(f"{tmp_path}/in"), pay)
    jobs.to_parquet(scored, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    got = {r["payment"]: r["ratio"] for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got == {"r1": 2.0, "r2": None}


def test_assignment_stream_is_idempotent(spark, food, tmp_path):
    schema = "order_id string, driver_id string, assigned_date bigint"
    one = spark.createDataFrame([("o1", "d2", 5), ("o1", "d2", 6)], schema).coalesce(1)
    one.write.json(f"{tmp_path}/in")

    def go():
        s = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        jobs.collect_assignments(s, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()

    go()
    one.write.mode("append").json(f"{tmp_path}/in")
    go()
    g = jobs.applied(food, f"{tmp_path}/o")
    assert rows(g.edge_view(["DELIVERED_BY"], ()), "src", "dst") == [("o1", "d1"), ("o1", "d2")]


def test_known_paid_before(spark, pay):
    r = spark.createDataFrame([("a", "V1", "V2"), ("b", "V2", "V1")], "payment string, vpa string, target string")
    assert rows(fraud.paid_before(pay, r)) == [("a", True), ("b", False)]


def test_intermediates_need_a_shared_folder_on_a_cluster(spark):
    from hopframe import session

    class Settings:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Settings(**values)

    with pytest.raises(ValueError):
        session.shared_dir(Session(**{"spark.master": "yarn"}))
    with pytest.raises(ValueError):
        session.shared_dir(Session(**{"spark.master": "local-cluster[3,2,1000]"}))
    assert session.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    path = session.fresh_path(spark, "x")
    assert spark.sparkContext.applicationId in path and path != session.fresh_path(spark, "x")
