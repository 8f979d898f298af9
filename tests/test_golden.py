"""Small hand-built graphs and their expected answers."""

from conftest import rows
from pyspark.sql import functions as F

from hopframe.model import EdgeTable, PropertyGraph
from hopframe.operators.frontier import gte
from hopframe.plans import export, payments


def test_user_count_and_account_exists(transfers_graph):
    g = transfers_graph
    assert g.V("User").df.count() == 3
    assert rows(g.V("User").has("name", "Alice").out("owns").ids(), "id") == [("A1",)]


def test_transfers_between_users(spark, transfers_graph):
    g = transfers_graph
    one = (g.V("User").has("name", "Alice").out("owns").out_e("Transaction")
           .where(lambda f: f.in_v().in_("owns").has("name", "Bob")).element_map())
    assert rows(one, "id", "amount") == [("t1", 100.0)]
    either = (g.V("User").has("name", "Alice").out("owns").both_e("Transaction")
              .where(lambda f: f.other_v().in_("owns").has("name", "Bob")).element_map())
    assert rows(either, "id") == [("t1",)]
    pair = spark.createDataFrame([("U1", "U2")], "a string, b string")
    assert rows(payments.transfers_between(g, pair), "eid") == [("t1",)]
    assert rows(payments.transfers_between(g, pair, True), "eid") == [("t1",)]
    back = spark.createDataFrame([("U1", "U3")], "a string, b string")
    assert rows(payments.transfers_between(g, back)) == []
    assert rows(payments.transfers_between(g, back, True), "eid") == [("t2",)]


def test_counterparties_and_totals(transfers_graph):
    g = transfers_graph
    assert rows(payments.counterparties(g, "Alice"), "name") == [("Bob",), ("Charlie",)]
    assert rows(payments.in_out_totals(g, "Alice")) == [("U1", 10000, 7500)]
    assert rows(payments.in_out_totals(g, "Bob")) == [("U2", 0, 10000)]


def test_node_projection(transfers_graph):
    nodes = transfers_graph.V("User").value_map("name", tokens=True).withColumn("type", F.lit("user"))
    assert rows(nodes, "id", "name", "type") == [
        ("U1", "Alice", "user"), ("U2", "Bob", "user"), ("U3", "Charlie", "user")]


def test_ranking(ranking_graph):
    ranked = payments.top_accounts(ranking_graph, 2).collect()
    assert [(r["id"], r["total_cents"]) for r in ranked] == [("aA", 620000), ("aB", 40000)]
    hub = payments.suspected_hub(ranking_graph).first()
    assert hub["accountId"] == "aA" and hub["owner"] == "Alice" and hub["increase"] is None
    stats = payments.fenced_stats(payments.rank_accounts(ranking_graph), "total_cents").first()
    assert stats["n"] == 2 and stats["q1"] is None and stats["mean"] is None


def test_subgraph_between_two_users(spark, ranking_graph):
    for a, b in (("u1", "u2"), ("u2", "u1")):
        pair = spark.createDataFrame([(a, b)], "a string, b string")
        nodes, links = export.subgraph(ranking_graph, payments.paths_between(ranking_graph, pair))
        assert (nodes.count(), links.count()) == (4, 5)
        assert links.columns == ["id", "source", "target", "type", "label"]
    same = spark.createDataFrame([("u1", "u1")], "a string, b string")
    assert payments.paths_between(ranking_graph, same).count() == 0


def test_endpoint_graph(spark, endpoint_graph):
    g = endpoint_graph
    assert rows(payments.all_names(g)) == [("ashley",), ("becky",), ("keisha",)]
    seed = spark.createDataFrame([("b",)], "seed string")
    nodes, links = export.subgraph(g, payments.user_transfer_paths(g, "in", seed))
    assert (nodes.count(), links.count()) == (6, 6)
    assert {r["label"] for r in nodes.collect()} == {"becky", "keisha", "ashley", "aB", "aK", "aA"}
    assert payments.user_transfer_paths(g, "out", seed).count() == 0


def test_food_label_counts(spark):
    def verts(prefix, n):
        return spark.createDataFrame([(f"{prefix}{i}", f"name {i}") for i in range(n)], "id string, name string")

    g = PropertyGraph({"CustomerProfile": verts("c", 5), "Restaurant": verts("r", 3), "MenuItem": verts("m", 9),
                       "FoodOrder": verts("o", 5)},
                      (EdgeTable("PLACED", spark.createDataFrame([("p0", "c0", "o0")],
                                                                 "eid string, src string, dst string"),
                                 "CustomerProfile", "FoodOrder"),))
    counts = {r["label"]: r["count"] for r in g.vertex_view(None, ()).groupBy("label").count().collect()}
    assert counts == {"CustomerProfile": 5, "Restaurant": 3, "MenuItem": 9, "FoodOrder": 5}
    assert rows(g.V("CustomerProfile").has("name", "name 3").ids(), "id") == [("c3",)]


def test_greater_or_equal_is_inclusive(transfers_graph):
    assert rows(payments.senders_to_user(transfers_graph, 100.0, "Bob"), "sender") == [("Alice",)]
    assert rows(payments.senders_to_user(transfers_graph, 100.01, "Bob"), "sender") == []
    assert rows(transfers_graph.E("Transaction").has("amount", gte(75.0)).element_map(), "id") == [("t1",), ("t2",)]
