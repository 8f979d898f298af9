import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hopframe.model import EdgeTable, PropertyGraph  # noqa: E402
from hopframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.log.level": "ERROR"})
    yield s
    s.stop()


def pay_graph(spark, users, accounts, owns, transfers) -> PropertyGraph:
    """users: (id, name, age); accounts: (id, balance); owns: (user, account); transfers: (eid, from, to, cents)."""
    u = spark.createDataFrame([(i, i, n, a) for i, n, a in users], "id string, userId string, name string, age int")
    a = spark.createDataFrame([(i, i, b) for i, b in accounts], "id string, accountId string, balance int")
    o = spark.createDataFrame([(f"owns#{i}", s, d) for i, (s, d) in enumerate(owns)], "eid string, src string, dst string")
    t = spark.createDataFrame([(e, s, d, float(c) / 100, c) for e, s, d, c in transfers],
                              "eid string, src string, dst string, amount double, cents bigint")
    return PropertyGraph({"User": u, "Account": a},
                         (EdgeTable("owns", o, "User", "Account"),
                          EdgeTable("Transaction", t, "Account", "Account")))


@pytest.fixture(scope="session")
def transfers_graph(spark):
    return pay_graph(spark, [("U1", "Alice", 30), ("U2", "Bob", 25), ("U3", "Charlie", 35)],
                     [("A1", 1000), ("A2", 500), ("A3", 750)], [("U1", "A1"), ("U2", "A2"), ("U3", "A3")],
                     [("t1", "A1", "A2", 10000), ("t2", "A3", "A1", 7500)])


@pytest.fixture(scope="session")
def ranking_graph(spark):
    return pay_graph(spark, [("u1", "Alice", 1), ("u2", "Bob", 2)], [("aA", 0), ("aB", 0)],
                     [("u1", "aA"), ("u2", "aB")],
                     [("x1", "aA", "aB", 60000), ("x2", "aB", "aA", 40000), ("x3", "aA", "aB", 560000)])


@pytest.fixture(scope="session")
def endpoint_graph(spark):
    return pay_graph(spark, [("b", "becky", 1), ("k", "keisha", 2), ("s", "ashley", 3)],
                     [("aB", 0), ("aK", 0), ("aA", 0)], [("b", "aB"), ("k", "aK"), ("s", "aA")],
                     [("x1", "aK", "aB", 60000), ("x2", "aA", "aB", 40000), ("x3", "aA", "aB", 560000)])


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
