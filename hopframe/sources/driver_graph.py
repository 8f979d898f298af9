"""The reference graphs laid over the star-schema Parquet tables.

Every view is a projection of one or two tables, so column pruning reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions.scalars import cents
from hopframe.model import EdgeTable, PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, a, b, amount, cents, ts, pr``: one transfer per order between customers a and b.

    The customer count is a one-row scalar subquery, not a join.
    """
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_custkey").alias("a"), F.pmod(k * 31 + 7, n).alias("b"),
        F.col("o_totalprice").alias("amount"), cents(F.col("o_totalprice")).alias("cents"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("pr"))


def fraud_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    third = c.filter(key % 3 == 0)
    person = c.select(_id("P", key).alias("id"), F.col("c_name").alias("name"),
                      (key % 11 == 0).alias("fraud_flag"))
    account = c.select(_id("A", key).alias("id"), F.col("c_acctbal").alias("balance"),
                       F.col("c_mktsegment").alias("bank"), (F.col("c_acctbal") < 0).alias("fraud_block"))
    card = third.select(_id("C", key).alias("id"), (key % 8 == 0).alias("fraud_block"))
    vpa = c.select(_id("V", key).alias("id")).unionByName(third.select(_id("W", key).alias("id")))
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("P"), F.col("user_id")).alias("src"),
        F.concat(F.lit("D"), F.regexp_extract("props", "([0-9]+)", 1)).alias("dst")).distinct()
    device = ev.select(F.col("dst").alias("id")).distinct()

    def edge(df, label, src, dst, *more):
        eid = F.concat_ws("#", F.lit(label), src, dst)
        return df.select(eid.alias("eid"), src.alias("src"), dst.alias("dst"), *more)

    has_account = edge(c, "has_account", _id("P", key), _id("A", key)).unionByName(
        edge(c.filter(key % 5 == 1), "has_account", _id("P", key - 1), _id("A", key)))
    t = transfers(spark, sf_dir)
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    tx = t.select(
        _id("T", k).alias("eid"),
        F.when((a % 3 == 0) & (k % 2 == 1), _id("W", a)).otherwise(_id("V", a)).alias("src"),
        F.when((b % 3 == 0) & (k % 4 == 0), _id("W", b)).otherwise(_id("V", b)).alias("dst"),
        "amount", "cents", "ts", _id("CITY_", k % 40).alias("ip_city"),
        ((F.col("pr") == "1-URGENT") & (k % 7 == 0)).alias("fraud_flag"))
    known = ev.select(F.concat_ws("#", F.lit("known_device"), "src", "dst").alias("eid"), "src", "dst")
    return PropertyGraph(
        {"Person": person, "BankAccount": account, "Card": card, "VPA": vpa, "Device": device},
        (EdgeTable("has_account", has_account, "Person", "BankAccount"),
         EdgeTable("has_card", edge(third, "has_card", _id("P", key), _id("C", key)), "Person", "Card"),
         EdgeTable("owns", edge(c, "owns", _id("A", key), _id("V", key)), "BankAccount", "VPA"),
         EdgeTable("owns", edge(third, "owns", _id("C", key), _id("W", key)), "Card", "VPA"),
         EdgeTable("transaction", tx, "VPA", "VPA"),
         EdgeTable("known_device", known, "Person", "Device")))


def payment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming payments to check: ``payment, person, vpa, target, cents, ts``.

    One per order: the buyer pays the account that follows the last digit pattern of the
    order, so known, second-degree and first-time receivers all occur.
    """
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    target = F.when(k % 3 == 0, F.pmod(k * 31 + 7, n)).otherwise(F.pmod(k * 17 + 3, n))
    return table(spark, sf_dir, "orders").select(
        _id("R", k).alias("payment"), _id("P", c).alias("person"), _id("V", c).alias("vpa"),
        _id("V", target).alias("target"), cents(F.col("o_totalprice")).alias("cents"),
        F.col("o_orderdate").alias("ts"))


def payments_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    user = c.select(_id("U", key).alias("id"), _id("U", key).alias("userId"), F.col("c_name").alias("name"),
                    (F.lit(18) + key % 60).alias("age"))
    account = c.select(_id("A", key).alias("id"), _id("A", key).alias("accountId"),
                       F.col("c_acctbal").alias("balance"))
    owns = c.select(_id("owns#", key).alias("eid"), _id("U", key).alias("src"), _id("A", key).alias("dst"))
    k = F.col("k")
    tx = transfers(spark, sf_dir).select(
        _id("T", k).alias("eid"), _id("A", F.col("a")).alias("src"), _id("A", F.col("b")).alias("dst"),
        _id("T", k).alias("transactionId"), "amount", "cents",
        F.when(k % 2 == 0, "debit").otherwise("credit").alias("type"), "ts")
    return PropertyGraph({"User": user, "Account": account},
                         (EdgeTable("owns", owns, "User", "Account"),
                          EdgeTable("Transaction", tx, "Account", "Account")))


def food_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("o_orderkey")
    customer = c.select(_id("customer_", F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    restaurant = s.select(_id("restaurant_", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    item = p.select(_id("item_", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"),
                    F.col("p_retailprice").alias("price"))
    driver = o.select(_id("driver_", ok % 50).alias("id")).distinct()
    order = o.select(_id("order_", ok).alias("id"), F.col("o_orderdate").alias("order_date"),
                     F.col("o_orderstatus").alias("status"))
    placed = o.select(_id("PLACED#", ok).alias("eid"), _id("customer_", F.col("o_custkey")).alias("src"),
                      _id("order_", ok).alias("dst"), F.col("o_orderdate").alias("order_date"))
    contains = li.select(
        F.concat_ws("#", F.lit("CONTAINS"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("eid"),
        _id("order_", F.col("l_orderkey")).alias("src"), _id("item_", F.col("l_partkey")).alias("dst"),
        F.col("l_quantity").alias("qty"))
    first_supp = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    ordered_from = first_supp.select(
        _id("ORDERED_FROM#", F.col("l_orderkey")).alias("eid"),
        _id("order_", F.col("l_orderkey")).alias("src"),
        _id("restaurant_", F.col("s")).alias("dst"))
    delivered_by = o.select(_id("DELIVERED_BY#", ok).alias("eid"), _id("order_", ok).alias("src"),
                            _id("driver_", ok % 50).alias("dst"))
    rated = (o.filter(ok % 10 < 3).join(first_supp, ok == F.col("l_orderkey"))
             .select(_id("R", ok).alias("eid"), _id("customer_", F.col("o_custkey")).alias("src"),
                     _id("restaurant_", F.col("s")).alias("dst"), (F.lit(1) + ok % 5).alias("rating"),
                     F.col("o_orderpriority").alias("comment")))
    return PropertyGraph(
        {"CustomerProfile": customer, "Restaurant": restaurant, "MenuItem": item,
         "Driver": driver, "FoodOrder": order},
        (EdgeTable("PLACED", placed, "CustomerProfile", "FoodOrder"),
         EdgeTable("CONTAINS", contains, "FoodOrder", "MenuItem"),
         EdgeTable("ORDERED_FROM", ordered_from, "FoodOrder", "Restaurant"),
         EdgeTable("DELIVERED_BY", delivered_by, "FoodOrder", "Driver"),
         EdgeTable("RATED", rated, "CustomerProfile", "Restaurant")))
