"""Payments data set: users, accounts, random transfers and planted hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions.rng import int_between, pick, uniform
from hopframe.generators.scale_free import distinct_targets, numbered
from hopframe.model import EdgeTable, PropertyGraph, union_all

BANKS = ["North Bank", "River Bank", "Harbor Bank", "Summit Bank", "Union Bank"]
DEVICES = ["phone", "tablet", "laptop", "desktop", "terminal"]
DAY_MS = 86_400_000


def _details(seed: int, stream: str, low: int, high: int, *keys: Column) -> list[Column]:
    def u(part):
        return uniform(seed, f"{stream}/{part}", *keys)

    day = F.make_date(int_between(u("year"), 2000, 2025).cast("int"), int_between(u("month"), 1, 12).cast("int"),
                      int_between(u("day"), 1, 28).cast("int"))
    return [int_between(u("amount"), low, high).alias("amount"),
            pick(DEVICES, u("device")).alias("device"),
            F.when(u("type") < 0.5, "debit").otherwise("credit").alias("type"),
            (F.unix_date(day).cast("bigint") * DAY_MS).alias("timestamp")]


def _people(rows: DataFrame, name: Column, low: int, high: int, seed: int):
    n = F.col("n")
    uid, aid = F.concat(F.lit("U"), n), F.concat(F.lit("A"), n)
    users = rows.select(uid.alias("id"), uid.alias("userId"), name.alias("name"),
                        int_between(uniform(seed, "age", n), 18, 90).alias("age"))
    accounts = rows.select(aid.alias("id"), aid.alias("accountId"),
                           int_between(uniform(seed, "balance", n), low, high).alias("balance"),
                           pick(BANKS, uniform(seed, "bank", n)).alias("bank"))
    owns = rows.select(F.concat_ws("#", F.lit("owns"), uid, aid).alias("eid"), uid.alias("src"), aid.alias("dst"),
                       F.date_format(F.date_add(F.lit("2008-01-01"), int_between(
                           uniform(seed, "since", n), 0, 6500).cast("int")), "yyyy-MM").alias("since"))
    return users, accounts, owns


def generate(spark: SparkSession, users: int | DataFrame, hubs: int = 2, min_transfers: int = 7, max_transfers: int = 14,
             seed: int = 42) -> PropertyGraph:
    """``users`` accounts with 7-14 transfers each to other accounts, then ``hubs`` hub accounts
    that each pay 5-8 accounts 9-25 times with large amounts (5 000-30 000).

    ``users`` is a count or a DataFrame of user numbers ``n`` (1, 2, ... without gaps). The numbers of transfers,
    payees and the range of large amounts are fixed values.
    """
    n = F.col("n")
    plain = numbered(spark, users)
    users = users if isinstance(users, int) else users.count()
    extra = spark.range(users + 1, users + hubs + 1).select(F.col("id").alias("n"))
    u1, a1, o1 = _people(plain, F.concat(F.lit("User "), n), 500, 10_000, seed)
    u2, a2, o2 = _people(extra, F.concat(F.lit("Hub "), n - users), 90_000, 250_000, seed)

    count = int_between(uniform(seed, "transfers", n), min_transfers, max_transfers)
    sent = plain.select("n", F.explode(F.sequence(F.lit(1).cast("bigint"), count)).alias("i"))
    # Any account but the sender's own: an offset of 1 .. users - 1 around the ring.
    far = F.pmod(n - 1 + int_between(uniform(seed, "target", n, F.col("i")), 1, max(users - 1, 1)), F.lit(users)) + 1
    tx = sent.filter(F.lit(users > 1)).select(
        F.concat_ws("#", F.lit("Transaction"), n.cast("string"), F.col("i").cast("string")).alias("eid"),
        F.concat(F.lit("A"), n).alias("src"), F.concat(F.lit("A"), far).alias("dst"),
        F.concat(F.lit("T"), F.col("i") - 1).alias("transactionId"), *_details(seed, "tx", 1, 1001, n, F.col("i")))
    return PropertyGraph(
        {"User": union_all([u1, u2]), "Account": union_all([a1, a2])},
        (EdgeTable("owns", union_all([o1, o2]), "User", "Account"),
         EdgeTable("Transaction", union_all([tx, hub_transfers(extra, users + hubs, seed)]), "Account", "Account")))


def hub_transfers(hubs: DataFrame, accounts: int, seed: int = 42) -> DataFrame:
    """Transfers of the hub accounts numbered ``n`` to distinct accounts among 1..``accounts``."""
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    targets = F.least(int_between(uniform(seed, "payees", n), 5, 8), F.lit(accounts).cast("bigint"))
    picked = hubs.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), targets - 1)).alias("i"))
    times = int_between(uniform(seed, "times", n, i), 9, 25)
    # A payee is drawn once, before its transfers are listed.
    paid = picked.select("n", "i", (distinct_targets(n, i, accounts, seed, "payee") + 1).alias("far"))
    rows = paid.select("n", "i", "far", F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("j"))
    return rows.select(
        F.concat_ws("#", F.lit("Hub"), n.cast("string"), i.cast("string"), j.cast("string")).alias("eid"),
        F.concat(F.lit("A"), n).alias("src"), F.concat(F.lit("A"), F.col("far")).alias("dst"),
        F.concat(F.lit("T"), n).alias("transactionId"), *_details(seed, "hub", 5_000, 30_000, n, i, j))
