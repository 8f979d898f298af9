"""User / account / transfer analyses (graph: User -owns-> Account -Transaction-> Account)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.model import PropertyGraph, union_all
from hopframe.operators.frontier import Frontier, gte
from hopframe.operators.quantiles import values_at_ranks
from hopframe.operators.skew import splittable
from hopframe.session import materialize


def _users(g: PropertyGraph, name: str | None = None) -> Frontier:
    start = g.V("User")
    return start if name is None else start.has("name", name)


def outgoing_transfers(g: PropertyGraph, name: str | None = None) -> DataFrame:
    """``seed, amount, receiver`` per outgoing transfer of each user."""
    return (_users(g, name).out("owns").out_e("Transaction").as_("amount", by="amount")
            .in_v().as_("receiver", by="accountId").select("amount", "receiver"))


def total_outgoing(g: PropertyGraph, on_empty: str = "drop", key: str = "accountId") -> DataFrame:
    """``<key>, total_cents`` of outgoing transfers per account (``drop`` or ``zero`` if none)."""
    sums = (g.edge_view(["Transaction"], ["cents"]).groupBy(F.col("src").alias("_s"))
            .agg(F.sum("cents").alias("total_cents")))
    how = "left" if on_empty == "zero" else "inner"
    acc = g.vertices["Account"].select("id", *([key] if key != "id" else []))
    return (acc.join(sums, F.col("id") == F.col("_s"), how)
            .groupBy(key).agg(F.coalesce(F.sum("total_cents"), F.lit(0)).cast("bigint").alias("total_cents")))


def senders_to_user(g: PropertyGraph, at_least: float = 100.0, name: str | None = None) -> DataFrame:
    """``seed, sender``: owners who sent at least ``at_least``; one row per transfer."""
    return (_users(g, name).out("owns").in_e("Transaction").has("amount", gte(at_least))
            .out_v().in_("owns").values("name").select("seed", F.col("value").alias("sender")))


def user_properties(g: PropertyGraph, name: str | None = None) -> DataFrame:
    return _users(g, name).properties()


def transfers_between(g: PropertyGraph, pairs: DataFrame, either_direction: bool = False) -> DataFrame:
    """Transfers from user ``a`` to accounts of user ``b``; ``pairs``: a, b (ids).

    Transfers get the owners of both ends attached and meet the pairs on (a, b): one row
    per transfer and owner, whatever the number of accounts a user holds.
    ``either_direction`` also takes transfers that ``b``'s accounts sent to ``a``'s.
    """
    pairs = pairs.select("a", "b").distinct()
    owns = g.edge_view(["owns"], ())
    tx = g.edge_view(["Transaction"])
    props = [c for c in tx.columns if c not in ("eid", "label", "src", "dst")]
    a_side = (owns.select(F.col("src").alias("_ua"), F.col("dst").alias("_aa"))
              .join(pairs.select(F.col("a").alias("_a")).distinct(), F.col("_ua") == F.col("_a"), "left_semi"))
    # Existence of an owner is asked for, not each owner edge: distinct on b's side.
    b_side = (owns.select(F.col("src").alias("_ub"), F.col("dst").alias("_ab")).distinct()
              .join(pairs.select(F.col("b").alias("_b")).distinct(), F.col("_ub") == F.col("_b"), "left_semi"))
    forward = tx.select(F.col("src").alias("_x"), F.col("dst").alias("_y"), "eid", "src", "dst", *props)
    if either_direction:
        forward = forward.unionByName(
            tx.select(F.col("dst").alias("_x"), F.col("src").alias("_y"), "eid", "src", "dst", *props))
    return (forward.join(a_side, F.col("_x") == F.col("_aa")).join(b_side, F.col("_y") == F.col("_ab"))
            .join(pairs, (F.col("_ua") == F.col("a")) & (F.col("_ub") == F.col("b")))
            .select("a", "b", "eid", "src", "dst", *props))


def counterparties(g: PropertyGraph, name: str | None = None) -> DataFrame:
    """``seed, name``: distinct names at the other end of any transfer.

    Account pairs are made distinct first: parallel transfers add nothing to a set.
    """
    owns = g.edge_view(["owns"], ())
    tx = g.edge_view(["Transaction"], ())
    pairs = (tx.select(F.col("src").alias("x"), F.col("dst").alias("y"))
             .unionByName(tx.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct())
    start = _users(g, name).df.select("seed")
    mine = owns.select(F.col("src").alias("_u"), F.col("dst").alias("_a"))
    theirs = owns.select(F.col("src").alias("_u2"), F.col("dst").alias("_a2"))
    users = g.vertices["User"].select(F.col("id").alias("_id"), "name").filter(F.col("name").isNotNull())
    return (start.join(mine, F.col("seed") == F.col("_u")).join(pairs, F.col("_a") == F.col("x"))
            .join(theirs, F.col("y") == F.col("_a2")).join(users, F.col("_u2") == F.col("_id"))
            .select("seed", "name").distinct())


def all_names(g: PropertyGraph) -> DataFrame:
    return g.V("User").values("name").select(F.col("value").alias("name"))


def in_out_totals(g: PropertyGraph, name: str | None = None) -> DataFrame:
    """``seed, out_cents, in_cents`` per user, 0 when there are none."""
    tx = g.edge_view(["Transaction"], ["cents"])
    flows = (tx.select(F.col("src").alias("acc"), F.col("cents").alias("o"), F.lit(0).cast("bigint").alias("i"))
             .unionByName(tx.select(F.col("dst").alias("acc"), F.lit(0).cast("bigint").alias("o"),
                                    F.col("cents").alias("i")))
             .groupBy("acc").agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
    owns = g.edge_view(["owns"], ()).select(F.col("src").alias("_u"), F.col("dst").alias("_a"))
    start = _users(g, name).df.select("seed")
    return (start.join(owns, F.col("seed") == F.col("_u"), "left")
            .join(flows, F.col("_a") == F.col("acc"), "left")
            .groupBy("seed").agg(F.coalesce(F.sum("o"), F.lit(0)).cast("bigint").alias("out_cents"),
                                 F.coalesce(F.sum("i"), F.lit(0)).cast("bigint").alias("in_cents")))


# ---- subgraphs -------------------------------------------------------------

def _step(g: PropertyGraph, direction: str, far_labels: tuple[str, ...] | None = None,
          near_labels: tuple[str, ...] | None = None) -> DataFrame:
    """``k, e, f``: near vertex, edge, far vertex of one hop in ``direction``.

    Edge tables known to touch none of the given labels at that end are left out.
    """
    def may(label: str | None, wanted: tuple[str, ...] | None) -> bool:
        return wanted is None or label in wanted

    def near(label: str | None) -> bool:
        return label is None or may(label, near_labels)

    frames = []
    for t in g.edges:
        if direction in ("out", "both") and may(t.dst_label, far_labels) and near(t.src_label):
            frames.append(t.df.select(F.col("src").alias("k"), F.col("eid").alias("e"), F.col("dst").alias("f")))
        if direction in ("in", "both") and may(t.src_label, far_labels) and near(t.dst_label):
            frames.append(t.df.select(F.col("dst").alias("k"), F.col("eid").alias("e"), F.col("src").alias("f")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _named(df: DataFrame, k: str, e: str, f: str) -> DataFrame:
    return df.select(F.col("k").alias(k), F.col("e").alias(e), F.col("f").alias(f))


def paths_between(g: PropertyGraph, pairs: DataFrame,
                  pattern: tuple[str, str, str] = ("out", "both", "both")) -> DataFrame:
    """``a, b, path``: all 3-hop walks from vertex ``a`` to ``b``; none when a = b.

    Per pair the cheapest of three exact orders is taken, from degrees summed beforehand:
    meet in the middle (one hop from each end, the middle edge looked up by both its ends),
    two hops from a with the last looked up, or two hops from b with the first looked up.
    An account with millions of transfers is only expanded if every other order costs more.
    """
    index = pair_costs(g, pairs, pattern)
    from_a, from_b = F.col("a") == F.col("_k1"), F.col("b") == F.col("_k3")
    orders = {
        "meet": lambda p: p.join(index.first, from_a).join(index.last, from_b)
        .join(index.mid, (F.col("v1") == F.col("_m1")) & (F.col("v2") == F.col("_m2"))),
        "forth": lambda p: p.join(index.first, from_a).join(index.mid, F.col("v1") == F.col("_m1"))
        .join(index.last, from_b & (F.col("_m2") == F.col("v2"))),
        "rear": lambda p: p.join(index.last, from_b).join(index.mid, F.col("v2") == F.col("_m2"))
        .join(index.first, from_a & (F.col("_m1") == F.col("v1"))),
    }
    path = F.array("a", "e1", "v1", "e2", "v2", "e3", "b").alias("path")
    used = [r[0] for r in index.pairs.select("order").distinct().collect()]  # at most three names
    walks = [orders[o](index.pairs.filter(F.col("order") == o)).select("a", "b", path) for o in sorted(used) or ["meet"]]
    return union_all(walks)


@dataclass(frozen=True)
class PairCosts:
    """Written tables for walks between pairs: the hops at either end, the middle hops, and the order of every pair.

    first   _k1, e1, v1: first hops of the vertices ``a``
    last    _k3, e3, v2: last hops of the vertices ``b``, seen from there
    mid     _m1, e2, _m2: all middle hops
    pairs   a, b, order: pairs that may have a walk, and the cheapest order of the three hops
    """

    first: DataFrame
    last: DataFrame
    mid: DataFrame
    pairs: DataFrame


def pair_costs(g: PropertyGraph, pairs: DataFrame, pattern: tuple[str, str, str]) -> PairCosts:
    """Degrees and numbers of two-hop walks of the vertices in ``pairs`` only, read once to choose their orders."""
    back = {"out": "in", "in": "out", "both": "both"}
    pairs = pairs.select("a", "b").distinct().filter(F.col("a") != F.col("b"))

    def end(direction: str, column: str, key: str, e: str, f: str) -> DataFrame:
        wanted = pairs.select(F.col(column).alias(key)).distinct()
        return materialize(_named(_step(g, direction), key, e, f).join(wanted, key, "left_semi"), "pair-ends")

    first = end(pattern[0], "a", "_k1", "e1", "v1")
    last = end(back[pattern[2]], "b", "_k3", "e3", "v2")
    mid = _named(_step(g, pattern[1]), "_m1", "e2", "_m2")

    def cost(hops: DataFrame, key: str, via: str, mid_key: str, degree: str, two: str) -> DataFrame:
        near = hops.groupBy(key, via).agg(F.count(F.lit(1)).alias("_n"))
        ways = (mid.join(near.select(F.col(via).alias(mid_key)).distinct(), mid_key, "left_semi")
                .groupBy(mid_key).agg(F.count(F.lit(1)).alias("_w")))
        walks = near.join(splittable(ways), F.col(via) == F.col(mid_key), "left")
        return walks.groupBy(key).agg(F.sum("_n").alias(degree), F.sum(F.col("_n") * F.col("_w")).alias(two))

    costed = (pairs.join(cost(first, "_k1", "v1", "_m1", "da", "ra"), F.col("a") == F.col("_k1"))
              .join(cost(last, "_k3", "v2", "_m2", "db", "rb"), F.col("b") == F.col("_k3"))
              .filter("ra > 0 AND rb > 0").withColumn("meet", F.col("da") * F.col("db")))
    best = F.least("meet", "ra", "rb")
    order = F.when(F.col("meet") == best, "meet").when(F.col("ra") == best, "forth").otherwise("rear")
    return PairCosts(first, last, mid, materialize(costed.select("a", "b", order.alias("order")), "pair-costs"))


def user_transfer_paths(g: PropertyGraph, direction: str = "out", seeds: DataFrame | None = None) -> DataFrame:
    """``seed, path``: walks out · out|in · both that end at a User.

    The end label prunes the third hop to tables that touch users, so transfers of the
    middle account are not expanded a second time.
    """
    start = (g.V("User").df if seeds is None else seeds).select("seed")
    h1 = _named(_step(g, "out", near_labels=("User",) if seeds is None else None), "_k1", "e1", "v1")
    h2 = _named(_step(g, direction), "_k2", "e2", "v2")
    h3 = _named(_step(g, "both", ("User",)), "_k3", "e3", "v3")
    return (start.join(h1, F.col("seed") == F.col("_k1")).join(h2, F.col("v1") == F.col("_k2"))
            .join(h3, F.col("v2") == F.col("_k3"))
            .select("seed", F.array("seed", "e1", "v1", "e2", "v2", "e3", "v3").alias("path")))


# ---- ranking ---------------------------------------------------------------

def account_totals(g: PropertyGraph) -> DataFrame:
    """``id, accountId, total_cents``: every account, 0 when it sent nothing."""
    sums = (g.edge_view(["Transaction"], ["cents"]).groupBy(F.col("src").alias("_s"))
            .agg(F.sum("cents").alias("_t")))
    return (g.vertices["Account"].select("id", "accountId").join(sums, F.col("id") == F.col("_s"), "left")
            .select("id", "accountId", F.coalesce("_t", F.lit(0)).cast("bigint").alias("total_cents")))


def with_owner(g: PropertyGraph, totals: DataFrame) -> DataFrame:
    """Adds ``owner_id, owner``: the smallest user id, by an aggregate that combines map-side."""
    users = g.vertices["User"].select(F.col("id").alias("_uid"), F.col("name").alias("owner"))
    held = g.edge_view(["owns"], ()).select(F.col("dst").alias("_a"), "src")
    first = held.join(totals.select(F.col("id").alias("_id")), F.col("_a") == F.col("_id"), "left_semi") \
        .groupBy("_a").agg(F.min("src").alias("owner_id"))
    return (totals.join(first, F.col("id") == F.col("_a"), "left")
            .join(users, F.col("owner_id") == F.col("_uid"), "left")
            .select(*totals.columns, "owner_id", "owner"))


def rank_accounts(g: PropertyGraph) -> DataFrame:
    """``id, accountId, total_cents, owner_id, owner`` of every account."""
    return with_owner(g, account_totals(g))


def largest(totals: DataFrame, n: int) -> DataFrame:
    return totals.orderBy(F.col("total_cents").desc(), F.col("id")).limit(n)


def top_accounts(g: PropertyGraph, n: int) -> DataFrame:
    """The ``n`` largest; owners are looked up for those only."""
    return largest(with_owner(g, largest(account_totals(g), n)), n)


def fenced_stats(totals: DataFrame, col: str) -> DataFrame:
    """One row ``n, q1, q3, mean`` (mean of the values inside the 1.5 IQR fences).

    Ranks are positions in descending order: q3 at floor(n/4)+1, q1 at ceil(3n/4)+1, which
    falls off the end for n < 4; q1, the fences and the mean are then NULL. ``totals`` is
    read several times, so callers pass a stored table.
    """
    n = totals.count()
    q3, q1 = values_at_ranks(totals, col, [n // 4 + 1, -(-3 * n // 4) + 1], n)
    v = F.col(col)
    if q1 is None or q3 is None:
        inside = F.lit(False)
    else:
        fence = 1.5 * (q3 - q1)
        inside = v.cast("double").between(F.lit(float(q1 - fence)), F.lit(float(q3 + fence)))
    kept = totals.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.when(inside, v)).alias("_sum"), F.count(F.when(inside, 1)).alias("_cnt"))
    return kept.select("n", F.lit(q1).cast("bigint").alias("q1"), F.lit(q3).cast("bigint").alias("q3"),
                       F.when(F.col("_cnt") > 0, F.col("_sum").cast("double")
                              / F.col("_cnt").cast("double")).alias("mean"))


def suspected_hub(g: PropertyGraph) -> DataFrame:
    """The account with the largest outgoing total and its ratio to the fenced mean."""
    totals = materialize(account_totals(g), "account-totals")
    mean = fenced_stats(totals.select("total_cents"), "total_cents").select("mean").scalar()
    top = with_owner(g, largest(totals, 1))
    return top.select("accountId", "owner", "total_cents",
                      F.when(mean != 0, F.col("total_cents").cast("double") / mean).alias("increase"))


def pair_multiplicity(g: PropertyGraph, label: str = "Transaction") -> DataFrame:
    """``lo, hi, n`` parallel edges per unordered vertex pair."""
    e = g.edge_view([label], ())
    return (e.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
            .agg(F.count(F.lit(1)).alias("n")))
