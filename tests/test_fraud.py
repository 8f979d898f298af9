"""Beneficiary checks and risk features against brute force on a graph with a hub."""

import random

import pytest
from conftest import rows

from hopframe.model import EdgeTable, PropertyGraph
from hopframe.operators import bitsets
from hopframe.plans import fraud


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    people = [f"P{i}" for i in range(8)]
    accounts, cards = [f"A{i}" for i in range(8)], [f"C{i}" for i in range(3)]
    has_a = [(f"P{i}", f"A{i}") for i in range(8)] + [("P0", "A3"), ("P2", "A5")]
    has_c = [("P0", "C0"), ("P4", "C1"), ("P4", "C2")]
    owns = [(a, "V" + a[1:]) for a in accounts] + [(c, "W" + c[1:]) for c in cards] + [("A1", "V9")]
    vpas = sorted({v for _, v in owns})
    pick = lambda: "V0" if rng.random() < 0.34 else rng.choice(vpas)
    tx = [(f"T{i}", pick(), pick(), rng.randrange(100, 9999), f"CITY{rng.randrange(4)}", rng.random() < .3)
          for i in range(60)]
    dev = [(f"P{rng.randrange(7)}", f"D{rng.randrange(5)}") for _ in range(14)]

    def df(data, schema):
        return spark.createDataFrame(data, schema)

    def edge(label, pairs):
        return df([(f"{label}{i}", s, d) for i, (s, d) in enumerate(pairs)], "eid string, src string, dst string")

    person = {p: i % 3 == 0 for i, p in enumerate(people)}
    blocked = {x: i % 2 == 0 for i, x in enumerate(accounts + cards)}
    g = PropertyGraph(
        {"Person": df(list(person.items()), "id string, fraud_flag boolean"),
         "BankAccount": df([(a, blocked[a]) for a in accounts], "id string, fraud_block boolean"),
         "Card": df([(c, blocked[c]) for c in cards], "id string, fraud_block boolean"),
         "VPA": df([(v,) for v in vpas], "id string"), "Device": df([(f"D{i}",) for i in range(5)], "id string")},
        (EdgeTable("has_account", edge("ha", has_a), "Person", "BankAccount"),
         EdgeTable("has_card", edge("hc", has_c), "Person", "Card"),
         EdgeTable("owns", edge("ow", owns), None, "VPA"),
         EdgeTable("transaction", df(tx, "eid string, src string, dst string, cents bigint, ip_city string, "
                                         "fraud_flag boolean"), "VPA", "VPA"),
         EdgeTable("known_device", edge("kd", sorted(set(dev))), "Person", "Device")))
    return g, people, has_a + has_c, has_a, owns, tx, sorted(set(dev)), person, blocked


def test_second_degree_and_status(spark, small):
    g, people, has, _, owns, tx, _, _, _ = small
    vpas_of = {p: [v for q, i in has if q == p for j, v in owns if j == i] for p in people}
    known = {p: {d for v in vpas_of[p] for _, s, d, *_ in tx if s == v} for p in people}
    targets = sorted({v for _, v in owns} | {"nobody"})
    reqs = [(f"R{i}", p, vpas_of[p][0], t) for i, (p, t) in
            enumerate((p, t) for p in [*people, "stranger"] for t in targets if p in vpas_of)]
    reqs += [("Rx", *reqs[0][1:]), ("Ry", "stranger", "V0", "V0")]
    df = spark.createDataFrame(reqs, "payment string, person string, vpa string, target string")
    paths = {r[0]: sum(1 for b in known.get(r[1], ()) for _, s, d, *_ in tx if s == b and d == r[3]) for r in reqs}
    assert dict(rows(fraud.second_degree(g, df))) == paths
    status = {r[0]: "known" if r[3] in known.get(r[1], ()) else "second_degree" if paths[r[0]] else "first_time"
              for r in reqs}
    assert dict(rows(fraud.beneficiary_status(g, df))) == status
    assert {"known", "second_degree", "first_time"} == set(status.values())
    assert dict(rows(fraud.known_beneficiary(g, df))) == {r[0]: r[3] in known.get(r[1], ()) for r in reqs}


def test_sender_paths(spark, small):
    g, people, has, has_a, owns, tx, *_ = small
    df = spark.createDataFrame([("R1", "P0", "V0", "V0"), ("R2", "P1", "V3", "V2"), ("R3", "P0", "V0", "V0")],
                               "payment string, person string, vpa string, target string")
    want = {}
    for _, _, vpa, target in df.collect():
        want[(vpa, target)] = sum(1 for i1, v in owns if v == vpa for p, i in has_a if i == i1 for q, i2 in has if q == p
                        for j, v2 in owns if j == i2 for _, s, d, *_ in tx if s == v2 and d == target)
    found = fraud.sender_paths(g, df).groupBy("vpa", "target").count().collect()
    got = {(r["vpa"], r["target"]): r["count"] for r in found}
    assert got == {k: v for k, v in want.items() if v} and want[("V0", "V0")]


def test_risk_features(small):
    g, people, has, _, owns, tx, dev, flag, blocked = small
    got = {r["person"]: r for r in fraud.risk_features(g).collect()}
    assert sorted(got) == people
    users = {d: {p for p, e in dev if e == d} for _, d in dev}
    for p in people:
        inst = [i for q, i in has if q == p]
        vpas = [v for i in inst for j, v in owns if j == i]
        mine = [t for v in vpas for t in tx if t[1] == v]
        back = [i for t in mine for i, v in owns if v == t[2]]
        onward = [u for t in mine for u in tx if u[1] == t[2]]
        r = got[p]
        assert r["known_receivers"] == len({t[2] for t in mine})
        assert r["tx_n"] == len(mine) and r["flagged_tx"] == sum(t[5] for t in mine)
        assert (r["mean_amount"] or 0) == pytest.approx(sum(t[3] for t in mine) / len(mine) / 100 if mine else 0)
        assert r["cities"] == len({t[4] for t in mine}) and r["cities_ext"] == len({u[4] for u in onward})
        assert r["blocked"] == sum(blocked[i] for i in inst) and r["blocked_ext"] == sum(blocked[i] for i in back)
        assert r["flagged_persons_ext"] == sum(flag[q] for i in back for q, j in has if j == i)
        assert r["flagged_tx_ext"] == sum(u[5] for u in onward)
        devices = {d for q, d in dev if q == p}
        assert (r["devices"], r["shared_devices"]) == (len(devices), sum(len(users[d]) > 1 for d in devices))


def test_counts_agree_with_frontier_walk(small):
    g = small[0]
    start = g.V("Person").out(*fraud.HAS).bulk().out("owns").bulk()
    walked = start.out("transaction").bulk().in_("owns").bulk().has("fraud_block", True).count()
    assert rows(walked, "seed", "n") == rows(fraud.blocked_extended(g), "person", "n")
    flagged = start.out_e("transaction").has("fraud_flag", True).count()
    assert rows(flagged, "seed", "n") == rows(fraud.flagged_tx_immediate(g), "person", "n")
    assert rows(g.V("Person").out(*fraud.HAS).out("owns").out("transaction").dedup().ids(), "seed", "id") == \
        rows(fraud.known_receivers(g), "person", "receiver")


def test_bitmap_sets(spark):
    rng = random.Random(8)
    members = [(f"k{rng.randrange(30)}", rng.choice([None, *(f"v{int(rng.random() ** 3 * 4000)}" for _ in range(9))]))
               for _ in range(6000)]
    links = [(f"n{rng.randrange(12)}", f"k{rng.randrange(34)}") for _ in range(60)]
    df = spark.createDataFrame(members, "k string, v string").repartition(5)
    numbers = bitsets.numbered(df, "v")
    sets = bitsets.build(df, "k", "v", numbers)
    want = {}
    for k, v in members:
        if v is not None:
            want.setdefault(k, set()).add(v)
    assert rows(bitsets.members(sets, numbers)) == sorted((k, v) for k, vs in want.items() for v in vs)
    found = numbers.collect()
    assert len({r["number"] for r in found}) == len(found) == len(set().union(*want.values()))
    up = bitsets.pull(spark.createDataFrame(links, "n string, k string"), "n", "k", sets)
    union = {n: set().union(*(want.get(k, set()) for m, k in links if m == n)) for n, _ in links}
    assert dict(rows(bitsets.sizes(up))) == {n: len(s) for n, s in union.items() if s}


def test_hub_cities_do_not_multiply(spark):
    """A third of all transfers go to one receiver that has paid from 3000 cities."""
    n, cities = 200, 3000
    tx = [(f"t{i}", f"V{i % n}", "HUB" if i % 3 == 0 else f"V{i * 7 % n}", f"C{i % 5}") for i in range(3 * n)]
    tx += [(f"h{i}", "HUB", "V0", f"C{i}") for i in range(cities)]
    owns = [(f"o{i}", f"A{i}", f"V{i}") for i in range(n)]
    has = [(f"a{i}", f"P{i}", f"A{i}") for i in range(n)]
    ends = "eid string, src string, dst string"
    g = PropertyGraph({"Person": spark.createDataFrame([(f"P{i}",) for i in range(n)], "id string")},
                      (EdgeTable("has_account", spark.createDataFrame(has, ends), "Person", "BankAccount"),
                       EdgeTable("owns", spark.createDataFrame(owns, ends), "BankAccount", "VPA"),
                       EdgeTable("transaction", spark.createDataFrame(tx, ends + ", ip_city string"), "VPA", "VPA")))
    sets, numbers = fraud._vpa_city_sets(g)
    pages = dict(rows(sets.groupBy("key").count()))
    largest = max(r["number"] for r in numbers.collect())
    assert pages["HUB"] <= largest // bitsets.PAGE + 1 <= 6  # 3000 cities, a few rows
    pairs = {(s, d) for _, s, d, _ in tx}
    joined = sum(pages.get(d, 0) for _, d in pairs)  # rows that the join on the receiver gives, not 3000 a payer
    assert joined <= pages["HUB"] * len(pairs)
    of = {}
    for _, s, _, c in tx:
        of.setdefault(s, set()).add(c)
    want = sorted((f"P{v[1:]}", c) for v in (f"V{i}" for i in range(n))
                  for c in set().union(*(of.get(d, set()) for s, d in pairs if s == v)))
    assert rows(fraud.cities_extended(g), "person", "ip_city") == want
