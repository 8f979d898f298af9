"""Instant-payment fraud checks, for every person (or payment) at once.

Graph: Person -has_account/has_card-> instrument -owns-> VPA -transaction-> VPA.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions.scalars import mean_of_cents
from hopframe.model import PropertyGraph
from hopframe.operators import bitsets
from hopframe.operators.messages import pull, total_per_seed
from hopframe.operators.skew import splittable
from hopframe.session import materialize

HAS = ("has_account", "has_card")
INSTRUMENTS = ("BankAccount", "Card")
# Tables of a stored beneficiary index and the column that their buckets come from.
INDEX_KEYS = {"known": "person", "into": "dst", "out_deg": "person", "in_deg": "target"}
VERSIONS = "version bigint, path string, buckets int"


# ---- shared pieces ---------------------------------------------------------

def persons(g: PropertyGraph) -> DataFrame:
    return g.vertices["Person"].select(F.col("id").alias("seed"))


def person_vpas(g: PropertyGraph) -> DataFrame:
    """``person, vpa`` with bag multiplicity (one row per instrument path)."""
    has = g.edge_view(HAS, ()).select(F.col("src").alias("person"), F.col("dst").alias("_inst"))
    owns = g.edge_view(["owns"], ()).select(F.col("src").alias("_i"), F.col("dst").alias("vpa"))
    return has.join(owns, F.col("_inst") == F.col("_i")).select("person", "vpa")


def _tx(g: PropertyGraph, *props: str) -> DataFrame:
    return g.edge_view(["transaction"], props)


def sender_totals(g: PropertyGraph) -> DataFrame:
    """``id, tx_n, tx_cents`` per sending VPA."""
    return (_tx(g, "cents").groupBy(F.col("src").alias("id"))
            .agg(F.count(F.lit(1)).alias("tx_n"), F.sum("cents").alias("tx_cents")))


def to_persons(g: PropertyGraph, per_vpa: DataFrame, measures: list[str]) -> DataFrame:
    """Sum per-VPA measures over the VPAs of each person (``id, <measures>``)."""
    v = splittable(per_vpa.select(F.col("id").alias("_v"), *measures))
    return (person_vpas(g).join(v, F.col("vpa") == F.col("_v"))
            .groupBy(F.col("person").alias("id")).agg(*[F.sum(m).alias(m) for m in measures]))


# ---- known and second-degree beneficiaries ---------------------------------

def paid_before(g: PropertyGraph, requests: DataFrame) -> DataFrame:
    """Has the sending VPA paid this VPA before? ``requests``: payment, vpa, target."""
    asked = requests.select(F.col("vpa").alias("_v"), F.col("target").alias("_t")).distinct()
    pairs = (_tx(g).select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
             .join(asked, (F.col("_v") == F.col("_s")) & (F.col("_t") == F.col("_d")), "left_semi").distinct())
    return (requests.join(pairs, (F.col("vpa") == F.col("_s")) & (F.col("target") == F.col("_d")), "left")
            .select("payment", F.col("_s").isNotNull().alias("known")))


def sender_paths(g: PropertyGraph, requests: DataFrame) -> DataFrame:
    """``vpa, target, path``: paths to ``target`` over all VPAs of the persons behind ``vpa``.

    One seed per distinct (vpa, target), however many payments repeat it.
    vpa <-owns- instrument <-has- person -has-> instrument -owns-> vpa -transaction-> target.
    The path column holds instrument, person, then the alternating walk. Transfers into the
    requested targets get their owners attached (one row per transfer and owner) and meet
    the seeds on (person, target): a person with very many VPAs is never multiplied by that
    person's payments.
    """
    owns = g.edge_view(["owns"], ())
    has = g.edge_view(HAS, ())
    up = (owns.select(F.col("dst").alias("_vpa"), F.col("src").alias("i1"))
          .join(has.filter(F.col("label") == "has_account")
                .select(F.col("src").alias("p"), F.col("dst").alias("_i1")), F.col("i1") == F.col("_i1"))
          .select("_vpa", "i1", "p"))
    seeds = requests.select("vpa", "target").distinct()
    wanted = seeds.select(F.col("target").alias("_w")).distinct()
    tx = (_tx(g).join(wanted, F.col("dst") == F.col("_w"), "left_semi")
          .select(F.col("src").alias("v2"), F.col("dst").alias("_d"), F.col("eid").alias("t")))
    reach = (tx.join(owns.select(F.col("dst").alias("_v2"), F.col("eid").alias("o"), F.col("src").alias("i2")),
                     F.col("v2") == F.col("_v2"))
             .join(has.select(F.col("src").alias("_p"), F.col("eid").alias("h"), F.col("dst").alias("_i2")),
                   F.col("i2") == F.col("_i2"))
             .select("_p", "h", "i2", "o", "v2", "t", "_d"))
    return (seeds
            .join(up, F.col("vpa") == F.col("_vpa"))
            .join(reach, (F.col("p") == F.col("_p")) & (F.col("target") == F.col("_d")))
            .select("vpa", "target", F.array("vpa", "i1", "p", "h", "i2", "o", "v2", "t", "target").alias("path")))


def outgoing_paths(g: PropertyGraph):
    """Every person's outgoing transfer paths: person, has, instrument, owns, vpa, transfer, vpa."""
    return (g.V("Person").with_path().out_e(*HAS).in_v().out_e("owns").in_v()
            .out_e("transaction").in_v().paths())


def known_receivers(g: PropertyGraph, people: DataFrame | None = None) -> DataFrame:
    """``person, receiver``: distinct VPAs each person (of ``people``, if given) has paid.

    Parallel transfers are merged before the join with the owners.
    """
    pairs = _tx(g).select(F.col("src").alias("_s"), F.col("dst").alias("receiver")).distinct()
    owned = person_vpas(g) if people is None else person_vpas(g).join(people, "person", "left_semi")
    return (owned.join(pairs, F.col("vpa") == F.col("_s"))
            .select("person", "receiver").distinct())


@dataclass(frozen=True)
class BeneficiaryIndex:
    """What the beneficiary checks look up.

    known      person, receiver (distinct)
    into       src, dst, m: number of parallel transfers per VPA pair
    out_deg    person, da: distinct receivers
    in_deg     target, dc: distinct payers

    A stored index lies in ``buckets`` folders by person (known, out_deg) or by target (into, in_deg).
    """

    known: DataFrame
    into: DataFrame
    out_deg: DataFrame
    in_deg: DataFrame
    buckets: int = 0

    def only(self, requests: DataFrame) -> BeneficiaryIndex:
        """The buckets of the requests' persons and targets; no others are read."""
        def held(key: str) -> list[int]:
            return [r[0] for r in requests.select(_bucket(key, self.buckets)).distinct().collect()]  # up to ``buckets``

        people, targets = F.col("bucket").isin(held("person")), F.col("bucket").isin(held("target"))
        return replace(self, known=self.known.filter(people), out_deg=self.out_deg.filter(people),
                       into=self.into.filter(targets), in_deg=self.in_deg.filter(targets))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def beneficiary_index(g: PropertyGraph, requests: DataFrame | None = None) -> BeneficiaryIndex:
    """The index of all transfers, or of those that the persons and targets of ``requests`` can need."""
    known, tx = known_receivers(g), _tx(g).select("src", "dst")
    if requests is not None:
        known = known_receivers(g, requests.select("person").distinct())
        tx = tx.join(requests.select(F.col("target").alias("dst")).distinct(), "dst", "left_semi")
    into = tx.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    known, into = materialize(known, "known-receivers"), materialize(into, "transfer-pairs")
    return BeneficiaryIndex(known, into, known.groupBy("person").agg(F.count(F.lit(1)).alias("da")),
                            into.groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("dc")))


def refresh_index(g: PropertyGraph, store: str, buckets: int = 64) -> int:
    """Add a version of the index to ``store`` and return its number, the time at which it was complete.

    A version is listed only after all its tables are complete, so readers never see half of one.
    """
    index = beneficiary_index(g)
    spark = index.known.sparkSession
    path = f"{store}/index-{uuid.uuid4().hex}"
    for name, key in INDEX_KEYS.items():
        table = getattr(index, name).withColumn("bucket", _bucket(key, buckets))
        # A hub's bucket is written in several files.
        spread = F.pmod(F.xxhash64(*table.columns), F.lit(8))
        table.repartition("bucket", spread).write.partitionBy("bucket").parquet(f"{path}/{name}")
    version = time.time_ns()
    spark.createDataFrame([(version, path, buckets)], VERSIONS).coalesce(1).write.parquet(f"{store}/version-{version}")
    return version


def newest_index(spark: SparkSession, store: str) -> BeneficiaryIndex:
    """The newest complete version in ``store``."""
    v = spark.read.schema(VERSIONS).parquet(f"{store}/version-*").orderBy(F.desc("version")).first()
    schemas = {"known": "person string, receiver string", "into": "src string, dst string, m bigint",
               "out_deg": "person string, da bigint", "in_deg": "target string, dc bigint"}
    return BeneficiaryIndex(*[spark.read.schema(f"{schemas[name]}, bucket int").parquet(f"{v['path']}/{name}")
                              for name in INDEX_KEYS], v["buckets"])


def known_beneficiary(g: PropertyGraph, requests: DataFrame, index: BeneficiaryIndex | None = None) -> DataFrame:
    """``payment, known``: has the person paid ``target`` from any of their VPAs?"""
    index = index or beneficiary_index(g, requests)
    k = index.known.select(F.col("person").alias("_p"), F.col("receiver").alias("_r"))
    return (requests.join(k, (F.col("person") == F.col("_p")) & (F.col("target") == F.col("_r")), "left")
            .select("payment", F.col("_p").isNotNull().alias("known")))


def second_degree(g: PropertyGraph, requests: DataFrame, index: BeneficiaryIndex | None = None) -> DataFrame:
    """``payment, n_paths``: transfers into ``target`` from distinct VPAs the person has paid.

    For a pair (person A, target C) this counts B->C transfers with B among A's receivers.
    The walk starts from whichever end has fewer neighbours: A's receivers probed against
    transfers into C, or C's payers probed against A's receivers. A hub on one end is thus
    reached from the other end, and both branches are exact, so no pair is dropped.
    """
    index = index or beneficiary_index(g, requests)
    # Each distinct (person, target) is walked once, however many payments repeat it.
    pairs = (requests.select("person", "target").distinct()
             .join(index.out_deg.withColumnRenamed("person", "_dp"), F.col("person") == F.col("_dp"))
             .join(index.in_deg.withColumnRenamed("target", "_dt"), F.col("target") == F.col("_dt"))
             .select("person", "target", "da", "dc"))
    k = index.known.select(F.col("person").alias("_p"), F.col("receiver").alias("_b"))
    i = index.into.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "m")
    from_sender = (pairs.filter(F.col("da") <= F.col("dc"))
                   .join(k, F.col("person") == F.col("_p"))
                   .join(i, (F.col("_b") == F.col("_s")) & (F.col("target") == F.col("_d")))
                   .select("person", "target", "m"))
    from_target = (pairs.filter(F.col("da") > F.col("dc"))
                   .join(i, F.col("target") == F.col("_d"))
                   .join(k, (F.col("person") == F.col("_p")) & (F.col("_s") == F.col("_b")))
                   .select("person", "target", "m"))
    counted = (from_sender.unionByName(from_target)
               .groupBy(F.col("person").alias("_cp"), F.col("target").alias("_ct"))
               .agg(F.sum("m").alias("n_paths")))
    return (requests.join(counted, (F.col("person") == F.col("_cp")) & (F.col("target") == F.col("_ct")), "left")
            .select("payment", F.coalesce("n_paths", F.lit(0)).cast("bigint").alias("n_paths")))


def beneficiary_status(g: PropertyGraph, requests: DataFrame, index: BeneficiaryIndex | None = None) -> DataFrame:
    """``payment, status``: known, second_degree or first_time.

    Pairs found in the index are settled first; only the others are walked a second step.
    """
    index = index or beneficiary_index(g, requests)
    k = index.known.select(F.col("person").alias("_p"), F.col("receiver").alias("_r"))
    hit = (F.col("person") == F.col("_p")) & (F.col("target") == F.col("_r"))
    known = requests.join(k, hit, "left_semi").select("payment", F.lit("known").alias("status"))
    rest = requests.join(k, hit, "left_anti")
    return known.unionByName(second_degree(g, rest, index).select(
        "payment", F.when(F.col("n_paths") > 0, "second_degree").otherwise("first_time").alias("status")))


# ---- velocity --------------------------------------------------------------

def velocity_per_vpa(g: PropertyGraph) -> DataFrame:
    """``person, vpa, mean_amount`` per sender VPA; VPAs that sent nothing are left out."""
    t = sender_totals(g).withColumnRenamed("id", "_v")
    return (person_vpas(g).distinct().join(t, F.col("vpa") == F.col("_v"))
            .select("person", "vpa", mean_of_cents(F.col("tx_cents"), F.col("tx_n")).alias("mean_amount")))


def velocity_per_person(g: PropertyGraph) -> DataFrame:
    """``person, mean_amount`` over all sender VPAs of the person."""
    t = to_persons(g, sender_totals(g), ["tx_n", "tx_cents"])
    return t.select(F.col("id").alias("person"),
                    mean_of_cents(F.col("tx_cents"), F.col("tx_n")).alias("mean_amount"))


# ---- devices ---------------------------------------------------------------

def devices(g: PropertyGraph) -> DataFrame:
    return g.edge_view(["known_device"], ()).select(F.col("src").alias("person"), F.col("dst").alias("device"))


def shared_devices(g: PropertyGraph, at_least: int = 2) -> DataFrame:
    """``device, n_persons`` for devices known to several persons.

    The distinct spreads on (device, person), so a device known to a third of all persons
    is counted from partial sums, never gathered.
    """
    return (devices(g).distinct().groupBy("device").agg(F.count(F.lit(1)).alias("n_persons"))
            .filter(F.col("n_persons") >= at_least))


# ---- cities ----------------------------------------------------------------

def _cities(g: PropertyGraph) -> DataFrame:
    return _tx(g, "ip_city").filter(F.col("ip_city").isNotNull()).select("src", "ip_city")


def _vpa_city_sets(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """The city set of every VPA's transfers, and the numbers of the cities."""
    cities = _cities(g).distinct()
    numbers = bitsets.numbered(cities, "ip_city")
    return bitsets.build(cities, "src", "ip_city", numbers), numbers


def _listed(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    return bitsets.members(sets, numbers).select(F.col("key").alias("person"), F.col("value").alias("ip_city"))


def cities_immediate(g: PropertyGraph) -> DataFrame:
    """``person, ip_city``: cities of the transfers of a person's own VPAs."""
    sets, numbers = _vpa_city_sets(g)
    return _listed(bitsets.pull(person_vpas(g), "person", "vpa", sets), numbers)


def extended_city_sets(g: PropertyGraph, sets: DataFrame) -> DataFrame:
    """City sets of the VPAs that each person has paid, from the city ``sets`` of the VPAs.

    Receivers' sets travel backwards as bitmaps: over the merged transfers to the senders, then to their persons. A
    receiver paid by a third of all VPAs costs a row per payer and page of 1024 cities.
    """
    pairs = _tx(g).select("src", "dst").distinct()
    return bitsets.pull(person_vpas(g), "person", "vpa", bitsets.pull(pairs, "src", "dst", sets))


def cities_extended(g: PropertyGraph) -> DataFrame:
    """``person, ip_city``: cities of the transfers made by the VPAs a person has paid."""
    sets, numbers = _vpa_city_sets(g)
    return _listed(extended_city_sets(g, sets), numbers)


# ---- counts ----------------------------------------------------------------

def _flag(c: str):
    return F.coalesce(F.col(c), F.lit(False)).cast("bigint")


def _blocked(g: PropertyGraph) -> DataFrame:
    return (g.vertex_view(INSTRUMENTS, ["fraud_block"]).filter(F.col("fraud_block"))
            .select("id", F.lit(1).cast("bigint").alias("n")))


def _per_person(g: PropertyGraph, values: DataFrame) -> DataFrame:
    out = total_per_seed(persons(g), values, ["n"])
    return out.select(F.col("seed").alias("person"), "n")


def blocked_immediate(g: PropertyGraph) -> DataFrame:
    return _per_person(g, pull(g.edge_view(HAS, ()), _blocked(g), ["n"]))


def _through_receivers(g: PropertyGraph, per_vpa: DataFrame) -> DataFrame:
    """Per person, sum a receiver-VPA measure over all outgoing transfers."""
    sent = pull(_tx(g), per_vpa, ["n"])
    owned = pull(g.edge_view(["owns"], ()), sent, ["n"])
    return _per_person(g, pull(g.edge_view(HAS, ()), owned, ["n"]))


def blocked_extended(g: PropertyGraph) -> DataFrame:
    return _through_receivers(g, pull(g.edge_view(["owns"], ()), _blocked(g), ["n"], near="dst", far="src"))


def flagged_persons_extended(g: PropertyGraph) -> DataFrame:
    """Flagged persons behind receivers. The written query leaves instruments by *outgoing*
    has-edges, which do not exist; the intended incoming direction is used."""
    flagged = (g.vertices["Person"].filter(F.col("fraud_flag"))
               .select("id", F.lit(1).cast("bigint").alias("n")))
    owners = pull(g.edge_view(HAS, ()), flagged, ["n"], near="dst", far="src")
    return _through_receivers(g, pull(g.edge_view(["owns"], ()), owners, ["n"], near="dst", far="src"))


def _flagged_tx(g: PropertyGraph) -> DataFrame:
    return (_tx(g, "fraud_flag").filter(F.col("fraud_flag"))
            .groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")))


def flagged_tx_immediate(g: PropertyGraph) -> DataFrame:
    owned = pull(g.edge_view(["owns"], ()), _flagged_tx(g), ["n"])
    return _per_person(g, pull(g.edge_view(HAS, ()), owned, ["n"]))


def flagged_tx_extended(g: PropertyGraph) -> DataFrame:
    return _through_receivers(g, _flagged_tx(g))


# ---- flagship --------------------------------------------------------------

def risk_features(g: PropertyGraph) -> DataFrame:
    """One row per person with every count, mean and set size of the cookbook.

    All additive measures share one pass over the transfers: receiver measures (blocked
    instruments, flagged owners, flagged transfers) are prepared per VPA, then a single
    join and one map-side-combined sum give the sender's own and extended numbers.
    """
    owns = g.edge_view(["owns"], ())
    has = g.edge_view(HAS, ())
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")

    # Instrument level: blocked flag and number of flagged owners.
    flagged_owner = g.vertices["Person"].filter(F.col("fraud_flag")).select(
        "id", zero.alias("blk"), one.alias("own"))
    inst = (pull(has, flagged_owner, ["blk", "own"], near="dst", far="src")
            .unionByName(_blocked(g).select("id", one.alias("blk"), zero.alias("own"))))
    vpa_side = pull(owns, inst.groupBy("id").agg(F.sum("blk").alias("blk"), F.sum("own").alias("own")),
                    ["blk", "own"], near="dst", far="src").select("id", "blk", "own", zero.alias("flg"))
    flagged = _flagged_tx(g).select("id", zero.alias("blk"), zero.alias("own"), F.col("n").alias("flg"))
    receiver = (vpa_side.unionByName(flagged).groupBy(F.col("id").alias("_r"))
                .agg(*[F.sum(c).alias(c) for c in ("blk", "own", "flg")]))
    receiver = splittable(receiver)

    tx = _tx(g, "cents", "fraud_flag")
    sender = (tx.join(receiver, F.col("dst") == F.col("_r"), "left")
              .groupBy(F.col("src").alias("id"))
              .agg(F.count(F.lit(1)).alias("tx_n"), F.sum("cents").alias("tx_cents"),
                   F.sum(_flag("fraud_flag")).alias("flagged_tx"),
                   F.sum(F.coalesce("blk", zero)).alias("blocked_ext"),
                   F.sum(F.coalesce("own", zero)).alias("flagged_persons_ext"),
                   F.sum(F.coalesce("flg", zero)).alias("flagged_tx_ext")))
    sums = ["tx_n", "tx_cents", "flagged_tx", "blocked_ext", "flagged_persons_ext", "flagged_tx_ext"]
    additive = to_persons(g, sender, sums)
    blocked = pull(has, _blocked(g), ["n"]).withColumnRenamed("n", "blocked")

    # Own cities and receivers' cities are sets: bitmaps over the known receivers and the own VPAs.
    known, (cities, _) = known_receivers(g), _vpa_city_sets(g)
    own = bitsets.sizes(bitsets.pull(person_vpas(g), "person", "vpa", cities))
    far = bitsets.sizes(bitsets.pull(known, "person", "receiver", cities))
    cities = own.select(F.col("key").alias("id"), F.col("n").alias("cities"))
    cities_ext = far.select(F.col("key").alias("id"), F.col("n").alias("cities_ext"))
    paid = known.groupBy(F.col("person").alias("id")).agg(F.count(F.lit(1)).alias("known_receivers"))
    shared = shared_devices(g).select(F.col("device").alias("_dev"))
    dev = (devices(g).join(shared, F.col("device") == F.col("_dev"), "left")
           .groupBy(F.col("person").alias("id"))
           .agg(F.count(F.lit(1)).alias("devices"), F.count("_dev").alias("shared_devices")))
    parts = [(additive, sums), (blocked, ["blocked"]), (dev, ["devices", "shared_devices"]),
             (paid, ["known_receivers"]), (cities, ["cities"]), (cities_ext, ["cities_ext"])]
    # One row per person in every part: stack and sum once instead of six joins.
    names = [c for _, cols in parts for c in cols]
    stacked = None
    for df, cols in [(persons(g).withColumnRenamed("seed", "id"), []), *parts]:
        row = df.select("id", *[F.col(c).cast("bigint").alias(c) if c in cols
                                else F.lit(None).cast("bigint").alias(c) for c in names])
        stacked = row if stacked is None else stacked.unionByName(row)
    total = stacked.groupBy("id").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in names])
    # Persons named only by edges never appear: every chain starts at a has-edge of a person,
    # and the person table is part of the stack.
    return total.select(
        F.col("id").alias("person"), "known_receivers", "tx_n",
        mean_of_cents(F.col("tx_cents"), F.col("tx_n")).alias("mean_amount"),
        "devices", "shared_devices", "cities", "cities_ext", "blocked", "blocked_ext",
        "flagged_persons_ext", "flagged_tx", "flagged_tx_ext")
