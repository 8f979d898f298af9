"""Importance resampling, Merkle manifests and language identification against brute force and held-out rows."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.llm import languages, merkle, order, queries, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@functools.cache
def vocabulary(words, letters):
    rng = random.Random(words)
    return ["".join(rng.choice(letters) for _ in range(1 + k % 6)) for k in range(words)]


def prose(seed, n, words=300, letters="abcdefgh"):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary(words, letters)) for _ in range(n))


NASTY = [
    (1, prose(1, 60), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t -- 12 ", "de", "b", 6),
    (5, prose(5, 60_000), "en", "a", 9), (6, prose(6, 80), "en", None, 2), (6, prose(6, 80), "en", None, 2),
    (None, prose(7, 30), "en", "c", 3), (8, "É Straße 😀 ſK ÅNGSTRÖM ABC abc " * 9, "fr", "c", (1 << 63) - 1),
    (9, prose(9, 19), "", "", 0), (14, prose(9, 20), "é", "😀", -5), (21, prose(10, 45), "en", "d", 5),
]


@pytest.fixture(scope="module")
def nasty(spark):
    df = spark.createDataFrame(NASTY, SCHEMA)
    for name in ("weight", "score", "rank", "words", "bucket", "path", "root", "place", "accepted", "id"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- order ----------------------------------------------------------------------------------

def test_places_with_repeats(spark, empty):
    rows = [(random.Random(i).randrange(50) or None,) for i in range(700)]
    got = order.with_places(spark.createDataFrame(rows, "k int").repartition(7), [F.col("k").asc_nulls_first()], "t")
    got = sorted((r["_place"], r["k"]) for r in got.collect())
    assert [p for p, _ in got] == list(range(700))
    assert [k for _, k in got] == sorted((k for k, in rows), key=lambda k: -1 if k is None else k)
    assert order.with_places(empty, [F.col("doc_id")], "t").count() == 0


# ---- importance resampling ------------------------------------------------------------------

def slow_features(text, sizes=(1, 1)):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i:i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]


def slow_scores(rows, target, buckets, sizes=(1, 1)):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in slow_features(text, sizes)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in slow_features(text, sizes)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    out = []
    for i, text in rows:
        words, f = slow_features(text, sizes)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words), len(f), weight, score))
    return out


def slow_ranks(scored, percent, min_words=20):
    pool = sorted((-score, (1 << 63) - 1 if i is None else i, n, k)
                  for k, (i, words, n, _, score) in enumerate(scored) if words >= min_words)
    return {k: p + 1 for p, (*_, k) in enumerate(pool[:percent * len(pool) // 100])}


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3)])
def test_scores_and_ranks(spark, nasty, empty, sizes):
    target = [prose(1, 200), None, "", "É abc ſ"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    scored = slow_scores([(r[0], r[1]) for r in NASTY], target, 500, sizes)
    for percent in (0, 10, 50, 100):
        weighed = resampling.weigh(nasty, wanted, buckets=500, sizes=sizes)
        got = resampling.draw(weighed, percent).collect()
        ranks = slow_ranks(scored, percent)
        want = [(i, n, w, s, ranks.get(k)) for k, (i, _, n, w, s) in enumerate(scored)]
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]))
                                                 for r in got)
        assert got[0]["path"] == "x"
    drawn = resampling.resample(nasty, wanted, 50, buckets=500, sizes=sizes).collect()
    texts = {r[0]: r[1] for r in NASTY}
    assert drawn and all(r["text"] == texts[r["doc_id"]] for r in drawn)
    assert resampling.draw(resampling.weigh(empty, wanted)).count() == 0
    assert resampling.draw(resampling.weigh(nasty, wanted.limit(0), sizes=sizes)).count() == len(NASTY)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, 25, 25, 0, [5, 7, 7, 7, 9][i % 5]) for i in range(-400, 600)] + [(3, 25, 25, 0, 7)] * 40
    df = spark.createDataFrame(rows, "doc_id long, _rs_words int, n_features long, weight long, score long").repartition(5)
    for percent in (1, 19, 20, 33, 50, 79, 100):
        got = sorted((r["rank"], r["score"], r["doc_id"]) for r in resampling.draw(df, percent).collect() if r["rank"])
        want = sorted((-s, i) for i, *_, s in rows)[:percent * len(rows) // 100]
        assert got == [(k + 1, -s, i) for k, (s, i) in enumerate(want)]


def test_threshold_counts_exactly(spark):
    df = spark.createDataFrame([(random.Random(i).randrange(-90, 90) ** 3,) for i in range(300)], "x long")
    values = sorted((r[0] for r in df.collect()), reverse=True)
    for least in (1, 150, 300):
        assert resampling.threshold(df, "x", least) == values[least - 1]
    assert resampling.threshold(df, "x", 301) is None


# ---- Merkle manifest ------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(nodes, fanout):
    """Root and, per node, the list of (left, right) siblings."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(spots):
            first = at - at % fanout
            paths[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        spots = [at // fanout for at in spots]
    return nodes[0], paths


def slow_manifest(rows, fanout):
    """rows: (doc_id, lang, leaf); sorted (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for i, lang, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(lang, []).append((i, leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {x: slow_tree([leaf for _, leaf in groups[x]], fanout) for x in names}
    root, above = slow_tree([inner[x][0] for x in names], fanout)
    return sorted(repr((i, leaf, inner[x][0], root, path + above[k])) for k, x in enumerate(names)
                  for (i, leaf), path in zip(groups[x], inner[x][1]))


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, monkeypatch, nasty, empty, fanout):
    monkeypatch.setattr(merkle, "BLOCK", 8)  # several rounds
    rows = [(i, f"l{i % 7 % 5}" if i % 40 else None, sha(str(i))) for i in range(500)] + [(7, "one", "x"), (9, "l1", "y")]
    rows += [(9, "l1", "y"), (None, "l1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5)
    for part, want in ((df, rows), (df.where("lang = 'one'"), [r for r in rows if r[1] == "one"])):
        got = merkle.manifest(part, fanout=fanout).withColumn("again", merkle.fold(F.col("leaf"), "path")) \
            .withColumn("digest", merkle.proof_digest("path")).collect()
        assert sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]))
                      for r in got) == slow_manifest(want, fanout)
        assert all(r["again"] == r["root"] and r["digest"] == sha(*(x for s in r["path"] for x in s)) for r in got)
    assert merkle.manifest(empty.withColumn("leaf", F.lit("x"))).count() == 0


def test_merkle_query(spark, nasty, tmp_path):
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path)).collect()
    leaves = {i: slow_leaf((i, source, lang, n, text)) for i, text, lang, source, n in NASTY}
    assert len(got) == len(NASTY) and all(r["leaf"] == leaves[r["doc_id"]] for r in got)
    changed = {i for i, _, _, _, n in NASTY if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    assert changed and all(r["verified"] == (r["doc_id"] not in changed) for r in got)
    assert len({r["root"] for r in got}) == 1


def test_long_chains_use_one_shuffle(spark):
    nodes = spark.range(4000).selectExpr("CAST(id % 3 AS string) AS lang", "id AS _mk_at", "4000L AS _mk_n", "sha2(string(id), 256) AS _mk_node")
    plan = merkle.climb(nodes, ["lang"], 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("Window [") == 10


# ---- languages ------------------------------------------------------------------------------

LETTERS = {"xa": "abcdefgh", "xb": "abcdeïöü", "xc": "mnopqrst"}


def sample(spark, n, seed):
    rows = [(i, prose(seed + i, 5 + i % 60, 3000, LETTERS[x]).title(), x)
            for i, x in enumerate(random.Random(seed).choices(list(LETTERS), [10, 3, 1], k=n))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def slow_subwords(text):
    """Buckets by the definition, one character run at a time."""
    out = []
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for n in range(1, languages.LONGEST + 1):
            for run in (f" {w} "[i:i + n] for i in range(len(w) + 3 - n)):
                if run != " ":
                    h = 0x811C9DC5
                    for c in run:
                        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                    h = (h * 0x9E3779B1) & 0xFFFFFFFF
                    out.append((h ^ (h >> 16)) & ((1 << languages.BITS) - 1))
    return out


def test_subwords(monkeypatch):
    texts = ["Ab c", "", "12 -- \n", None, "É😀ß_x9y ſ", prose(1, 300), "a"]
    want = [sorted(slow_subwords(t or "")) for t in texts]
    table = np.random.default_rng(1).normal(size=(1 << languages.BITS, 3))
    for size in (1 << 18, 7):
        monkeypatch.setattr(languages, "SLICE", size)
        got = languages.counted(texts)
        for w, b, s in zip(want, got["buckets"], got["shares"]):
            assert list(b) == sorted(set(w)) and s.sum() == pytest.approx(1 if w else 0)
            assert s == pytest.approx([w.count(x) / len(w) for x in b])
        mean = languages.averages([languages.padded(t or "") for t in texts], table)
        assert mean == pytest.approx(np.array([table[w].mean(0) if w else np.zeros(3) for w in want]))


def test_held_out_accuracy_and_rejection(spark, nasty, empty):
    _, train = sample(spark, 400, 1)
    model = languages.learn(train)
    assert model.languages == ("xa", "xb", "xc")
    rows, test = sample(spark, 300, 9000)
    truth = {i: x for i, _, x in rows}
    got = languages.identify(test.withColumn("score", F.lit("clash")), model).collect()
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got]
    assert len(got) == 300 and sum(right) >= 0.97 * 300 and all(0 <= r["score"] <= 1 for r in got)
    assert abs(np.mean([r["score"] for r in got]) - np.mean(right)) < 0.05  # calibrated
    accepted = [ok for r, ok in zip(got, right) if r["accepted"]]
    assert len(accepted) > 200 and np.mean(accepted) >= 0.97
    again = languages.learn(train.repartition(7))
    assert np.array_equal(again.table, model.table) and again.temperature == model.temperature
    odd = {r["doc_id"]: r for r in languages.identify(nasty, model).collect()}
    assert len(odd) == len({i for i, *_ in NASTY})
    for i in (2, 3, 4):
        assert odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and not odd[i]["accepted"]
    assert odd[5]["lang_pred"] in LETTERS
    assert languages.identify(empty, model).count() == 0
    nothing = languages.learn(empty)
    assert nothing.languages == () and {r["lang_pred"] for r in languages.identify(nasty, nothing).collect()} == {"und"}
    assert set(languages.learn(nasty).languages) == {"", "en", "fr", "é"}


def test_learning_sample_is_bounded(spark):
    _, train = sample(spark, 400, 1)
    some = languages.sample_of(train.union(train), "doc_id", "text", "lang", 50, 120).groupBy("lang").count().collect()
    assert sum(r["count"] for r in some) == 120 or max(r["count"] for r in some) <= 50
    assert len(some) == 3 and max(r["count"] for r in some) <= 50


def test_calibration():
    scores = np.array([[4.0, 0], [3, 0], [0, 2], [0, 1], [1, 0], [0.5, 0]])
    labels = np.array([0, 0, 1, 1, 0, 1])
    temperature, limit = languages.calibrate(scores, labels, 0.0)
    p = languages.softmax(scores / temperature).max(1)
    assert p[4] >= limit > p[5]
    assert languages.calibrate(np.zeros((0, 2)), np.zeros(0, int), 0.1) == (1.0, 0.0)
