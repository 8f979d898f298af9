"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of shingles are counted over all documents in a fixed number of hash buckets (feature hashing),
   and give every shingle of a document its weight: times in the document * idf, with idf scaled to floor..1.
2. Consistent weighted sampling draws ``HASHES`` samples per document; two documents agree in a sample with the
   probability of their weighted Jaccard similarity. Samples are banded.
3. Equal word sequences are one class from the start and appear once from here on.
4. In every bucket each document is paired with the bucket's smallest key; every document keeps the pair that most
   bands propose. Those pairs are verified by exact weighted Jaccard similarity and joined to components.
5. Where buckets still hold several components, components with members of a bucket that may reach the threshold
   (samples agree to at least ``ESTIMATE``, four standard deviations below it) form families. Each document of a family
   is compared with all of the family in other components, in blocks: by the samples, and if those may reach the
   threshold exactly, until the two are in one component. So no pair that shares a bucket is left out. Only the edges
   that join components leave a block, never the pairs of a group. The work of this step grows with the square of a
   family of documents that are similar, but not by ``THRESHOLD``.

Texts are fetched for documents that share a bucket only. Documents without a word, null texts included, are classes of
their own. Repeated rows are equal documents of one class. Texts of fewer than five words are one shingle. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import whole
from hopframe.llm.components import connected_components
from hopframe.llm.shingles import mix, shingles, slices, text_keys, words
from hopframe.session import materialize

HASHES, BANDS = 64, 16
ROWS = HASHES // BANDS
BUCKETS = 1 << 18  # of the document frequencies
FILTER_BITS = 24
TABLE_BITS = 14  # log of the rows of the random table of a sample
THRESHOLD, ESTIMATE = 0.8, 0.6
BLOCK, TEXT_BLOCK = 2048, 256  # rows compared at once, by samples and by text


def document_frequencies(docs: DataFrame, text_col="text") -> tuple[np.ndarray, int]:
    """Document frequencies per hash bucket, added over the shingles of the bucket, and the number of documents with
    words. BUCKETS + 1 numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, documents = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                hashes, bounds = words(data, offsets)
                _, shingle, _ = shingles(hashes, bounds)
                totals += np.bincount((shingle % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                documents += int((np.diff(bounds) > 0).sum())
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(seen, BUCKETS).astype(np.int32),
                                          "n": np.append(totals[seen], documents)})

    table = docs.select(whole(text_col).alias("text")).mapInArrow(count, "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(BUCKETS + 1, dtype=np.int64)
    totals[table["bucket"]] = table["n"]
    return totals[:BUCKETS], int(totals[BUCKETS])


def inverse_frequencies(totals: np.ndarray, documents: int, floor=0.75) -> np.ndarray:
    """idf per bucket, from ``floor`` for a shingle of all documents to 1 for one of none."""
    scale = np.log1p(documents) or 1.0
    rare = np.log((1 + documents) / (1 + np.minimum(totals, documents))) / scale
    return (floor + (1 - floor) * rare).astype(np.float32)


def random_tables(seed=1) -> list[tuple]:
    """Per sample: an odd multiplier and tables of log c - r, r, 1 / r and beta (r, c ~ Gamma(2, 1), beta uniform)."""
    if seed in _TABLES:
        return _TABLES[seed]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(HASHES):
        multiplier = np.uint64(int(rng.integers(0, 1 << 62)) * 4 + 1)
        r, c = rng.gamma(2, 1, 1 << TABLE_BITS), rng.gamma(2, 1, 1 << TABLE_BITS)
        out.append((multiplier, (np.log(c) - r).astype(np.float32), r.astype(np.float32),
                    (1 / r).astype(np.float32), rng.random(1 << TABLE_BITS).astype(np.float32)))
    _TABLES[seed] = out
    return out


_TABLES: dict[int, list[tuple]] = {}  # one set per process


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """HASHES 64-bit samples for every text in ``text`` (sorted), one row each."""
    fresh = np.append(True, text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(text)))
    row = np.cumsum(fresh) - 1
    log_weight = np.log(weight).astype(np.float32)
    out = np.empty((len(first), HASHES), dtype=np.uint64)
    for k, (multiplier, c_less_r, r, inverse_r, beta) in enumerate(random_tables()):
        at = ((shingle * multiplier) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
        level = inverse_r.take(at)
        level *= log_weight
        level += beta.take(at)
        floor = np.floor(level)
        level -= floor
        level *= r.take(at)
        level += c_less_r.take(at)
        level -= log_weight  # the log of a of the sampling scheme: log c - r - log w + r * fraction
        hit = np.flatnonzero(level == np.repeat(np.minimum.reduceat(level, first), size))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]  # ties: the smallest shingle
        out[:, k] = mix(shingle[hit] + mix(floor[hit].astype(np.int64).astype(np.uint64)))
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(drawn), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys + drawn[:, k::ROWS])
    return keys.astype(np.int64)


def weighted(data, offsets, idf):
    """(word bounds, keys, text, shingle, weight) of a slice."""
    hashes, bounds = words(data, offsets)
    text, shingle, times = shingles(hashes, bounds)
    weight = times * idf[(shingle % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)
    return text_keys(hashes, bounds), text, shingle, weight


def signatures(docs: DataFrame, idf, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text_hash, key of the word sequence, bands (BANDS longs) and drawn (HASHES 32-bit samples); null without words."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")) \
        .withColumn("text_hash", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column("text")):
                keys, text, shingle, weight = weighted(data, offsets, idf.value)
                rows = len(keys)
                bands: list = [None] * rows
                drawn: list = [None] * rows
                if len(text):
                    made = samples(text, shingle, weight)
                    small = made.astype(np.uint32)
                    for i, row in enumerate(np.unique(text)):
                        drawn[row] = small[i].tobytes()
                    for row, band in zip(np.unique(text), band_keys(made)):
                        bands[row] = band
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, rows), batch.column("text_hash").slice(at, rows),
                     pa.array(keys, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(drawn, pa.binary())],
                    names=["doc_id", "text_hash", "key", "bands", "drawn"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(sign, f"doc_id {kind}, text_hash long, key binary, bands array<bigint>, drawn binary")


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit per possible value of the last FILTER_BITS bits of a key, set for the given keys.

    Of fixed size: where very many keys are given it lets more texts through, and the join that follows sorts those out.
    """
    tail = F.conv(F.hex(F.expr("substring(key, 9, 8)")), 16, 10).cast("decimal(20,0)") % F.lit(1 << FILTER_BITS)
    found = keys.select(tail.cast("int").alias("bit")) \
        .groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, bit % 64))").alias("bits")).toPandas()
    bits = np.zeros((1 << FILTER_BITS) // 64, dtype=np.int64)
    bits[found["word"]] = found["bits"]
    return bits.view(np.uint64)


def wanted_texts(docs: DataFrame, wanted: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(key, text) for the (doc_id, key) in ``wanted``: only texts that pass the filter of keys are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted))  # 2^FILTER_BITS bits
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, data, offsets in slices(batch.column("text")):
                keys += text_keys(*words(data, offsets))
            tail = np.array([int.from_bytes(k[8:], "big") % (1 << FILTER_BITS) if k else 0 for k in keys], dtype=np.int64)
            passed = (bits.value[tail // 64] >> (tail % 64).astype(np.uint64)) & np.uint64(1)
            mask = passed.astype(bool) & np.array([k is not None for k in keys], dtype=bool)
            made = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), batch.column("text")], names=["doc_id", "key", "text"])
            yield made.filter(pa.array(mask, pa.bool_()))

    kind = dict(source.dtypes)["doc_id"]
    found = source.mapInArrow(pick, f"doc_id {kind}, key binary, text string")
    return found.alias("d").join(wanted.alias("w"), F.expr("d.key = w.key AND d.doc_id <=> w.doc_id")) \
        .select("d.key", "d.text")


def weighted_sets(column: pa.Array, idf) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(sorted shingles, weights, total weight) of every text."""
    for _, data, offsets in slices(column):
        keys, text, shingle, weight = weighted(data, offsets, idf.value)
        ends = np.searchsorted(text, np.arange(len(keys) + 1))
        for i in range(len(keys)):
            part = weight[ends[i]:ends[i + 1]]
            yield shingle[ends[i]:ends[i + 1]], part, float(part.sum())


def alike(x: tuple, y: tuple, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two weighted sets reaches the threshold."""
    if min(x[2], y[2]) < threshold * max(x[2], y[2]) or not len(x[0]) or not len(y[0]):
        return False
    small, large = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    at = np.minimum(np.searchsorted(large[0], small[0]), len(large[0]) - 1)
    both = large[0][at] == small[0]
    shared = float(np.minimum(small[1][both], large[1][at[both]]).sum())
    return shared >= threshold * (x[2] + y[2] - shared)


def verified(pairs: DataFrame, idf, threshold=THRESHOLD) -> DataFrame:
    """(a, b) of the rows (a, b, text_a, text_b) whose weighted Jaccard similarity reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(at, 256)
                sides = (weighted_sets(batch.column(name), idf) for name in ("text_a", "text_b"))
                good = [alike(x, y, threshold) for x, y in zip(*sides)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


class Union:
    """Disjoint sets of 0 .. n - 1 that keep the root of every element at hand."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: int, y: int) -> None:
        self.root[self.root == self.root[y]] = self.root[x]


def _agreement(drawn: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return (drawn[others] == drawn[i]).mean(axis=1)


def _pairs_of_blocks(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, Iterator]:
    """Rows in order of key, their samples, their components as numbers, and (i, the rows that i is compared with)."""
    rows = rows.sort_values("key", kind="stable")
    drawn = np.stack([np.frombuffer(x, dtype=np.uint32) for x in rows["drawn"]])
    component = pd.factorize(rows["component"])[0]
    block, low, high = rows["block"].to_numpy(), rows["low"].iloc[0], rows["high"].iloc[0]
    at = np.arange(len(rows))

    def compared():
        for i in np.flatnonzero(block == low):
            yield i, np.flatnonzero((block == high) & ((at > i) if low == high else True))

    return rows, drawn, component, compared()


def neighbouring_components(members: DataFrame) -> DataFrame:
    """(a, b): components with members in one bucket whose samples agree often enough; per block pair of a bucket at
    most one pair for each component joined, which leaves them connected."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows, drawn, component, compared = _pairs_of_blocks(rows)
        joined, names, a, b = Union(component.max() + 1), rows["component"].to_numpy(), [], []
        for i, others in compared:
            others = others[joined.root[component[others]] != joined.root[component[i]]]
            for j in others[_agreement(drawn, i, others) >= ESTIMATE]:
                if joined.root[component[j]] != joined.root[component[i]]:
                    joined.join(component[i], component[j])
                    a.append(names[i])
                    b.append(names[j])
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    return members.groupBy("band", "bucket", "low", "high").applyInPandas(compare, "a binary, b binary")


def cross_edges(members: DataFrame, idf, threshold=THRESHOLD) -> DataFrame:
    """(a, b) that join components of a family: within a block pair every pair of different components whose samples
    agree often enough is verified, most agreeing first, until it is inside one component. At most one edge per
    component joined leaves the block pair."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows, drawn, component, compared = _pairs_of_blocks(rows)
        left, right, agreement = [], [], []
        for i, others in compared:
            others = others[component[others] != component[i]]
            agree = _agreement(drawn, i, others)
            near = agree >= ESTIMATE
            left.append(np.full(int(near.sum()), i))
            right.append(others[near])
            agreement.append(agree[near])
        left, right, agreement = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (left, right, agreement))
        used = np.unique(np.concatenate((left, right)))
        texts = rows["text"].to_numpy()
        sets = dict(zip(used, weighted_sets(pa.array([texts[i] for i in used], pa.string()), idf)))
        joined, keys, a, b = Union(component.max() + 1), rows["key"].to_numpy(), [], []
        for k in np.argsort(-agreement, kind="stable"):
            i, j = left[k], right[k]
            if joined.root[component[i]] != joined.root[component[j]] and alike(sets[i], sets[j], threshold):
                joined.join(component[i], component[j])
                a.append(keys[i])
                b.append(keys[j])
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    return members.groupBy("family", "low", "high").applyInPandas(compare, "a binary, b binary")


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Deals the ``n`` members of each group by hash into blocks of about ``size``, a copy of a row per block that it
    meets: adds block, low and high, the numbers of the two blocks."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    return members.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")) \
        .withColumn("against", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .withColumn("low", F.least("block", "against")).withColumn("high", F.greatest("block", "against")) \
        .drop("against", "n")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD) -> DataFrame:
    """doc_id, text_hash, class_id, is_first: one row per document with the smallest id of its class.

    ``is_first`` marks the document of that id; ``text_hash`` (xxhash64 of the text) tells apart documents of one id.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs, text_col)))  # BUCKETS numbers
    signed = materialize(signatures(docs, idf, id_col, text_col), "mh-signatures")
    unique = materialize(
        signed.where("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("drawn").alias("drawn")),
        "mh-unique")
    banded = unique.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = materialize(banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("head"))
                          .where("n > 1"), "mh-buckets")
    members = materialize(banded.join(buckets, ["band", "bucket"]), "mh-members")
    proposed = members.where("key != head").groupBy("key", "head").agg(F.count("*").alias("n")) \
        .groupBy("key").agg(F.max(F.struct("n", "head")).alias("best")) \
        .select(F.col("best.head").alias("a"), F.col("key").alias("b"))
    wanted = materialize(members.select("key").distinct().join(unique.select("key", "doc_id"), "key"), "mh-wanted")
    texts = materialize(wanted_texts(docs, wanted, id_col, text_col), "mh-texts")
    edges = materialize(verified(with_texts(proposed, texts), idf, threshold), "mh-edges")
    component = connected_components(edges)

    component = materialize(
        wanted.select("key").alias("w").join(component.alias("c"), F.expr("w.key = c.node"), "left")
        .select("key", F.coalesce("component", "key").alias("component")), "mh-component")
    placed = materialize(members.select("key", "band", "bucket", "n").join(component, "key"), "mh-placed")
    mixed = materialize(
        placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high").select("band", "bucket"), "mh-mixed")
    drawn = unique.select("key", "drawn")
    near = materialize(neighbouring_components(
        in_blocks(placed.join(mixed, ["band", "bucket"]).join(drawn, "key"), BLOCK)), "mh-neighbours")
    family = connected_components(near).select(F.col("node").alias("component"), F.col("component").alias("family"))
    related = materialize(component.join(family, "component"), "mh-related")
    counts = materialize(related.groupBy("family").agg(F.count("*").alias("n")), "mh-families")
    related = related.join(counts, "family").join(drawn, "key").join(texts, "key")
    more = materialize(cross_edges(in_blocks(related, TEXT_BLOCK), idf, threshold), "mh-more")
    component = connected_components(edges.union(more))

    classed = materialize(
        signed.select("doc_id", "text_hash", "key").alias("s")
        .join(component.alias("c"), F.expr("s.key = c.node"), "left")
        .select("doc_id", "text_hash", F.coalesce("component", "key").alias("component")), "mh-classed")
    document = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    smallest = materialize(classed.where("component IS NOT NULL").groupBy("component")
                           .agg(F.min(document).alias("first")), "mh-classes")
    return classed.join(smallest, "component", "left").select(
        "doc_id", "text_hash", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
        .alias("class_id"),
        F.expr("first IS NULL OR (first.doc_id <=> doc_id AND first.text_hash = text_hash)").alias("is_first"))
