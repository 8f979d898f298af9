"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters separates words, and the character runs of 1 to ``LONGEST`` inside the
padded words (the subwords) are hashed to buckets. The embeddings of all subwords are averaged and a linear layer with
softmax gives a probability per language. Embeddings and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows whose subwords Spark has counted. A fifth of the sample is kept out of
training: it gives the temperature that calibrates the probabilities and the smallest score at which at most ``error``
of the accepted rows are wrong; rows below are not ``accepted``.

The sample holds at most ``per_language`` rows of a language and ``max_rows`` in all, rows with the smallest hash of
their id, so every language takes part before one has all its rows in. Long texts are used whole, in slices.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing was learned. Rows without
id, text or language are not learned from; rows that repeat id and language count once. Repeated rows get the same
result. Other columns are not looked at, and clashing ones are replaced by the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import map_texts, whole
from hopframe.session import materialize

UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
BITS = 15
LONGEST = 4
SLICE = 1 << 18
SPACE = 32
PLACES = 1 << 40


@dataclass(frozen=True)
class Model:
    """Score of every bucket for every language (embedding times layer), bias, temperature and smallest score."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        return softmax((averages + self.bias) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def padded(text: str) -> str:
    """Words in lower case with one space before, between and after them; empty if the text has no letter."""
    words = NO_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every subword of the padded texts, a slice and a length at a time."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for at in range(0, len(codes), SLICE):
        part = codes[at:at + SLICE + LONGEST - 1]
        gap = part == SPACE
        h = np.full(len(part), 0x811C9DC5, np.uint32)
        inner = np.zeros(len(part), bool)  # a space that is neither first nor last
        for n in range(1, LONGEST + 1):
            size = min(SLICE, len(part) - n + 1)
            if size <= 0:
                break
            h = (h[:size] ^ part[n - 1:n - 1 + size]) * np.uint32(0x01000193)
            if n > 2:
                inner = inner[:size] | gap[n - 2:n - 2 + size]
            keep = ~(gap[:size] & (n == 1)) & ~inner[:size]
            if n == 2:
                keep &= ~(gap[:size] & gap[1:1 + size])
            mixed = h[keep] * np.uint32(0x9E3779B1)
            yield owner[at:at + size][keep], (mixed ^ (mixed >> np.uint32(16))) & np.uint32((1 << BITS) - 1)


def averages(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over the subwords of every text; 0 for texts without any."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for owner, bucket in subwords(texts):
        if len(owner):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[starts]] += np.add.reduceat(table[bucket], starts, axis=0)
            count += np.bincount(owner, minlength=len(texts))
    return total / np.maximum(count, 1)[:, None]


def counted(texts: list[str | None]) -> dict:
    """Distinct buckets of every text and their shares."""
    tidy = [padded(t or "") for t in texts]
    found = [(np.empty(0, int), np.empty(0, np.uint32)), *subwords(tidy)]
    pairs, n = np.unique(np.concatenate([(o.astype(np.int64) << BITS) | b for o, b in found]), return_counts=True)
    owner, cuts = pairs >> BITS, np.arange(1, len(tidy))
    at = np.searchsorted(owner, cuts)
    shares = n / np.bincount(owner, n, minlength=len(tidy))[owner]
    return {"buckets": [x & ((1 << BITS) - 1) for x in np.split(pairs, at)], "shares": np.split(shares, at)}


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, dim=8, epochs=12, batch=32,
            rate=20.0, seed=5) -> tuple[np.ndarray, np.ndarray]:
    """Table of bucket scores per label and bias, by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, n_labels), np.float32), np.zeros(n_labels, np.float32)
    dense = np.zeros((batch, 1 << BITS), np.float32)
    steps = epochs * max(1, -(-len(rows) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            chosen = order[at:at + batch]
            x = dense[:len(chosen)]
            for k, i in enumerate(chosen):
                x[k, rows[i][0]] = rows[i][1]
            hidden = x @ embedding
            wrong = softmax(hidden @ layer + bias)
            wrong[np.arange(len(chosen)), labels[chosen]] -= 1
            wrong /= len(chosen)
            pace = np.float32(rate * (1 - step / steps))
            back = x.T @ (wrong @ layer.T)
            layer -= pace * (hidden.T @ wrong)
            bias -= np.float32(0.01) * pace * wrong.sum(0)
            embedding -= pace * back
            for k, i in enumerate(chosen):
                x[k, rows[i][0]] = 0
            step += 1
    return embedding @ layer, bias


def calibrate(scores: np.ndarray, labels: np.ndarray, error: float) -> tuple[float, float]:
    """Temperature of the smallest log loss, and the smallest score at which at most ``error`` of the rows are wrong."""
    if not len(scores):
        return 1.0, 0.0
    grid = np.geomspace(0.02, 20, 70)
    at = np.arange(len(labels))
    loss = [-np.log(softmax(scores / t)[at, labels] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(scores / temperature)
    best, right = p.max(1), p.argmax(1) == labels
    order = np.argsort(-best, kind="stable")
    fine = np.flatnonzero(np.cumsum(~right[order]) <= error * (at + 1))
    if not len(fine):
        return temperature, 1.0
    return temperature, float(best[order][fine[-1]]) if fine[-1] + 1 < len(best) else 0.0


def fit(parts: Iterator[pd.DataFrame], error: float) -> Iterator[pd.DataFrame]:
    """One model row from all rows of the sample: languages, table, bias, temperature, limit."""
    sample = pd.concat(list(parts) or [pd.DataFrame({"lang": [], "place": [], "buckets": [], "shares": []})])
    sample = sample[sample["buckets"].map(len) > 0].sort_values(["place", "lang"], kind="stable")
    if not len(sample):
        return
    names = sorted(sample["lang"].unique())
    labels = sample["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
    rows = list(zip(sample["buckets"].map(np.asarray), sample["shares"].map(lambda s: np.asarray(s, np.float32))))
    held = sample.groupby("lang").cumcount().to_numpy() % 5 == 4
    table, bias = descend([r for r, h in zip(rows, held) if not h], labels[~held], len(names))
    scores = np.array([s @ table[b] for (b, s), h in zip(rows, held) if h]).reshape(-1, len(names)) + bias
    temperature, limit = calibrate(scores, labels[held], error)
    yield pd.DataFrame({"languages": [names], "table": [table.astype("<f4").tobytes()],
                        "bias": [bias.astype("<f4").tobytes()], "temperature": [temperature], "limit": [limit]})


def sample_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_rows: int) -> DataFrame:
    """lang, place and text of the rows to learn from; the texts are fetched for chosen rows only.

    Rows far above a language's expected limit are dropped by their hash before any row is sorted.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL") \
        .withColumn("place", F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(PLACES)))
    sizes = materialize(labelled.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")), "language-sizes")
    near = F.col("place") < F.lit(PLACES) * (2 * per_language + 100) / F.col("n")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))
    chosen = labelled.select("id", "lang", "place").join(sizes, "lang").where(near).drop("n").distinct() \
        .withColumn("turn", turn).where(F.col("turn") <= per_language).orderBy("turn", "place", "lang", "id").limit(max_rows)
    chosen = materialize(chosen.select("id", "lang"), "language-sample")  # at most ``max_rows`` ids
    return labelled.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang", "place").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language=500, max_rows=4000,
          error=0.01) -> Model:
    """A model of the labelled rows of ``docs``; ``sample_of`` bounds how many are used."""
    sample = sample_of(docs, id_col, text_col, lang_col, per_language, max_rows)
    features = map_texts(sample.repartition("id"), "text", "buckets array<int>, shares array<float>", counted, rows=64)
    found = features.select("lang", "place", "buckets", "shares").repartition(1).mapInPandas(
        lambda parts: fit(parts, error),
        "languages array<string>, table binary, bias binary, temperature double, limit double").collect()
    if not found:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    r = found[0]
    bias = np.frombuffer(r["bias"], "<f4")
    return Model(tuple(r["languages"]), np.frombuffer(r["table"], "<f4").reshape(-1, len(bias)), bias,
                 r["temperature"], r["limit"])


def identify(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """All columns of ``docs`` but the text, with lang_pred, score (calibrated probability) and accepted."""
    def run(texts: list[str]) -> dict:
        tidy = [padded(t) for t in texts]
        known = np.array([bool(t) for t in tidy], bool) & bool(model.languages)
        if not known.any():
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "accepted": [False] * len(texts)}
        p = model.probabilities(averages(tidy, model.table))
        best, score = p.argmax(1), np.minimum(p.max(1), 1.0)
        return {"lang_pred": [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)],
                "score": np.where(known, score, 0.0).tolist(), "accepted": (known & (score >= model.limit)).tolist()}

    clash = {"lang_pred", "score", "accepted"}
    source = docs.select(*[c for c in docs.columns if c != text_col and c not in clash], whole(text_col).alias(text_col))
    return map_texts(source, text_col, "lang_pred string, score double, accepted boolean", run)
