"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, accents off, look-alike letters and digits to plain letters, lower case) and
searched once with an Aho-Corasick automaton of all lexicon patterns. A pattern is a whole word, a beginning of words or
a phrase. Hits inside an exception phrase do not count. The score is a logistic function of the weight sum and of the
weight sum normalised by length.

The lexicon is learned from labelled documents: beginnings of words and whole words are counted by label, and the
shortest that are surely more frequent in toxic documents enter, weighted by log odds; words under a beginning that are
surely more frequent in clean documents become exceptions, beside a few fixed phrases. At most ``max_rows`` labelled rows
are used, those with the smallest hash of their id, so the cost of learning does not grow with the corpus. At most
``max_patterns`` patterns and as many exceptions reach the driver.

Null texts count as empty. An empty text, or one without hits, has the score of zero weight. Repeated rows get the same
score. Without labelled rows of both kinds the default lexicon and scale are used. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import map_texts, sample_rows, whole
from hopframe.session import materialize

# Digits that stand for letters, and letters of other scripts that look like Latin ones.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһкмтвнοαερτυνικ", "aeopcyxijsdhkmtbhoaeptuvik"))
TABLE = {ord(a): b for a, b in LOOK_ALIKES.items()}
DIGIT_TABLE = {ord(a): b for a, b in DIGITS.items()}
MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]+")
WORD = re.compile(r"[^\W_]+")
MIXED = re.compile(r"[a-z]+[013457]+[a-z0-9]*|[013457]+[a-z][a-z0-9]*")

# A short list of insults, used alone only where nothing can be learned.
DEFAULT_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")
DEFAULT_EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pathetic fallacy")


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and digit substitutions; digits change only inside mixed words."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = text.lower().translate(TABLE)
    else:
        text = text.lower()
    return MIXED.sub(lambda m: m.group().translate(DIGIT_TABLE), text)


@dataclass
class Lexicon:
    """Weights of patterns and the scale of the score.

    ``words`` are whole words or phrases, ``beginnings`` match at the beginning of words. All are folded.
    """

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS
    bias: float = -3.0
    by_sum: float = 2.0
    by_length: float = 2.0

    @classmethod
    def default(cls) -> Lexicon:
        return cls(words={w: 2.0 for w in DEFAULT_WORDS})

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, list] = {}
        for kind, patterns in (("word", self.words), ("begin", self.beginnings)):
            for pattern, weight in patterns.items():
                found.setdefault(pattern, []).append((kind, weight))
        for phrase in self.exceptions:
            found.setdefault(phrase, []).append(("except", 0.0))
        machine = ahocorasick.Automaton()
        for pattern, uses in found.items():
            machine.add_word(pattern, (len(pattern), uses))
        machine.make_automaton()
        return machine


def hits(folded: str, machine: ahocorasick.Automaton) -> list[float]:
    """Weights of the lexicon hits outside exception phrases."""
    if not machine:
        return []
    found, spared, size = [], [], len(folded)
    for last, (length, uses) in machine.iter(folded):
        start, end = last - length + 1, last + 1
        if start and folded[start - 1].isalnum():
            continue
        closed = end == size or not folded[end].isalnum()
        for kind, weight in uses:
            if kind == "begin" or closed:
                (spared if kind == "except" else found).append((start, end, weight))
    if not spared:
        return [w for _, _, w in found]
    # Of the exceptions that begin no later than a hit, the one that reaches farthest decides.
    spared.sort()
    starts = [a for a, _, _ in spared]
    reach = list(accumulate((b for _, b, _ in spared), max))
    return [w for s, e, w in found if not (k := bisect_right(starts, s)) or reach[k - 1] < e]


def features(texts: list[str], machine: ahocorasick.Automaton) -> np.ndarray:
    """Per text: log of one plus the weight sum, the same for the weight sum per square root of words, and the sum."""
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        total = sum(hits(fold(text), machine)) if text else 0.0
        if total:
            out[i] = math.log1p(total), math.log1p(total / math.sqrt(1 + text.count(" "))), total
    return out


def pattern_counts(labelled: DataFrame, shortest=3, longest=8) -> DataFrame:
    """pattern, toxic, clean from (text, toxic): documents per label with a beginning ``^x`` or a whole word ``^x$``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"]):
                patterns = set()
                for word in set(WORD.findall(fold(text or ""))):
                    if len(word) >= shortest and word.isalpha():
                        patterns.add(word + "$")
                        patterns.update(word[:k] for k in range(shortest, min(longest, len(word) - 1) + 1))
                seen[int(toxic)].update(patterns)
            both = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"pattern": both, "toxic": [seen[1][p] for p in both],
                                "clean": [seen[0][p] for p in both]})

    return labelled.mapInPandas(count, "pattern string, toxic long, clean long") \
        .groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_rows=20000) -> DataFrame:
    """(text, toxic) of the labelled rows with the smallest hash of their id, at most ``max_rows``."""
    chosen = labels.where(F.col("toxic").isNotNull()) \
        .select(F.col(id_col).alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")) \
        .distinct()
    chosen = sample_rows(chosen, "doc_id", 17, max_rows)
    # Bounded: max_rows ids and labels.
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(chosen), "doc_id").select(whole("text").alias("text"), "toxic") \
        .dropDuplicates(["text", "toxic"])


def odds_bounds(n_toxic: int, n_clean: int, z: float) -> tuple[Column, Column]:
    """Lower and upper bound of the log odds ratio of toxic against clean documents, ``z`` standard errors away."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    t_rest, c_rest = F.lit(n_toxic + 0.5) - F.col("toxic"), F.lit(n_clean + 0.5) - F.col("clean")
    odds = F.log(t) - F.log(t_rest) - F.log(c) + F.log(c_rest)
    error = F.sqrt(1 / t + 1 / t_rest + 1 / c + 1 / c_rest)
    return odds - z * error, odds + z * error


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_rows=20000, max_patterns=2000,
          sure=2.8, purity=0.95) -> Lexicon:
    """A lexicon and its scale from documents and their labels (``id_col``, ``toxic``).

    A pattern enters if the log odds of toxic documents are above zero by ``sure`` standard errors, a rule that is the
    same for every number of rows, and if, were both labels equally frequent, a share of ``purity`` of the documents
    that have it were toxic. Whole words under a beginning that enters become exceptions if their log odds are below
    zero by ``sure`` standard errors. At most ``max_patterns`` patterns and as many exceptions are kept.
    """
    rows = labelled_rows(docs, labels, id_col, text_col, max_rows).persist()
    try:
        total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
        if not n_toxic or not n_clean:
            return Lexicon.default()
        low, high = odds_bounds(n_toxic, n_clean, sure)
        rate = F.col("toxic") / n_toxic / ((F.col("toxic") / n_toxic) + (F.col("clean") + 0.5) / n_clean)
        counts = pattern_counts(rows).where((low > 0) & (rate >= purity) | (F.col("pattern").endswith("$") & (high < 0)))
        counts = materialize(counts.withColumn("enters", low > 0), "toxicity-patterns")
        listed = counts.where("enters").withColumn("chars", F.length(F.rtrim("pattern", F.lit("$")))) \
            .orderBy(F.desc("toxic"), F.asc("chars"), "pattern").limit(max_patterns).collect()
        lexicon = choose(((r["pattern"], r["toxic"], r["clean"]) for r in listed), n_toxic, n_clean)
        lexicon.exceptions += tuple(harmless(counts.where("NOT enters"), lexicon.beginnings, max_patterns))
        return scale(rows, lexicon)
    finally:
        rows.unpersist()


def harmless(counts: DataFrame, beginnings: dict[str, float], most: int) -> list[str]:
    """The whole words of ``counts`` under one of the beginnings, the most frequent ``most``."""
    if not beginnings:
        return []
    word = F.rtrim("pattern", F.lit("$"))
    # At most as many beginnings as patterns.
    known = counts.sparkSession.createDataFrame([(b,) for b in sorted(beginnings)], "beginning string")
    stems = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n)))
    found = counts.withColumn("word", word).select("word", "clean", stems.alias("beginning")) \
        .join(F.broadcast(known), "beginning").select("word", "clean").distinct()
    return [r["word"] for r in found.orderBy(F.desc("clean"), "word").limit(most).collect()]


def choose(counted, n_toxic: int, n_clean: int, same=0.8) -> Lexicon:
    """Shortest patterns first, each made as specific as its documents allow.

    A beginning is extended letter by letter, at last to a whole word, as long as one extension holds most (``same``) of its
    toxic documents; patterns under a chosen beginning are left out.
    """
    counts = {pattern: (toxic, clean) for pattern, toxic, clean in counted}
    longer: dict[str, list[str]] = {}
    for pattern in sorted(counts):
        longer.setdefault(pattern[:-1], []).append(pattern)
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    for pattern in sorted(counts, key=lambda p: (len(p.rstrip("$")), p.endswith("$"), p)):
        stem = pattern.rstrip("$")
        if any(stem[:k] in beginnings for k in range(1, len(stem) + 1)) or stem in words:
            continue
        least = same * counts[pattern][0]
        best = pattern
        while more := [p for p in longer.get(best, ()) if counts[p][0] >= least]:
            best = max(more, key=lambda p: (counts[p][0], p))
        whole_words = [p for p in counts if p.endswith("$") and p.startswith(best) and counts[p][0] >= least]
        best = max(whole_words, key=lambda p: (counts[p][0], p), default=best)
        toxic, clean = counts[best]
        weight = math.log((toxic + 0.5) / n_toxic) - math.log((clean + 0.5) / n_clean)
        (words if best.endswith("$") else beginnings)[best.rstrip("$")] = round(weight, 6)
    return Lexicon(words, beginnings)


def scale(rows: DataFrame, lexicon: Lexicon, steps=60, ridge=1e-3) -> Lexicon:
    """Fits bias and the two slopes on the labelled rows (two numbers each) by Newton steps."""
    patterns = lexicon

    def compute():
        machine = patterns.automaton()

        def values(texts):
            f = features(texts, machine)
            return {"a": f[:, 0], "b": f[:, 1]}

        return values

    table = map_texts(rows, "text", "a double, b double", compute, per_task=True).toPandas()
    x = np.column_stack((np.ones(len(table)), table["a"], table["b"]))
    y = table["toxic"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * len(y) * w * [0, 1, 1]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag([1e-6, 1, 1]) + 1e-9 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    lexicon.bias, lexicon.by_sum, lexicon.by_length = (round(float(v), 9) for v in w)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col="doc_id", text_col="text", keep=(),
          names=("weight", "score")) -> DataFrame:
    """``id_col``, the columns in ``keep``, weight and score (0 to 1) per document, the latter two as ``names``."""

    def compute():
        machine = lexicon.automaton()

        def values(texts):
            f = features(texts, machine)
            z = lexicon.bias + lexicon.by_sum * f[:, 0] + lexicon.by_length * f[:, 1]
            return {names[0]: f[:, 2], names[1]: 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

        return values

    columns = [id_col, *[c for c in keep if c not in (id_col, text_col)], text_col]
    return map_texts(docs.select(*columns), text_col, f"`{names[0]}` double, `{names[1]}` double", compute,
                     keep_text=text_col in keep, per_task=True)
