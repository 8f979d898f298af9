"""Secret scan: patterns of known secrets plus strings that look random to character Markov models.

Two Markov models of character transitions are trained on labelled samples, one on random strings, one on ordinary
identifiers. A run of identifier characters is a secret if the log-likelihood ratio of the two models, per character, exceeds a threshold.
Training counts are gathered over a bounded sample of labelled strings (``max_samples`` per label); when the documents
are the source, values of the known patterns are labelled random, other runs from the same documents ordinary.

Positions are code points, ends exclusive. Null and empty texts have no spans. A very long text is one string of a task.
Repeated rows get the same result each.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import map_texts, sample_rows, whole

# The patterns, their least lengths and their order in the contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
THRESHOLD = 3.0  # of the mean log-likelihood ratio per character
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0 stands for the start of a string
STATES = len(ALPHABET) + 1
BYTE_CODE = np.zeros(128, dtype=np.int64)
for _c, _i in CODE.items():
    BYTE_CODE[ord(_c)] = _i


def codes(run: str) -> np.ndarray:
    return BYTE_CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]


def pairs(run: str) -> np.ndarray:
    """The transitions of a run, the start included, as previous * STATES + next."""
    c = codes(run)
    return np.concatenate(([0], c[:-1])) * STATES + c


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Model:
    """Log-likelihood ratio per transition of two character Markov models.

    Transitions are smoothed towards the frequencies of single characters, which count as ``smoothing`` observations,
    so characters that one kind of string hardly ever has speak for the other after any character.
    """

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    @classmethod
    def from_counts(cls, random: np.ndarray, ordinary: np.ndarray, smoothing=8.0) -> Model:
        def log_probability(counts):
            table = counts.reshape(STATES, STATES)[:, 1:].astype(float)
            single = table.sum(axis=0) + 0.5
            table += smoothing * single / single.sum()
            return np.log(table / table.sum(axis=1, keepdims=True))

        ratio = np.zeros((STATES, STATES))
        ratio[:, 1:] = log_probability(random) - log_probability(ordinary)
        return cls(ratio.ravel())

    def score(self, run: str) -> float:
        """Mean log-likelihood ratio per character; above 0, random is likelier."""
        return float(self.ratio[pairs(run)].mean())


def synthetic_random(number: int, seed=11) -> list[str]:
    """Labelled random strings in the usual alphabets (hex, upper-case keys, base64), from a seeded generator."""
    rng = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:64])
    out = []
    for i in range(number):
        letters = alphabets[i % len(alphabets)]
        out.append("".join(letters[j] for j in rng.integers(0, len(letters), 20 + i % 25)))
    return out


def labelled_samples(docs: DataFrame, id_col="doc_id", text_col="text", max_documents=4000) -> DataFrame:
    """(run, random): values of the known patterns, and ordinary words and runs, of a bounded sample of documents.

    The sample is the ``max_documents`` rows with the smallest hash of their id, so it repeats and its size does not
    grow with the corpus.
    """
    chosen = sample_rows(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), "doc_id", 29,
                         max_documents)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                covered = base_spans(text)
                rows += [(text[s:e].rsplit("=", 1)[-1].strip("\"' :"), True) for s, k, e in covered if k]
                inside = np.zeros(len(text) + 1, dtype=bool)
                for s, _, e in covered:
                    inside[s:e] = True
                for m in re.finditer(r"[A-Za-z0-9+/_=-]{4,}", text):
                    digits = sum(c.isdigit() for c in m.group())
                    if not inside[m.start()] and (digits * 4 <= len(m.group()) or digits == len(m.group())):
                        rows.append((m.group(), False))
            yield pd.DataFrame(rows, columns=["run", "random"])

    return chosen.select("text").mapInPandas(label, "run string, random boolean")


def train(samples: DataFrame, synthetic=3000, smoothing=8.0) -> Model:
    """Models from (run, random); the transition counts are summed on the executors, at most STATES^2 rows per label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, STATES * STATES), dtype=np.int64)
        for batch in batches:
            for run, random in zip(batch["run"], batch["random"]):
                if run and RUN_CHARACTERS.fullmatch(run):
                    np.add.at(totals[int(random)], pairs(run), 1)
        for label in (0, 1):
            seen = np.flatnonzero(totals[label])
            yield pd.DataFrame({"random": bool(label), "pair": seen, "n": totals[label][seen]})

    summed = samples.mapInPandas(count, "random boolean, pair long, n long") \
        .groupBy("random", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, STATES * STATES))
    for random, pair, n in summed.collect():
        counts[int(random), pair] += n
    for run in synthetic_random(synthetic):
        np.add.at(counts[1], pairs(run), 1)
    return Model.from_counts(counts[1], counts[0], smoothing)


RUN_CHARACTERS = re.compile(r"[A-Za-z0-9+/_=-]+")


def random_spans(text: str, model: Model, taken: list[tuple[int, int, int]], threshold: float) -> list:
    """Runs of the method that no base span covers."""
    found = []
    for m in RUN.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in taken):
            continue
        if model.score(m.group()) >= threshold:
            found.append((m.start(), 3, m.end()))
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", threshold=THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, comma-joined)."""
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)  # STATES^2 numbers, 38 kB

    def find(texts: list[str]) -> dict:
        judge = Model(ratio.value)
        out: dict[str, list] = {name: [] for name in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
        for text in texts:
            base = base_spans(text)
            every = sorted(base + random_spans(text, judge, base, threshold))
            for number, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(k == number for _, k, _ in every))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
        return out

    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return map_texts(source, "text", "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, "
                                     "spans string", find)
