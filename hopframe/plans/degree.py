"""Degree statistics, histograms and power-law fit.

Everything past the first aggregate works on the degree histogram ``degree, n``. A graph
with E edge ends has at most sqrt(2 E) distinct degrees, so that table is small whatever
the graph (under two million rows for 10^12 edges).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.session import materialize


def degrees(vertices: DataFrame, edges: DataFrame, end: str = "src") -> DataFrame:
    """``id, degree`` with zero-degree vertices; ``end`` is src, dst or both."""
    ends = (edges.select(F.explode(F.array("src", "dst")).alias("_e")) if end == "both"
            else edges.select(F.col(end).alias("_e")))
    counted = ends.groupBy("_e").agg(F.count(F.lit(1)).alias("_d"))
    return (vertices.select("id").join(counted, F.col("id") == F.col("_e"), "left")
            .select("id", F.coalesce("_d", F.lit(0)).cast("bigint").alias("degree")))


def histogram(degs: DataFrame) -> DataFrame:
    return degs.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def stats(hist: DataFrame) -> DataFrame:
    """One row: vertices, edges, max, min, mean and median degree."""
    d, n = F.col("degree"), F.col("n")
    return hist.agg(F.sum(n).alias("vertices"), F.sum(d * n).alias("edges"),
                    F.max(d).alias("max_degree"), F.min(d).alias("min_degree"),
                    (F.sum(d * n).cast("double") / F.sum(n).cast("double")).alias("mean_degree"),
                    F.percentile(d, 0.5, n).alias("median_degree"))


# Logarithmic bins cover degrees above LOG_FROM with LOG_EDGES edges.
LOG_FROM, LOG_EDGES = 10, 40


def log_edges(max_degree: int) -> list[float]:
    """Distinct rounded edges, evenly spaced in log10 between LOG_FROM and the largest degree."""
    step = math.log10(max_degree / LOG_FROM) / (LOG_EDGES - 1)
    return sorted({float(np.round(LOG_FROM * 10 ** (step * i))) for i in range(LOG_EDGES)})


def linear_edges(low: int, high: int, bins: int = 20) -> list[float]:
    return sorted(set(float(int(x)) for x in np.linspace(low, high + 1, bins)))


def binned(hist: DataFrame, kind: str = "log", bins: int = 20) -> DataFrame:
    """``bin_start, bin_end, vertices, percent`` of non-empty bins; the last bin is closed.

    ``log`` covers degrees above 10 only; percentages are of all vertices.
    """
    top = hist.agg(F.max("degree").alias("hi"), F.min("degree").alias("lo")).first()
    schema = "bin_start double, bin_end double, vertices bigint, percent double"
    if top["hi"] is None or (kind == "log" and top["hi"] <= LOG_FROM):
        return hist.sparkSession.createDataFrame([], schema)
    edges = log_edges(top["hi"]) if kind == "log" else linear_edges(top["lo"], top["hi"], bins)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    d = F.col("degree").cast("double")
    rank = F.least(F.size(F.filter(arr, lambda e: e <= d)), F.lit(len(edges) - 1))
    chosen = hist.filter(F.col("degree") > LOG_FROM) if kind == "log" else hist
    total = hist.agg(F.sum("n").alias("t")).scalar()
    return (chosen.groupBy(rank.alias("_b")).agg(F.sum("n").alias("vertices"))
            .select(F.element_at(arr, F.col("_b")).alias("bin_start"),
                    F.element_at(arr, F.col("_b") + 1).alias("bin_end"), "vertices",
                    (F.col("vertices").cast("double") * 100 / total.cast("double")).alias("percent")))


# ---- power law -------------------------------------------------------------

def zeta_tail(alpha, start):
    """Hurwitz zeta sum_{k >= start} k^-alpha: 32 terms, then Euler-Maclaurin (alpha > 1)."""
    alpha, start = np.asarray(alpha, float), np.asarray(start, float)
    total = sum((start + i) ** -alpha for i in range(32))
    x = start + 32
    return (total + x ** (1 - alpha) / (alpha - 1) + 0.5 * x ** -alpha
            + alpha / 12 * x ** (-alpha - 1)
            - alpha * (alpha + 1) * (alpha + 2) / 720 * x ** (-alpha - 3))


def log_zeta(alpha, start):
    """Logarithm of ``zeta_tail``, in terms of (start + i) / start, so that no power underflows."""
    alpha, start = np.asarray(alpha, float), np.asarray(start, float)
    total = sum((1 + i / start) ** -alpha for i in range(32))
    x = start + 32
    rest = x / (alpha - 1) + 0.5 + alpha / (12 * x) - alpha * (alpha + 1) * (alpha + 2) / (720 * x ** 3)
    return -alpha * np.log(start) + np.log(total + (x / start) ** -alpha * rest)


def tails(hist: DataFrame) -> DataFrame:
    """``degree, n, bin, count, log_sum``: vertices from ``degree`` upwards and the sum of their log degrees.

    Sums run within bins of an eighth of a doubling and over the few hundred bins, never over the whole histogram.
    """
    rows = hist.filter(F.col("degree") > 0).select(
        "degree", "n", F.floor(F.log2("degree") * 8).cast("int").alias("bin"),
        (F.col("n") * F.log("degree")).alias("_l"))
    upward = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("bin").agg(F.sum("n").alias("_bn"), F.sum("_l").alias("_bl")).select(
        "bin", F.coalesce(F.sum("_bn").over(upward), F.lit(0)).alias("_an"),
        F.coalesce(F.sum("_bl").over(upward), F.lit(0.0)).alias("_al"))
    within = Window.partitionBy("bin").orderBy(F.desc("degree"))
    return rows.join(bins, "bin").select(
        "degree", "n", "bin", (F.col("_an") + F.sum("n").over(within)).alias("count"),
        (F.col("_al") + F.sum("_l").over(within)).alias("log_sum"))


def best_alphas(count, log_sum, start, steps: int = 90):
    """Per tail, the exponent that maximises -count * log zeta(a, start) - a * log_sum, which is concave in a.

    The upper bound is doubled until the likelihood falls, so the optimum is inside the bracket.
    """
    count, log_sum, start = (np.asarray(x, float) for x in (count, log_sum, start))

    def value(a):
        return -count * log_zeta(a, start) - a * log_sum

    low, high = np.full(len(start), 1 + 1e-9), np.full(len(start), 2.0)
    while (rising := value(high) > value(1 + (high - 1) / 2)).any() and high.max() < 1e9:
        high = np.where(rising, 1 + 2 * (high - 1), high)
    ratio = (5 ** 0.5 - 1) / 2
    for _ in range(steps):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        lower = value(left) < value(right)
        low, high = np.where(lower, left, low), np.where(lower, high, right)
    return (low + high) / 2


def distances(degree, n, count, start: float, total: float, alpha: float):
    """Distance of the two CDFs of a tail at each of its degrees.

    The empirical CDF is flat between observed degrees, so both edges of a step count.
    """
    degree, n, count = (np.asarray(x, float) for x in (degree, n, count))
    base = log_zeta(alpha, start)
    before = np.abs(np.exp(log_zeta(alpha, degree) - base) - count / total)
    after = np.abs(np.exp(log_zeta(alpha, degree + 1) - base) - (count - n) / total)
    return np.maximum(before, after)


def power_law_fit(hist: DataFrame, at_once: int = 32) -> DataFrame:
    """One row ``alpha, xmin, ks, n_tail``: the tail start with the smallest KS distance.

    Candidate starts are all distinct degrees but the largest. Exponents come from the running sums alone. The distance
    at the first degree of every bin bounds a candidate's KS distance from below; candidates are scanned in the order
    of that bound, ``at_once`` per pass over the histogram, until no bound is below the best distance. So no candidate
    is left out unseen, and the driver holds the bins and ``at_once`` candidates only.
    """
    spark = hist.sparkSession
    # Executors need not have this package installed: ship the helpers with the functions.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    table = materialize(tails(hist), "degree-tails")
    schema = "alpha double, xmin bigint, ks double, n_tail bigint"
    top = table.agg(F.max("degree")).first()[0]
    first = table.groupBy("bin").agg(F.min(F.struct("degree", "n", "count")).alias("f")).select("f.*") \
        .orderBy("degree").collect()
    marks = tuple(np.array([r[x] for r in first], float) for x in ("degree", "n", "count"))

    def bound(batches):
        for pdf in batches:
            alpha = best_alphas(pdf["count"], pdf["log_sum"], pdf["degree"]) if len(pdf) else []
            low = []
            for k, total, a in zip(pdf["degree"], pdf["count"], alpha):
                seen = marks[0] >= k
                low.append(float(distances(*(m[seen] for m in marks), k, total, a).max()) if seen.any() else 0.0)
            yield pd.DataFrame({"xmin": pdf["degree"], "n_tail": pdf["count"], "alpha": alpha, "low": low})

    starts = materialize(table.filter(F.col("degree") < (top or 0)).mapInPandas(
        bound, "xmin bigint, n_tail bigint, alpha double, low double"), "degree-starts")
    best, seen = None, (-1.0, -1)
    while True:
        after = (F.col("low") > seen[0]) | ((F.col("low") == seen[0]) & (F.col("xmin") > seen[1]))
        some = starts.filter(after).orderBy("low", "xmin").limit(at_once).collect()
        some = [r for r in some if best is None or r["low"] <= best[0]]
        if not some:
            break
        seen = (some[-1]["low"], some[-1]["xmin"])
        tried = [(r["xmin"], r["n_tail"], r["alpha"]) for r in some]

        def scan(batches, tried=tried):
            for pdf in batches:
                out = []
                for k, total, a in tried:
                    part = pdf[pdf["degree"] >= k]
                    if len(part):
                        out.append((k, float(distances(part["degree"], part["n"], part["count"], k, total, a).max())))
                yield pd.DataFrame(out, columns=["xmin", "ks"])

        exact = {r["xmin"]: r["ks"] for r in table.mapInPandas(scan, "xmin bigint, ks double")
                 .groupBy("xmin").agg(F.max("ks").alias("ks")).collect()}
        best = min([(exact[k], k, a, total) for k, total, a in tried] + ([best] if best else []))
    return spark.createDataFrame([(best[2], best[1], best[0], best[3])] if best else [], schema)


def log_upper(z):
    """Logarithm of the upper tail of the standard normal, for any z."""
    z = np.asarray(z, float)
    near = np.array([math.log(0.5 * math.erfc(x / math.sqrt(2))) if x < 25 else 0.0 for x in z.ravel()]).reshape(z.shape)
    far = np.maximum(z, 25.0)
    series = -far ** 2 / 2 - np.log(far * math.sqrt(2 * math.pi)) + np.log1p(-1 / far ** 2 + 3 / far ** 4)
    return np.where(z < 25, near, series)


def lognormal_logpmf(k, mu: float, sigma: float, xmin: float):
    """Log of the log-normal mass of [k - 1/2, k + 1/2], conditioned on k >= xmin."""
    k = np.asarray(k, float)
    low, high = (log_upper((np.log(k + d) - mu) / sigma) for d in (-0.5, 0.5))
    ratio = np.minimum(np.exp(high - low), 1 - 1e-16)
    return low + np.log1p(-ratio) - log_upper(np.array([(math.log(xmin - 0.5) - mu) / sigma]))[0]


def compare_lognormal(hist: DataFrame, alpha: float, xmin: int) -> dict:
    """Log-likelihood ratio of power law over log-normal on the tail, its p and a verdict.

    The log-normal parameters are refined over shrinking grids; every grid is one pass over the histogram, of which a
    sum per grid point comes back. A grid whose best point is at its edge is moved there without shrinking.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    tail = materialize(hist.filter(F.col("degree") >= xmin).select("degree", "n"), "degree-tail")
    log = F.log("degree")
    n, mean, square = tail.agg(F.sum("n").cast("double"), (F.sum(F.col("n") * log) / F.sum("n")),
                               (F.sum(F.col("n") * log * log) / F.sum("n"))).first()
    best, span = (mean, max(math.sqrt(max(square - mean ** 2, 0.0)), 0.1)), (3.0, 1.0)

    def sums(points, power_law=False):
        """Per point: sums over the tail of d and d^2, where d is the log mass or its distance to the power law's."""
        def add(batches):
            for pdf in batches:
                k, c = pdf["degree"].to_numpy(float), pdf["n"].to_numpy(float)
                out = []
                for at, (mu, sigma) in enumerate(points):
                    d = lognormal_logpmf(k, mu, sigma, xmin)
                    d = -alpha * np.log(k) - log_zeta(alpha, xmin) - d if power_law else d
                    out.append((at, float((c * d).sum()), float((c * d * d).sum())))
                yield pd.DataFrame(out, columns=["at", "one", "two"])

        return {r["at"]: (r["one"], r["two"]) for r in tail.mapInPandas(add, "at int, one double, two double")
                .groupBy("at").agg(F.sum("one").alias("one"), F.sum("two").alias("two")).collect()}

    rounds = 0
    while rounds < 12 and span[0] > 1e-5:
        shift = np.linspace(-1, 1, 7)
        points = [(best[0] + span[0] * best[1] * a, best[1] * math.exp(span[1] * b)) for a in shift for b in shift]
        found = sums(points)
        at = max(found, key=lambda x: found[x][0])
        best, rounds = points[at], rounds + 1
        if at // 7 in (1, 2, 3, 4, 5) and at % 7 in (1, 2, 3, 4, 5):
            span = (span[0] * 0.4, span[1] * 0.4)
    ratio, squares = sums([best], power_law=True)[0]
    var = squares / n - (ratio / n) ** 2
    p = math.erfc(abs(ratio) / math.sqrt(2 * n * var)) if var > 0 else 1.0
    verdict = "inconclusive"
    if p < 0.05:
        verdict = "power_law" if ratio > 0 else "log_normal"
    return {"ratio": ratio, "p": p, "verdict": verdict}


def fit_verdict(hist: DataFrame) -> DataFrame:
    """One row ``alpha, xmin, ks, n_tail, ratio, p, verdict``."""
    hist = materialize(hist, "degree-histogram")
    fit = power_law_fit(hist).first()
    schema = "alpha double, xmin bigint, ks double, n_tail bigint, ratio double, p double, verdict string"
    if fit is None:
        return hist.sparkSession.createDataFrame([], schema)
    cmp = compare_lognormal(hist, fit["alpha"], fit["xmin"])
    return hist.sparkSession.createDataFrame(
        [(*fit, cmp["ratio"], cmp["p"], cmp["verdict"])], schema)
