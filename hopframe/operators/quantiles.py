"""Exact values at given ranks without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 20.0 / ACCURACY


def value_at_rank(df: DataFrame, col: str, rank: int, n: int):
    """The ``rank``-th largest value (1-based) of the ``n`` non-null values; None past the end.

    A mergeable quantile sketch brackets the rank by two values of the column, and one aggregate counts exactly how many
    values lie above, on, between and below them. If the rank falls on one of the two, that is the answer; otherwise
    the search goes on in the open part that holds the rank. Every round leaves both bounds behind, so it ends; the
    sketch only steers. No sort and no window is involved.
    """
    if not 1 <= rank <= n:
        return None
    v, part = F.col(col), df.filter(F.col(col).isNotNull())
    while True:
        p = 1.0 - rank / n
        lo, hi = part.agg(F.percentile_approx(col, [max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)], ACCURACY)
                          .alias("q")).first()["q"]
        low, high = F.lit(lo), F.lit(hi)
        above, on_high, between, on_low = part.agg(
            F.count(F.when(v > high, 1)), F.count(F.when(v == high, 1)),
            F.count(F.when((v < high) & (v > low), 1)), F.count(F.when((v == low) & (v < high), 1))).first()
        down_to_low = above + on_high + between
        if rank <= above:
            part, n = part.filter(v > high), above
        elif rank <= above + on_high:
            return hi
        elif rank <= down_to_low:
            part, n, rank = part.filter((v < high) & (v > low)), between, rank - above - on_high
        elif rank <= down_to_low + on_low:
            return lo
        else:
            rank -= down_to_low + on_low
            part, n = part.filter(v < low), n - down_to_low - on_low


def values_at_ranks(df: DataFrame, col: str, ranks: list[int], n: int) -> list:
    """``value_at_rank`` for each rank; reads ``df`` several times, so pass a stored table."""
    return [value_at_rank(df, col, r, n) for r in ranks]
