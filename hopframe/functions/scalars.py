"""Small column functions shared by loaders, queries and generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def date_to_epoch_ms(day: Column) -> Column:
    """``yyyy-MM-dd`` text to epoch milliseconds at UTC midnight; NULL if not a date."""
    return F.unix_date(F.try_to_date(day, "yyyy-MM-dd")).cast("bigint") * F.lit(86_400_000)


def date_to_epoch_s(day: Column) -> Column:
    return F.unix_date(F.try_to_date(day, "yyyy-MM-dd")).cast("bigint") * F.lit(86_400)


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds to a UTC wall-clock timestamp, whatever the session zone."""
    return F.timestamp_add("MILLISECOND", ms.cast("bigint"), F.expr(EPOCH))


def ts_to_epoch_ms(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, read as UTC whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def padded_id(prefix: str, n: Column, width: int = 19) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def unwrap_single(values: Column) -> Column:
    """The only element of a one-element list, else NULL."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def is_iso_date(text: Column) -> Column:
    trimmed = F.rtrim(text)
    return F.coalesce(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$")
                      & F.try_to_date(trimmed, "yyyy-MM-dd").isNotNull(), F.lit(False))


def or_unknown(value: Column, default: str = "Unknown") -> Column:
    return F.coalesce(value, F.lit(default))


def round2(value: Column) -> Column:
    return F.round(value, 2)


def cents(amount: Column) -> Column:
    return F.round(amount * F.lit(100)).cast("bigint")


def mean_of_cents(total: Column, n: Column) -> Column:
    """Mean amount from integer cents; NULL when there is nothing to average."""
    return F.when(n > 0, total.cast("double") / n.cast("double") / F.lit(100).cast("double"))
