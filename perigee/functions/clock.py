"""Times as nanoseconds UTC in a LONG, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def ns(ts: Column | str) -> Column:
    """Nanoseconds of a timestamp; a timestamp without zone is read as UTC (the session's zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) * 1000


def parse_ns(text: Column | str) -> Column:
    """Nanoseconds of ISO text with up to nine decimals; a missing zone is UTC, what can't be read is null."""
    text = F.col(text) if isinstance(text, str) else text
    parts = r"^([^.]*?)(?:\.(\d{1,9})\d*)?(Z|[+-]\d{2}:?\d{2})?$"
    whole = F.concat(F.regexp_extract(text, parts, 1), F.when(F.regexp_extract(text, parts, 3) == "", "Z").otherwise(F.regexp_extract(text, parts, 3)))
    decimals = F.rpad(F.regexp_extract(text, parts, 2), 9, "0").cast("long")
    return F.unix_micros(F.try_to_timestamp(whole)) * 1000 + F.coalesce(decimals, F.lit(0))


def lenient(text: Column | str) -> Column:
    """A timestamp from epoch seconds or ISO text; null where neither can be read."""
    text = F.col(text) if isinstance(text, str) else text
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_micros((number * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(text))


def timestamp(ts_ns: Column | str) -> Column:
    """The timestamp of nanoseconds, cut to microseconds in whole numbers; doubles can't hold them."""
    ts_ns = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    return F.timestamp_micros(F.call_function("div", ts_ns, F.lit(1000)))


def iso(ts_ns: Column | str) -> Column:
    """ISO-8601 with ``Z`` to the microsecond."""
    return F.date_format(timestamp(ts_ns), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def split_of(ts_ns: Column | str, validation: int, test: int, first: int | None = None, last: int | None = None) -> Column:
    """``train``, ``validation`` or ``test``; either boundary belongs to the part before it.

    Boundaries have to be in order. With the extent ``first`` to ``last`` given, a time outside it is an error.
    """
    low, high = validation if first is None else first, test if last is None else last
    if not low <= validation < test <= high:
        raise ValueError("split boundaries must be ordered inside the extent")
    ts_ns = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    out = F.when(ts_ns <= validation, "train").when(ts_ns <= test, "validation").otherwise("test")
    outside = F.lit(False) if first is None else ts_ns < first
    outside = outside if last is None else outside | (ts_ns > last)
    return out if first is None and last is None else F.when(outside, F.raise_error(F.lit("a time lies outside the extent"))).otherwise(out)


def recent(ts: Column, now: Column, hours: float) -> Column:
    """At most ``hours`` old; what lies ahead or is unknown isn't recent."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    return F.coalesce((age >= 0) & (age <= hours * 3_600_000_000), F.lit(False))


def is_finite(x: Column | str) -> Column:
    """Neither null, NaN nor infinite. Spark orders NaN above all numbers, so scores must pass this first."""
    x = F.col(x) if isinstance(x, str) else x
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
