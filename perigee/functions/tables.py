"""Ordered operators as table functions for SQL: ``SELECT * FROM perigee_islands(TABLE(x), 'channel', 90)``.

Each has its own ``analyze``: the first argument is a table, the next the names of its key columns, separated by
commas (none: one series), and the function itself asks Spark to deal rows by the keys and to order them by
``ts_ns``. Rows are read one after the other and nothing but the open run is held. A key is one task's
stream; the DataFrame operators of the same names split a key's time over many.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

TIME = "ts_ns"


def _names(keys: str | None) -> list[str]:
    return [k.strip() for k in (keys or "").split(",") if k.strip()]


def _analyzed(rows: AnalyzeArgument, keys: AnalyzeArgument, needs: tuple[str, ...], fields: list[StructField] | None) -> AnalyzeResult:
    """Partitioning, order and schema: the keys and ``fields``, or all columns of the table."""
    if not rows.isTable:
        raise ValueError("the first argument is a table")
    if not keys.isConstantExpression:
        raise ValueError("key columns are named by a constant")
    names, have = _names(keys.value), {f.name: f for f in rows.dataType}
    if missing := [c for c in (*names, TIME, *needs) if c not in have]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    schema = StructType([have[k] for k in names] + fields) if fields is not None else rows.dataType
    by = [PartitioningColumn(k) for k in names]
    return AnalyzeResult(schema, withSinglePartition=not by, partitionBy=by, orderBy=[OrderingColumn(TIME)])


class Islands:
    """Runs of positive samples, as ``ranges.islands`` finds them: keys, ``start_ns, end_ns``; needs ``positive``."""

    def __init__(self):
        self.key, self.start, self.last, self.gap = (), None, None, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, max_gap_ns: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(rows, keys, ("positive",), [StructField("start_ns", LongType()), StructField("end_ns", LongType())])

    def _closed(self, after: int | None) -> tuple:
        end = self.last if after is None else min(after - 1, self.last + self.gap)
        return (*self.key, self.start, max(self.start, end))

    def eval(self, rows: Row, keys: str, max_gap_ns: int) -> Iterator[tuple]:
        at, positive = rows[TIME], bool(rows["positive"])
        if self.start is None:
            self.key, self.gap = tuple(rows[k] for k in _names(keys)), max_gap_ns
        elif not positive or at - self.last > max_gap_ns:
            yield self._closed(at)
            self.start = None
        if positive:
            self.start, self.last = at if self.start is None else self.start, at

    def terminate(self) -> Iterator[tuple]:
        if self.start is not None:
            yield self._closed(None)


class Sessions:
    """Samples no further apart than a gap: keys, ``start_ns, end_ns, samples, first`` (whether nothing came before)."""

    def __init__(self):
        self.key, self.start, self.last, self.n, self.first = (), None, None, 0, True

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, gap_ns: AnalyzeArgument) -> AnalyzeResult:
        fields = [StructField(c, LongType()) for c in ("start_ns", "end_ns", "samples")]
        return _analyzed(rows, keys, (), [*fields, StructField("first", BooleanType())])

    def eval(self, rows: Row, keys: str, gap_ns: int) -> Iterator[tuple]:
        at = rows[TIME]
        if self.start is not None and at - self.last > gap_ns:
            yield (*self.key, self.start, self.last, self.n, self.first)
            self.start, self.n, self.first = None, 0, False
        if self.start is None:
            self.key, self.start = tuple(rows[k] for k in _names(keys)), at
        self.last, self.n = at, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.start is not None:
            yield (*self.key, self.start, self.last, self.n, self.first)


class Strides:
    """Every ``series_rows div most``-th row of a series that has more than ``most``; needs ``series_rows``, the rows of its key."""

    def __init__(self):
        self.i = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(rows, keys, ("series_rows",), None)

    def eval(self, rows: Row, keys: str, most: int) -> Iterator[tuple]:
        n = rows["series_rows"]
        if self.i % (n // most if n > most else 1) == 0:
            yield tuple(rows)
        self.i += 1


FUNCTIONS = {"perigee_islands": Islands, "perigee_sessions": Sessions, "perigee_strides": Strides}


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL of a session; returns their names."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
    return list(FUNCTIONS)
