"""Whitening by TSQR.

Rows are centred with exact sums, every task reduces its rows to a triangular factor, factors meet in a tree,
and the singular value decomposition of the last one gives the axes and variances. No covariance of the vectors is
formed, so small variances keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import matrix, saved, table

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Entries are below this in whole numbers, which is what a double holds exactly.
LARGEST = 1 << 52
#: Factors that meet in one step of the tree, and numbers of a block that is factored at once.
FAN, BLOCK = 16, 1 << 21
#: Sums are carried in two parts of this many bits, none of which can overflow.
SPLIT = 26


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``(length, ids, x)`` blocks of vectors of one length, as whole numbers."""
    for batch in batches:
        d = batch.column(2).to_numpy()
        for length in np.unique(d):
            at, step = np.flatnonzero(d == length), max(1, BLOCK // int(length))
            for i in range(0, len(at), step):
                part = batch.take(pa.array(at[i: i + step]))
                yield int(length), part.column(0), np.floor(matrix(part.column(1)) * SCALE).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {}
    for d, _, x in _blocks(batches):
        n, hi, lo = held.get(d, (0, 0, 0))
        held[d] = n + len(x), hi + (x >> SPLIT).sum(axis=0), lo + (x & (1 << SPLIT) - 1).sum(axis=0)
    rows = [(d, n, hi, lo) for d, (n, hi, lo) in held.items()]
    kinds = pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["d", "n", "hi", "lo"])


def _r_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].ravel() for r in rows], pa.list_(pa.float64()))], ["d", "part", "r"])


def _stacked(r: np.ndarray | None, y: np.ndarray) -> np.ndarray:
    return np.linalg.qr(y if r is None else np.concatenate([r, y]), mode="r")


class Mean:
    """Count and exact sums of the vectors of one length; centres them without losing digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)  # sums = n * whole + left

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of ``(n * x - sums) ** 2``, exactly."""
        z, n = x - self.whole, self.n
        z_max, left_max = int(np.abs(z).max(initial=0)), int(self.left.max(initial=0))
        if z_max * max(z_max, left_max, 1) * x.shape[1] < 1 << 62:
            square, cross, rest = (z * z).sum(axis=1), (z * self.left).sum(axis=1), sum(int(v) ** 2 for v in self.left)
            return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(square, cross)]
        return [sum((n * int(v) - int(left)) ** 2 for v, left in zip(row, self.left)) for row in z]


class Axes:
    """Unit axes by falling variance, the variances and their trace; ``scaled`` is zero where one has none."""

    def __init__(self, axes: np.ndarray, variance: np.ndarray, trace: float):
        self.axes, self.variance, self.trace = axes, variance, trace
        # of rows of whole numbers, variances of rounding alone
        self.real = np.sqrt(variance) > np.sqrt(variance[:1]) * np.finfo(float).eps * 8 * max(8, axes.shape[1])
        self.scaled = axes.T / np.sqrt(np.where(self.real, variance, np.inf))
        self.error: float | None = None

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return y @ self.scaled


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` of ``vec_id, embedding``.

    One row for each vector and component, numbered from 1 by falling variance. Vectors that are null or empty or hold null
    or non-finite entries, or ones that scaled to whole numbers reach 2**52, have no row. Vectors of different
    lengths have no common axes: each length is whitened by itself, and ``n`` counts its vectors. Repeated rows
    and ids are rows of their own. ``deviation`` is null where it is beyond a long; ``deviation_exact`` is a
    decimal of 38 digits. A component along which nothing varies can't be scaled: its ``whitened`` is null and
    the identity isn't compared along it; ``explained`` is null where nothing varies at all. Other columns are ignored.

    The table is read four times and never shuffled: only one sum and one factor a task are, and these meet
    in a tree of ``FAN``. The driver gets the sums and ``components`` axes of each length.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE))
    rows = vectors.select("vec_id", e.alias("v")).where(F.coalesce(fine, F.lit(False))).select("vec_id", "v", F.size("v").alias("d"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    parts = rows.mapInArrow(_sums, "d int, n long, hi array<long>, lo array<long>").select("d", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "s"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = parts.groupBy("d", "at").agg(F.sum("n").alias("n"), wide("s.hi").alias("hi"), wide("s.lo").alias("lo")).collect()
    counts = {r["d"]: r["n"] for r in got}
    sums = {d: [0] * d for d in counts}
    for r in got:
        sums[r["d"]][r["at"]] = (int(r["hi"]) << SPLIT) + int(r["lo"])
    means = spark.sparkContext.broadcast({d: Mean(n, sums[d]) for d, n in counts.items()})

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, _, x in _blocks(batches):
            held[d] = _stacked(held.get(d), means.value[d].centred(x))
        yield _r_rows([(d, TaskContext.get().partitionId(), r) for d, r in held.items()])

    def merged(group: pa.Table) -> pa.Table:
        r, d = None, group.column("d")[0].as_py()
        for _, flat in sorted(zip(group.column("part").to_pylist(), group.column("r").to_pylist())):
            r = _stacked(r, np.array(flat).reshape(-1, d))
        return pa.Table.from_batches([_r_rows([(d, group.column("part")[0].as_py() // FAN, r)])])

    def last(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        _, s, vt = np.linalg.svd(np.array(group.column("r")[0].as_py()).reshape(-1, d))
        s = np.concatenate([s, np.zeros(d - len(s))])
        axes = vt[:components]
        axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1) < 0, -1, 1)
        return pa.table({"d": pa.array([d], pa.int32()), "axes": pa.array([axes.ravel()], pa.list_(pa.float64())), "s2": pa.array([s[:components] ** 2], pa.list_(pa.float64())), "total": pa.array([float((s**2).sum())])})

    level = saved(rows.mapInArrow(factors, "d int, part int, r array<double>"), "tsqr")
    most = level.agg(F.max("part")).first()[0] or 0
    while most:
        level = level.groupBy("d", F.floor(F.col("part") / FAN)).applyInArrow(merged, "d int, part int, r array<double>")
        most //= FAN
    found = level.groupBy("d").applyInArrow(last, "d int, axes array<double>, s2 array<double>, total double").collect()
    axes = {r["d"]: Axes(np.array(r["axes"]).reshape(-1, r["d"]), np.array(r["s2"]) / counts[r["d"]], r["total"] / counts[r["d"]]) for r in found}
    plain = spark.sparkContext.broadcast(axes)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, _, x in _blocks(batches):
            w = plain.value[d].whitened(means.value[d].centred(x))
            held[d] = held.get(d, 0) + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["d", "m"])

    # means of what is centred are rounding alone, so taking their products off loses nothing
    got = rows.mapInArrow(moments, "d int, m array<double>").select("d", F.posexplode("m").alias("at", "m")).groupBy("d", "at").agg(F.sum("m").alias("m"))
    by_length: dict[int, dict[int, float]] = {}
    for r in got.collect():
        by_length.setdefault(r["d"], {})[r["at"]] = r["m"]
    for d, m in by_length.items():
        a = axes[d]
        k = len(a.variance)
        flat = np.array([m[i] for i in range(k + k * k)]) / counts[d]
        cov = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)
        a.error = float(np.abs(cov[np.ix_(a.real, a.real)]).max()) if a.real.any() else None
    whole = spark.sparkContext.broadcast(axes)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, ids, x in _blocks(batches):
            a, mean = whole.value[d], means.value[d]
            k, n = len(a.variance), len(x)
            w = np.where(a.real, a.whitened(mean.centred(x)), np.nan).ravel()
            dev = mean.deviations(x)
            each = pa.array(np.repeat(np.arange(n), k))
            share = np.tile(a.variance / a.trace if a.trace > 0 else np.full(k, np.nan), n)
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, mean.n)), pa.array([v if v < 1 << 63 else None for v in dev], pa.int64()).take(each),
                       pa.array(w, from_pandas=True), pa.array(share, from_pandas=True), pa.array([a.error] * (n * k), pa.float64()), pa.array([str(v) for v in dev]).take(each)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    result = rows.mapInArrow(out, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    return result.withColumn("deviation_exact", F.expr("try_cast(deviation_exact as decimal(38,0))"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
