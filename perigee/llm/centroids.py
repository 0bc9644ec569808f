"""Centroid clustering in whole numbers, with Drake's adaptive distance bounds.

Every vector carries an upper bound of the distance to its own centroid, lower bounds of the distances to its
few nearest other ones, and one lower bound for all the rest. When centroids move, bounds move by as much;
where they still show that no other centroid can be nearer, nothing is computed. Where they don't, only those
centroids are that the bounds leave open, and all of them where the last bound doesn't hold. Distances are
whole numbers, bounds are rounded outwards, so the result is Lloyd's, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import discard, matrix, saved, table

K, DIMS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
#: Components in whole numbers are below this, so that a squared distance always fits a long.
LARGEST = 1 << 27
#: Bounds are moved outwards by this share, far more than what rounding may add up to.
SLACK = 1e-12
#: Vectors compared at once.
ROWS = 4096

_STATE = "vec_id {id}, q array<int>, a int, u double, ids array<int>, lo array<double>, rest double, used int, computed int, distance long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from those of ``c``, both of whole numbers."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * big * big * x.shape[1] < 1 << 53:  # every sum is a whole number that doubles hold
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f**2).sum(1)[:, None] - 2 * (f @ g.T) + (g**2).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _outward(d: np.ndarray, sign: int) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + sign * SLACK)


class Bounds:
    """State of a block of vectors: own centroid ``a``, bounds ``u``, ``lo`` (of ``ids``) and ``rest``."""

    def __init__(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, ids: np.ndarray, lo: np.ndarray, rest: np.ndarray):
        self.x, self.a, self.u, self.ids, self.lo, self.rest = x, a, u, ids, lo, rest
        self.used, self.computed = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        n = len(x)
        out = cls(x, np.zeros(n, np.int32), np.zeros(n), np.zeros((n, b), np.int32), np.zeros((n, b)), np.zeros(n))
        out._scan(np.arange(n), c)
        out.used[:] = 0
        return out

    def _scan(self, at: np.ndarray, c: np.ndarray) -> None:
        """Compare the rows ``at`` with every centroid; equal distances go by number."""
        b = self.ids.shape[1]
        for some in np.array_split(at, -(-len(at) // ROWS)) if len(at) else []:
            d = squared(self.x[some], c)
            order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
            near = np.take_along_axis(d, order, axis=1)
            self.a[some], self.u[some] = order[:, 0], _outward(near[:, 0], 1)
            self.ids[some], self.lo[some] = order[:, 1: b + 1], _outward(near[:, 1: b + 1], -1)
            self.rest[some] = _outward(near[:, b + 1], -1) if near.shape[1] > b + 1 else np.inf
        self.computed[at] += len(c)
        self.used[at] = b

    def move(self, c: np.ndarray, moved: np.ndarray) -> None:
        """Assign anew after the centroids came to ``c``; ``moved`` are upper bounds of how far each went."""
        b = self.ids.shape[1]
        self.u = self.u + moved[self.a]
        self.lo = self.lo - moved[self.ids]
        self.rest = self.rest - moved.max(initial=0.0)
        # what all centroids from a place of the list on are at least away
        floor = np.minimum.accumulate(np.concatenate([self.lo, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.u >= floor[:, 0])
        own = self._exact(open_, self.a[open_], c)
        self.u[open_] = _outward(own, 1)
        places = (self.u[open_, None] >= floor[open_]).sum(axis=1)  # floors rise along the list
        self._scan(open_[places > b], c)
        for z in range(1, b + 1):
            at, mine = open_[places == z], own[places == z]
            if not len(at):
                continue
            ids = np.concatenate([self.a[at, None], self.ids[at, :z]], axis=1)
            d = np.concatenate([mine[:, None]] + [self._exact(at, ids[:, j], c)[:, None] for j in range(1, z + 1)], axis=1)
            order = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
            self.a[at], self.u[at] = ids[:, 0], _outward(d[:, 0], 1)
            self.ids[at, :z], self.lo[at, :z] = ids[:, 1:], _outward(d[:, 1:], -1)
            self.used[at] = z

    def _exact(self, at: np.ndarray, ids: np.ndarray, c: np.ndarray) -> np.ndarray:
        self.computed[at] += 1
        return ((self.x[at] - c[ids]) ** 2).sum(axis=1)

    def kept(self, b: int) -> None:
        """Shorten the lists to ``b``; what falls off is bounded by ``rest``."""
        if b < self.ids.shape[1]:
            self.rest = np.minimum(self.rest, self.lo[:, b:].min(axis=1))
            self.ids, self.lo = self.ids[:, :b], self.lo[:, :b]

    def batch(self, vec_id: pa.Array, names: list[str], exact: np.ndarray | None) -> pa.RecordBatch:
        def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel(), kind))

        distance = pa.nulls(len(self.x), pa.int64()) if exact is None else pa.array(exact, pa.int64())
        columns = [vec_id, lists(self.x, pa.int32()), pa.array(self.a, pa.int32()), pa.array(self.u), lists(self.ids, pa.int32()), lists(self.lo, pa.float64()), pa.array(self.rest), pa.array(self.used, pa.int32()), pa.array(self.computed, pa.int32()), distance]
        return pa.RecordBatch.from_arrays(columns, names)


def _partial_sums(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            a, x = batch.column(0).to_numpy(), matrix(batch.column(1)).astype(np.int64)
            n += np.bincount(a, minlength=k)
            np.add.at(sums, a, x)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], ["a", "n", "sums"])

    return run


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum by count of every cluster; a cluster without vectors stays where it is."""
    k, dims = centres.shape
    parts = state.select("a", "q").mapInArrow(_partial_sums(k, dims), "a int, n long, sums array<long>")
    sums = parts.select("a", "n", F.posexplode("sums").alias("at", "s")).groupBy("a", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centres.copy()
    for r in sums.collect():
        out[r["a"], r["at"]] = int(r["s"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed`` per kept row of ``vec_id, embedding``.

    Kept are vectors of exactly ``dims`` components, none of them null, not finite or, in whole numbers
    (``floor(scale * x)``), as large as 2**27, beyond which a squared distance might not fit a long; all others
    have no row. Centroids start as the ``k`` kept vectors with the smallest SHA-256 of ``seed:vec_id`` (fewer where there are
    fewer); a null id counts as an empty string, and rows of one id go by their vectors. Repeated rows are
    rows of their own: they weigh as often as they stand. ``computed`` says how many distances the last
    assignment computed for the row, of ``k``. Inertias beyond a long are null. Other columns are ignored; an
    empty table gives an empty result.

    Driver and broadcasts hold ``k`` centroids. A round reads and writes the vectors once, without a shuffle but
    that of the sums of each task; lost tasks start from the table of the round before.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    kept = vectors.select("vec_id", e.alias("embedding")).where(F.coalesce(fine, F.lit(False)))
    kept = kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("q"))
    kind = kept.schema["vec_id"].dataType.simpleString()
    start = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    if not start:
        none = F.lit(None)
        return kept.limit(0).select("vec_id", none.cast("int").alias("cluster"), none.cast("long").alias("distance"), none.cast("long").alias("cluster_inertia"), none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"), none.cast("int").alias("computed"))
    centres = np.array([r["q"] for r in start], np.int64)
    schema = _STATE.format(id=kind)
    names = [f.split()[0] for f in schema.split(", ")]
    b = min(max(k // 4, 1), len(centres) - 1)

    def first(c: np.ndarray, b: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1)).astype(np.int64)
                yield Bounds.scanned(x, c, b).batch(batch.column(0), names, None)

        return run

    def again(c: np.ndarray, moved: np.ndarray, b: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, n = matrix(batch.column(1)).astype(np.int64), len(batch)
                ids, lo = (matrix(batch.column(i)).reshape(n, -1) for i in (4, 5))
                held = Bounds(x, batch.column(2).to_numpy().copy(), batch.column(3).to_numpy(), ids.astype(np.int32), lo, batch.column(6).to_numpy())
                held.kept(b)
                held.move(c, moved)
                yield held.batch(batch.column(0), names, ((x - c[held.a]) ** 2).sum(axis=1) if last else None)

        return run

    state = saved(kept.mapInArrow(first(centres, b), schema), "drake")
    for at in range(rounds):
        new = _means(state, centres)
        moved = _outward(((new - centres) ** 2).sum(axis=1), 1)
        if at:  # as many bounds as the round before had use for
            b = min(b, max(k // 8, 1, state.agg(F.max("used")).first()[0] or 0))
        old, centres = state, new
        state = saved(old.mapInArrow(again(centres, moved, b, at == rounds - 1), schema), "drake")
        discard(old)
    if not rounds:
        exact = F.aggregate(F.zip_with("q", F.element_at(F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in centres]), F.col("a") + 1), lambda x, c: (x - c).cast("long") * (x - c)), F.lit(0).cast("long"), lambda s, x: s + x)
        state = state.withColumn("distance", exact)
    sums = {r["a"]: int(r["s"]) for r in state.groupBy("a").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    facts = [(i, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(str(int(v)) for v in centres[i]).encode()).hexdigest()) for i, s in sorted(sums.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("vec_id", F.col("a").alias("cluster"), "distance", "computed").join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))
