"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table cuts space along a few random normal directions into cells of one width; a cell is a bucket. A query
visits, in each of several tables, its own bucket and those beyond the cell's sides it lies near, in the order
of the squared distances to these sides, which is the order of their estimated success. What it meets is
ranked by exact products; what tables find is merged. Largest products become nearest points by one more
component that fills every vector up to the largest norm of its band of norms; bands are kept apart, so a few long vectors
spoil nothing, and bands too short to matter aren't visited.

Width, directions, tables and visits are chosen on a bounded sample, as the cheapest ones that reach the target
recall there; every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.llm.common import join_spread, matrix, saved, table
from perigee.llm.langid import uniform

NEIGHBOURS, EVERY = 20, 20
#: Share of the true neighbours of the sampled queries that the chosen tables must find.
RECALL = 0.96
#: Bounds of the samples that tables are chosen on: queries, other rows, and numbers of all those rows.
SAMPLE_QUERIES, SAMPLE_ROWS, SAMPLE_NUMBERS = 256, 16_384, 1 << 21
#: Of the sampled rows, those that every query is compared with for a first bound: so many, and a share of all rows at most.
FIRST, SHARE = 2048, 16
#: What is tried: directions, widths in units of what a unit vector's products spread by, tables, and most visits a table.
DIRECTIONS, WIDTHS, TABLES, VISITS = (2, 3, 4, 6, 8, 12, 16), (0.35, 0.7, 1.4, 2.8), (2, 4), 512
#: Bringing a query to a bucket costs as much as comparing it with so many rows.
COPY = 64
#: Vectors of a length with fewer of them, or beyond so many lengths, are compared whole in blocks.
FEW, LENGTHS = 256, 16
#: Rows and queries of a block, and numbers that either side of one may hold.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_NUMBERS = 8192, 2048, 1 << 20
PAIRS = 1 << 16


@cache
def steps(m: int, most: int) -> np.ndarray:
    """Sets of cell sides to step over as rows of 0 and 1, most promising first.

    Sides stand in the order of their distance, nearest first, so place ``p`` and place ``2m - 1 - p`` are the
    two sides of one direction, of which one at most is stepped over. The order is that of the expected sums
    of squared distances; queries reorder it by their own.
    """
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - j[::-1] / (m + 1) + j[::-1] * (j[::-1] + 1) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, far])
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, held = heapq.heappop(heap)
        if len({min(p, 2 * m - 1 - p) for p in held}) == len(held):
            out.append(held)
        if (last := held[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*held, last + 1)))
    rows = np.zeros((len(out), 2 * m), np.uint64)
    for i, held in enumerate(out):
        rows[i, list(held)] = 1
    return rows


class Tables:
    """Hash tables for vectors of ``d`` components: ``m`` directions, cells of ``width``, ``visits`` a query."""

    def __init__(self, d: int, m: int, width: float, tables: int, visits: int):
        self.d, self.m, self.width, self.tables, self.visits = d, m, width, tables, visits

    @cache
    def _of(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng((11, self.d, self.m, t))
        return rng.normal(size=(self.d + 1, self.m)), rng.uniform(size=self.m), rng.integers(1, 1 << 63, self.m, dtype=np.uint64) | np.uint64(1)

    def __getstate__(self):
        return (self.d, self.m, self.width, self.tables, self.visits)

    def __setstate__(self, state):
        self.__init__(*state)

    def places(self, t: int, unit: np.ndarray) -> np.ndarray:
        a, shift, _ = self._of(t)
        return unit @ a / self.width + shift

    def keys(self, t: int, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64).astype(np.uint64) * self._of(t)[2]).sum(axis=1, dtype=np.uint64)

    def homes(self, t: int, unit: np.ndarray) -> np.ndarray:
        return self.keys(t, np.floor(self.places(t, unit)))

    def sides(self, t: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home keys, squared scores of all steps, and what each adds to the key, by query."""
        p = self.places(t, unit)
        low = p - np.floor(p)
        z = np.concatenate([low, 1 - low], axis=1)
        order = z.argsort(axis=1, kind="stable")
        near = np.take_along_axis(z, order, axis=1)
        r = self._of(t)[2]
        add = np.concatenate([np.uint64(0) - r, r])[order]
        sets = steps(self.m, VISITS)
        return self.keys(t, np.floor(p)), near**2 @ sets.T.astype(np.float64), add @ sets.T

    def probes(self, t: int, unit: np.ndarray) -> np.ndarray:
        """Keys of the ``visits`` buckets of each query, in the order of estimated success."""
        home, score, add = self.sides(t, unit)
        best = score.argsort(axis=1, kind="stable")[:, : self.visits]
        return home[:, None] + np.take_along_axis(add, best, axis=1)


def _mixed(key: np.ndarray, t: int, band: int, d: int) -> np.ndarray:
    """One 63-bit number for table, length, band of norms and bucket; two that fall together only add candidates."""
    salt = (t + 1) * 0x9E3779B97F4A7C15 + (band + 5000) * 0xC2B2AE3D27D4EB4F + d * 0x165667B19E3779F9
    x = key ^ np.uint64(salt & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def log_norms(x: np.ndarray) -> np.ndarray:
    """Base-2 logarithms of the norms of rows that aren't zero; components of any finite size."""
    top = np.abs(x).max(axis=1, initial=0)
    return np.log2(top) + np.log2(np.linalg.norm(x / top[:, None], axis=1))


def _filled(x: np.ndarray, lg: np.ndarray, top: np.ndarray | float) -> np.ndarray:
    """Rows scaled so that norms of ``2 ** top`` become one, with the component that is missing to one."""
    largest = np.abs(x).max(axis=1)
    y = x / largest[:, None] * np.exp2(np.log2(largest) - top)[:, None]
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - np.exp2(2 * (lg - top))))[:, None]], axis=1)


def _products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of ``q`` and ``j`` of ``x``, always summed in the same order."""
    parts = [(q[i[at: at + PAIRS]] * x[j[at: at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)]
    out = np.concatenate(parts) if parts else np.zeros(0)
    return np.where(np.isnan(out), -np.inf, out)


def best_of(q: np.ndarray, x: np.ndarray, low: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``x`` and product of the ``k`` largest products of each, ties by ``low``; none below ``bound``."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(q), 512):
            some = q[at: at + 512]
            s = some @ x.T
            s[np.isnan(s)] = -np.inf
            floor = np.full(len(some), -np.inf) if len(x) <= k else np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
            if bound is not None:
                floor = np.maximum(floor, bound[at: at + 512])
            slack = 1e-12 * np.abs(some).max(axis=1) * np.abs(x).max(initial=0) * x.shape[1]
            i, j = np.nonzero(s >= np.where(np.isfinite(floor), floor - slack, floor)[:, None])
            p = _products(some, x, i, j)
            order = np.lexsort((low[j], -p, i))
            i, j, p = i[order], j[order], p[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            good = place < k
            if bound is not None:
                good &= p >= bound[at: at + 512][i]
            out.append((i[good] + at, j[good], p[good]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


def choose(queries: np.ndarray, near: np.ndarray, whose: np.ndarray, rows: np.ndarray, n: float, recall: float = RECALL) -> tuple[Tables | None, float]:
    """The cheapest tables that find ``recall`` of the neighbours ``near`` of the queries, and what they found.

    ``queries``, ``near`` and ``rows`` are filled rows, ``whose`` the query of each neighbour, ``n`` the number of
    all rows that ``rows`` are a sample of. None where nothing that is tried finds so many.
    """
    best, found, cheapest = None, 0.0, np.inf
    d = queries.shape[1] - 1
    for m in DIRECTIONS:
        for width in WIDTHS:
            tables = Tables(d, m, width, max(TABLES), VISITS)
            ranks, seen = [], []
            for t in range(max(TABLES)):
                key, score, add = tables.sides(t, queries)
                step = tables.homes(t, near) - key[whose]
                order = score.argsort(axis=1, kind="stable")
                probes = key[:, None] + np.take_along_axis(add, order, axis=1)
                hit = np.take_along_axis(add, order, axis=1)[whose] == step[:, None]
                ranks.append(np.where(hit.any(axis=1), hit.argmax(axis=1), VISITS))
                held, count = np.unique(tables.homes(t, rows), return_counts=True)
                at = np.minimum(np.searchsorted(held, probes), len(held) - 1)
                seen.append(np.where(held[at] == probes, count[at], 0).mean(axis=0).cumsum() * n / len(rows))
            for some in TABLES:
                rank = np.sort(np.min(ranks[:some], axis=0))
                visits = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1
                if visits > len(steps(m, VISITS)):
                    continue
                cost = some * visits * COPY + sum(s[visits - 1] for s in seen[:some])
                if cost < cheapest:
                    best, found, cheapest = Tables(d, m, width, some, visits), float((rank < visits).mean()), cost
    return best, found


class Fitted:
    """Tables of a length, the rows every query is compared with first, and the largest norm of each of its bands."""

    def __init__(self, tables: Tables | None, bands: dict[int, float], rows: np.ndarray, nodes: np.ndarray, low: np.ndarray):
        self.tables, self.bands, self.rows, self.nodes, self.low = tables, bands, rows, nodes, low


_NO_ID = np.iinfo(np.int64).max


def _low(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _by_length(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        lengths = batch.column("d").to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            for i in range(0, len(at), most):
                part = batch.take(pa.array(at[i: i + most]))
                yield int(d), part, matrix(part.column("v"))


def _normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, part, x in _by_length(batches):
        lg = log_norms(x)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lg), pa.array(np.rint(lg).astype(np.int32))], [*part.schema.names, "lg", "band"])


def _block(k: int):
    def run(group: pa.Table) -> pa.Table:
        visit = group.column("visits").to_numpy()
        v, h = np.flatnonzero(visit), np.flatnonzero(~visit)
        x, node = matrix(group.column("v")), group.column("node").to_numpy()
        low = _low(group.column("low").combine_chunks())
        bound = group.column("bound").fill_null(-np.inf).to_numpy()
        i, j, p = best_of(x[v], x[h], low[h], k, bound[v])
        return pa.table({"q": pa.array(node[v[i]], pa.int64()), "c": pa.array(node[h[j]], pa.int64()), "score": pa.array(p, pa.float64()), "low": group.column("low").combine_chunks().take(pa.array(h[j]))})

    return run


def _fit(nodes: DataFrame, d: int, n: int, asked: int, bands: dict[int, float], k: int, recall: float) -> Fitted:
    """Choose tables for one length: brute force of a few sampled queries against all rows, and a sample of rows."""
    spark = nodes.sparkSession
    few = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // d))
    of = nodes.where(F.col("d") == d)
    picked = of.where(uniform(F.col("node")) < 1.0 * few / n).select("node", "lg", "band", "low", "v").orderBy("node").limit(2 * few).toPandas()
    rows = np.stack(picked["v"].to_numpy()).astype(np.float64) if len(picked) else np.zeros((0, d))
    low = picked["low"].fillna(_NO_ID).astype(np.int64).to_numpy()
    some = np.random.default_rng(d).permutation(len(rows))[: max(2 * k + 2, min(FIRST, n // SHARE))]
    out = Fitted(None, bands, rows[some], picked["node"].to_numpy(np.int64)[some], low[some])
    want = min(SAMPLE_QUERIES, max(16, SAMPLE_NUMBERS // 8 // d))
    sample = of.where("queries > 0").where(uniform(-F.col("node") - 1) < 2.0 * want / max(asked, 1)).select("node", "lg", "v").orderBy(uniform(-F.col("node") - 1)).limit(want).toPandas()
    if n < FEW or not len(sample) or not len(rows):
        return out
    q = np.stack(sample["v"].to_numpy()).astype(np.float64)
    own, shared = sample["node"].to_numpy(np.int64), spark.sparkContext.broadcast(q)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, part, x in _by_length(batches, BLOCK_ROWS):
            i, j, p = best_of(shared.value, x, _low(part.column("low")), k + 1)
            there = pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(p), *[part.column(c).take(pa.array(j)) for c in ("low", "node", "lg", "band", "v")]], ["i", "score", "low", "node", "lg", "band", "v"])
            held = pa.Table.from_batches([there] if held is None else [*held.to_batches(), there]).combine_chunks()
            order = np.lexsort((_low(held.column("low").combine_chunks()), -held.column("score").to_numpy(), held.column("i").to_numpy()))
            i = held.column("i").to_numpy()[order]
            held = held.take(pa.array(order[np.arange(len(i)) - np.searchsorted(i, i) <= k])).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    fields = f"i int, score double, low long, node long, lg double, band int, v {nodes.schema['v'].dataType.simpleString()}"
    place = Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("low"))
    near = of.select("low", "node", "lg", "band", "d", "v").mapInArrow(nearest, fields).withColumn("at", F.row_number().over(place)).where(F.col("at") <= k + 1).drop("at").toPandas()
    near = near[near["node"].to_numpy() != own[near["i"].to_numpy()]]
    near = near[near.groupby("i").cumcount() < k]
    if len(near):
        top = lambda frame: np.array([bands[b] for b in frame["band"]])
        fill = lambda frame: _filled(np.stack(frame["v"].to_numpy()).astype(np.float64), frame["lg"].to_numpy(), top(frame))
        unit = _filled(q, sample["lg"].to_numpy(), sample["lg"].to_numpy())
        out.tables, _ = choose(unit, fill(near), near["i"].to_numpy(), fill(picked), n, recall)
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows with the largest inner products with each row that ``queries`` holds for.

    ``vectors`` has ``vec_id, embedding``; ``queries`` is a condition on them. A query's own row is no candidate of it,
    all others of its length are, those of an equal or null id too. Null, empty and zero vectors and those with null or
    non-finite components take no part; vectors of unlike lengths have no product. Ties go to the smaller id, nulls last. Rows
    of one vector are one node with its ``k + 1`` smallest ids, of which no query can need more, so copies cost
    nothing and none is lost. Products beyond a double are infinite and rank as such. Other columns are
    ignored; an empty table gives an empty result. Every query gets ``k`` rows where there are as many
    candidates: the best of a bounded sample of rows are candidates too, and are the bound below which buckets return nothing.

    A bucket is compared in blocks of bounded size, all of it. Tables are chosen anew for each of the 16 most frequent
    lengths; the others, and lengths of few vectors, are compared whole in blocks.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0)).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    place = Window.partitionBy("k1", "k2").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.withColumn("at", F.row_number().over(place)).where(F.col("at") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("at", "vec_id")))
    nodes = first.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.transform(ids, lambda x: x["vec_id"]).alias("ids"))
    asked = rows.where("asks").groupBy("k1", "k2").agg(F.count("*").alias("queries"))
    nodes = nodes.join(asked, ["k1", "k2"], "left").withColumn("queries", F.coalesce("queries", F.lit(0)))
    nodes = nodes.withColumn("d", F.size("v")).withColumn("low", F.col("ids")[0]).withColumn("node", F.monotonically_increasing_id())
    names = "k1 long, k2 long, v {0}, ids array<long>, queries long, d int, low long, node long".format(nodes.schema["v"].dataType.simpleString())
    # ids of rows are given once, where the table is written
    nodes = saved(nodes.select(*[f.split()[0] for f in names.split(", ")]), "lsh-nodes")
    nodes = saved(nodes.mapInArrow(_normed, names + ", lg double, band int"), "lsh-normed")

    sizes = nodes.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("queries") > 0).alias("asked")).where("asked > 0").orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    fitted: dict[int, Fitted] = {}
    for r in sizes:
        bands = {b["band"]: b["top"] for b in nodes.where(F.col("d") == r["d"]).groupBy("band").agg(F.max("lg").alias("top")).collect()}
        fitted[r["d"]] = _fit(nodes, r["d"], r["n"], r["asked"], bands, k, recall)
    shared = spark.sparkContext.broadcast(fitted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part, x in _by_length(batches):
            fit, band, lg = shared.value.get(d), part.column("band").to_numpy(), part.column("lg").to_numpy()
            if fit is None or fit.tables is None:
                keys = _mixed(np.zeros((len(x), 1), np.uint64), 0, 0, d)
            else:
                unit = _filled(x, lg, np.array([fit.bands[b] for b in band]))
                keys = np.stack([fit.tables.homes(t, unit) for t in range(fit.tables.tables)], axis=1)
                keys = np.stack([np.select([band == b for b in np.unique(band)], [_mixed(keys[:, t], t, int(b), d) for b in np.unique(band)]) for t in range(keys.shape[1])], axis=1)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("d", "node", "low", "v")], pa.nulls(len(x), pa.float64()), _lists(list(keys), pa.int64())], ["d", "node", "low", "v", "bound", "keys"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part, x in _by_length(batches, 256):
            fit, lg = shared.value.get(d), part.column("lg").to_numpy()
            bound, hits = np.full(len(x), -np.inf), [(np.zeros(0, np.int64), np.zeros(0))] * len(x)
            if fit is None or fit.tables is None:
                keys = list(_mixed(np.zeros((len(x), 1), np.uint64), 0, 0, d))
            else:
                i, j, p = best_of(x, fit.rows, fit.low, k + 1)
                ends = np.searchsorted(i, np.arange(len(x) + 1))
                hits = [(j[a:b], p[a:b]) for a, b in zip(ends, ends[1:])]
                bound = np.array([h[1][-1] if len(h[1]) > k else -np.inf for h in hits])
                unit = _filled(x, lg, lg)
                own = [fit.tables.probes(t, unit) for t in range(fit.tables.tables)]
                parts: list[list[np.ndarray]] = [[] for _ in range(len(x))]
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(bound > 0, np.log2(np.maximum(bound, 0)) - 1e-6, -np.inf)
                for b, top in fit.bands.items():
                    for t, probe in enumerate(own):
                        mixed = _mixed(probe, t, b, d)
                        for a in np.flatnonzero(lg + top >= least):
                            parts[a].append(mixed[a])
                keys = [np.unique(np.concatenate(p)) if p else np.zeros(0, np.int64) for p in parts]
            sampled = fit.nodes if fit is not None else np.zeros(0, np.int64)
            lows = pa.array(fit.low, pa.int64(), mask=fit.low == _NO_ID) if fit is not None else pa.nulls(0, pa.int64())
            at = np.concatenate([h[0] for h in hits]).astype(np.int64)
            lists = _lists([sampled[h[0]] for h in hits], pa.int64())
            lows = pa.ListArray.from_arrays(lists.offsets, lows.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("d", "node", "low", "v")], pa.array(bound), _lists(keys, pa.int64()), lists, lows, _lists([h[1] for h in hits], pa.float64())],
                                             ["d", "node", "low", "v", "bound", "keys", "hits", "lows", "scores"])

    vectors_of = f"d int, node long, low long, v {nodes.schema['v'].dataType.simpleString()}, bound double, keys array<long>"
    homes = saved(nodes.mapInArrow(index, vectors_of), "lsh-homes")
    visits = saved(nodes.where("queries > 0").mapInArrow(ask, vectors_of + ", hits array<long>, lows array<long>, scores array<double>"), "lsh-visits")
    stands = homes.select("d", F.explode("keys").alias("key"), F.lit(False).alias("visits")).unionByName(visits.select("d", F.explode("keys").alias("key"), F.lit(True).alias("visits")))
    counts = stands.groupBy("key").agg(F.max("d").alias("d"), F.count_if(~F.col("visits")).alias("homes"), F.count_if("visits").alias("visitors")).where("homes > 0 and visitors > 0")
    parts = lambda c, most: F.ceil(F.col(c) / F.greatest(F.lit(64), F.least(F.lit(most), F.lit(BLOCK_NUMBERS) / F.col("d")))).cast("int")
    counts = saved(counts.select("key", "homes", "visitors", parts("homes", BLOCK_ROWS).alias("h"), parts("visitors", BLOCK_QUERIES).alias("w")), "lsh-buckets")
    total = counts.agg(F.coalesce(F.sum("homes"), F.lit(0)), F.coalesce(F.sum("visitors"), F.lit(0))).first()

    def dealt(side: DataFrame, weight: str, of: int, mine: str, other: str, visit: bool) -> DataFrame:
        """Rows of one side in their part of each bucket, once for every part of the other side."""
        there = side.select("d", "node", "low", "v", "bound", F.explode("keys").alias("key"))
        there = join_spread(there, counts.select("key", weight, "h", "w"), ["key"], weight, of)
        there = there.withColumn(f"{mine}b", F.pmod(F.xxhash64("node"), F.col(mine)).cast("int")).withColumn(f"{other}b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return there.select("d", "key", "hb", "wb", "node", "low", "v", "bound", F.lit(visit).alias("visits"))

    blocks = dealt(homes, "homes", total[0], "h", "w", False).unionByName(dealt(visits, "visitors", total[1], "w", "h", True))
    found = blocks.groupBy("d", "key", "hb", "wb").applyInArrow(_block(k + 1), "q long, c long, score double, low long")
    lucky = visits.select(F.col("node").alias("q"), F.explode(F.arrays_zip("hits", "scores", "lows")).alias("s")).select("q", F.col("s.hits").alias("c"), F.col("s.scores").alias("score"), F.col("s.lows").alias("low"))
    merged = found.unionByName(lucky).groupBy("q", "c").agg(F.max("score").alias("score"), F.min("low").alias("low"))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("low"))
    merged = saved(merged.withColumn("at", F.row_number().over(rank)).where(F.col("at") <= k + 1).select("q", "c", "score"), "lsh-found")
    used = merged.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("uses")).join(nodes.select("node", "ids"), "node").select(F.col("node").alias("c"), "ids", "uses")
    each = join_spread(merged, saved(used, "lsh-used"), ["c"], "uses", merged.count()).select("q", "score", (F.col("q") == F.col("c")).alias("own"), F.explode("ids").alias("id"))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    each = each.withColumn("at", F.row_number().over(rank)).where(F.col("at") <= k + 1)
    lists = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score", "own"))).alias("found")).withColumnRenamed("q", "node")
    facts = saved(lists.join(nodes.select("node", "k1", "k2", "queries"), "node").drop("node"), "lsh-lists")
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "k1", "k2")
    out = join_spread(asking, facts, ["k1", "k2"], "queries", facts.agg(F.coalesce(F.sum("queries"), F.lit(0))).first()[0])
    mine = F.array_position(F.transform("found", lambda x: x["own"] & x["id"].eqNullSafe(F.col("query_id"))), True)
    out = out.withColumn("own", mine).select("query_id", F.posexplode(F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k)).alias("at", "s"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
