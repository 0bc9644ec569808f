"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut in halves, each half has a codebook of its own, and the product of the two is a grid of
cells. A vector lives in one cell and visits the nearest others in the order of the multi-sequence algorithm,
as many as the target recall takes; what it meets there is verified in double precision. Cells are compared
in blocks of bounded size, of a pair of cells only from the lower number to the higher, so that every pair is
met once, and a block gives back sums and the edges of a spanning forest instead of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import components, join_spread, saved, table
from perigee.llm.langid import uniform

COSINE = 0.93
#: Of neighbours just at the threshold, the share whose cell the traversal reaches.
RECALL = 0.995
#: Bound of the sample that the codebooks of one vector length are fitted on, and least vectors of it a code.
#: Cells hold OCCUPANCY vectors of a label on average, until the sample has no more codes to give: 2,500 a half,
#: enough for 400 million vectors a label; from there on cells grow, and are still compared whole.
SAMPLE, PER_CODE = 20_000, 8
#: Vectors of one label that a cell should hold, and vectors a block takes from either side.
OCCUPANCY, BLOCK = 64, 512


class Grid:
    """Two codebooks and the number of cells a vector visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.books, self.visits = (first, second), visits
        k = np.arange(len(first)), np.arange(len(second))
        # the first n cells in multi-sequence order lie where (i + 1) * (j + 1) <= n
        stairs = np.outer(k[0] + 1, k[1] + 1) <= visits
        self.i, self.j = np.nonzero(stairs)

    def _far(self, x: np.ndarray) -> list[np.ndarray]:
        half = x.shape[1] // 2
        return [((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1)) for y, c in zip((x[:, :half], x[:, half:]), self.books)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(axis=1) for d in self._far(x))
        return a * len(self.books[1]) + b

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The cells each vector visits, nearest first."""
        order, near = zip(*[(o := d.argsort(axis=1, kind="stable"), np.take_along_axis(d, o, axis=1)) for d in self._far(x)])
        total = near[0][:, self.i] + near[1][:, self.j]
        best = total.argsort(axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(order[0], self.i[best], axis=1) * len(self.books[1]) + np.take_along_axis(order[1], self.j[best], axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        size = (c**2).sum(1)
        at = np.concatenate([(size - 2 * part @ c.T).argmin(axis=1) for part in np.array_split(x, -(-len(x) // 2048))])
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit_grid(x: np.ndarray, book: int, cosine: float = COSINE, recall: float = RECALL) -> Grid:
    """Codebooks by k-means on unit vectors; visits so that neighbours at the threshold are met at ``recall``."""
    rng = np.random.default_rng(5)
    half = x.shape[1] // 2
    grid = Grid(_means(x[:, :half], book, rng), _means(x[:, half:], book, rng), 1)
    s = x[rng.choice(len(x), min(len(x), 4000), replace=False)]
    u = rng.normal(size=s.shape)
    u -= (u * s).sum(1, keepdims=True) * s
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    y = cosine * s + math.sqrt(1 - cosine**2) * u
    home, width, ranks = grid.home(y), len(grid.books[1]), []
    for i, (a, b) in enumerate(zip(*grid._far(s))):
        # cells nearer to s than the one its neighbour lives in, counted without listing them
        far = a[home[i] // width] + b[home[i] % width]
        ranks.append(np.searchsorted(np.sort(b), far - a - 1e-12).sum() + 1)
    return Grid(*grid.books, int(np.quantile(ranks, recall, method="higher")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(cosine: float):
    def run(block: pa.Table) -> pa.Table:
        """Pairs of one block as weighted degrees and spanning edges: ``a, b, n`` with b null for degrees."""
        visitor = block.column("visits").to_numpy()
        node, weight = block.column("node").to_numpy(), block.column("copies").to_numpy()
        x, home = _matrix(block.column("v")), block.column("home").to_numpy()
        x = _unit(x)
        h, v = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        near = x[v] @ x[h].T >= cosine
        own = home[v] == block.column("cell")[0].as_py()
        near &= ~own[:, None] | (node[v][:, None] < node[h][None])  # a pair inside the cell counts once
        vs, hs = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near = near[np.ix_(vs, hs)]
        a, b = node[v[vs]], node[h[hs]]
        n_a, n_b = near @ weight[h[hs]], weight[v[vs]] @ near
        # smallest node of each part of the block, passed back and forth until nothing changes
        low_a, low_b = a.copy(), b.copy()
        big = np.iinfo(np.int64).max
        while len(a):
            new_b = np.minimum(low_b, np.where(near, low_a[:, None], big).min(axis=0))
            new_a = np.minimum(low_a, np.where(near, new_b[None], big).min(axis=1))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        nodes, low = np.concatenate([a, b]), np.concatenate([low_a, low_b])
        n = np.concatenate([n_a, n_b]).astype(np.int64)
        return pa.table({"a": pa.array(nodes, pa.int64()), "b": pa.array(low, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vec_id, embedding, label``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    ``cosine``. Null vectors, zero vectors and those with null or non-finite components link with nothing, and
    vectors of unlike lengths don't link with each other; every length has a grid of its own, lengths with few
    vectors a label a single cell. Vectors of one component link by sign. Equal vectors of a label are one node
    with a number of copies, so copies are counted, never paired. A repeated ``vec_id`` is another vector;
    ``component_id`` is the smallest id reachable, null where a component has null ids only (all are kept). The codebooks
    grow with the number of vectors a label has, so that cells stay small; a cell with many is compared block
    by block, all of it. Components of any finite size are scaled first. Other columns are ignored, empty
    tables give empty results.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    # of one component only the sign matters
    e = F.when(F.size(e) == 1, F.transform(e, lambda x: F.signum(x))).otherwise(e)
    rows = vectors.select("vec_id", "label", e.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("k1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("fine"), F.xxhash64(F.lit(1), "v", "label")))
    good = rows.where("fine")
    nodes = good.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vec-nodes")
    labels = nodes.groupBy("d", "label").agg(F.count("*").cast("double").alias("n"))
    fitted = {}
    # lengths that stay within a cell a label need no grid
    for d, total, squares in labels.groupBy("d").agg(F.sum("n").alias("total"), F.sum(F.col("n") ** 2).alias("squares")).where(F.col("squares") > F.col("total") * OCCUPANCY).collect():
        book = min(SAMPLE // PER_CODE, 2 ** max(1, round(math.log2(squares / total / OCCUPANCY) / 2)))
        of_length = nodes.where(F.col("d") == d)
        sample = of_length.where(uniform(F.col("node")) < SAMPLE / total).select("v").toPandas()["v"]
        if len(sample) < 2:
            sample = of_length.select("v").limit(100).toPandas()["v"]
        fitted[d] = fit_grid(_unit(np.stack(sample.to_numpy()).astype(np.float64)), book, cosine, recall)
    grids = spark.sparkContext.broadcast(fitted)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("d")).to_numpy()
            every = (np.flatnonzero(lengths == d) for d in np.unique(lengths))
            for some in (i[at : at + 1024] for i in every for at in range(0, len(i), 1024)):
                part = batch.take(pa.array(some))
                grid = grids.value.get(int(lengths[some[0]]))
                x = _unit(_matrix(part.column(part.schema.get_field_index("v"))))
                home = grid.home(x).astype(np.int64) if grid else np.zeros(len(x), np.int64)
                cell = np.concatenate([home[:, None], grid.nearest(x)], axis=1) if grid else home[:, None]
                # cells with lower numbers come to this one themselves
                keep = cell > home[:, None]
                keep[:, 0] = True
                ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[keep].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), cells], [*part.schema.names, "home", "cells"])

    kind = nodes.schema["label"].dataType.simpleString()
    there = nodes.select("label", "d", "node", "copies", "v").mapInArrow(visits, f"label {kind}, d int, node long, copies long, v array<double>, home long, cells array<long>")
    there = saved(there, "vec-visits")
    # a vector is at home once and a visitor of each of its cells, its own included
    stands = F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("visits"))), F.transform("cells", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("visits"))))).alias("s")
    counts = there.select("label", "d", stands).groupBy("label", "d", "s.cell").agg(F.count_if(~F.col("s.visits")).alias("homes"), F.count_if("s.visits").alias("visitors"))
    counts = counts.where("homes > 0 and visitors > 0")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    counts = saved(counts.select("label", "d", "cell", parts("homes").alias("h"), parts("visitors").alias("w")), "vec-cells")
    other = F.when(F.col("visits"), F.col("h")).otherwise(F.col("w"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("visits"), F.col("w")).otherwise(F.col("h"))).cast("int")
    there = there.select("label", "d", "node", "copies", "v", "home", stands).select("label", "d", "node", "copies", "v", "home", "s.cell", "s.visits")
    blocks = there.join(counts, ["label", "d", "cell"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    blocks = blocks.withColumn("hb", F.when(F.col("visits"), F.col("other")).otherwise(F.col("mine"))).withColumn("vb", F.when(F.col("visits"), F.col("mine")).otherwise(F.col("other")))
    blocks = blocks.select("label", "d", "cell", "hb", "vb", "node", "copies", "v", "home", "visits")
    found = saved(blocks.groupBy("label", "d", "cell", "hb", "vb").applyInArrow(_compare(cosine), "a long, b long, n long"), "vec-links")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts_of = components(found.select("a", "b"))
    of = nodes.join(degree, "node", "left").join(parts_of, "node", "left").withColumn("part", F.coalesce("component", "node"))
    low = of.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    of = saved(of.join(low, "part").select("k1", "k2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vec-components")
    total = of.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = join_spread(rows.where("fine").select("vec_id", "k1", "k2"), of, ["k1", "k2"], "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return out.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
