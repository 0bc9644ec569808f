"""The operators on vectors: neighbours, whitening and centroids against brute force, and their edges."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from perigee.llm import centroids, lsh, neardup_vectors, whitening  # noqa: E402
from perigee.llm.queries import queries  # noqa: E402

from conftest import DATA  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(n=3000, groups=60, d=32, noise=0.25, seed=4):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, d))
    x = at[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, ids=None, kind=VECTORS):
    return spark.createDataFrame([(i, None if v is None else [float(e) if e is not None else None for e in v], 0) for i, v in zip(ids if ids is not None else range(len(x)), x)], kind)


def true_neighbours(x, ids, k, asks):
    """By plain products: for each asking row its ``k`` best other rows, ties to the smaller id."""
    x, out = np.asarray(x, np.float64), {}
    for i in asks:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out.setdefault(ids[i], [(ids[j], s[j]) for j in order])
    return out


def found(df, rows_an_id=1):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == -(-len(out[r["query_id"]]) // rows_an_id) or rows_an_id > 1
    return out


@pytest.mark.parametrize("noise", [0.25, 3.0])
def test_neighbours_recall(spark, noise):
    x = clustered(noise=noise)
    x[::7] *= 3  # bands of norms
    ids = np.arange(len(x))
    got = found(lsh.nearest(frame(spark, x), F.col("vec_id") % 20 == 0))
    want = true_neighbours(x, ids, 20, ids[::20])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 20 * len(want)
    exact = {(q, i): s for q, v in got.items() for i, s in v}
    wide = np.asarray(x, np.float64)
    assert all(abs(s - wide[q] @ wide[i]) < 1e-12 for (q, i), s in exact.items())


def test_neighbours_query_recall(spark):
    got = found(queries()["op11_neighbours"](spark, DATA))
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    want = true_neighbours(x, ids, 20, np.flatnonzero(ids % 20 == 0))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_neighbours_of_copies_and_edges(spark):
    x = list(clustered(400, 5, 8)) + [np.full(8, 0.5, np.float32)] * 300
    ids = list(range(400)) + [400 + i // 2 for i in range(299)] + [None]
    odd = [None, [], [0.0] * 8, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0], [3.0, 2.0], [1e38, 1e38]]
    df = frame(spark, x + odd, ids + [1000 + 20 * i for i in range(len(odd))]).withColumn("low", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = found(lsh.nearest(df, F.col("vec_id") % 20 == 0), 2)
    asks = [i for i in range(len(x)) if ids[i] is not None and ids[i] % 20 == 0]
    want = true_neighbours(x, np.array([1 << 40 if i is None else i for i in ids]), 20, asks)
    for q in (400, 420, 540):  # rows of one vector: the smallest ids, both rows of a repeated one
        assert len(got[q]) == 40 and [i for i, _ in got[q]][:2] == [400, 400]
        own = [i for i in range(400, 411) for _ in range(2)]
        own.remove(q) if q in own else None
        assert [i for i, _ in got[q]][::2] == own[:20] == [i for i, _ in got[q]][1::2]
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] or len({i for i, _ in got[0]} & {i for i, _ in want[0]}) > 17
    assert [i for i, _ in got[1120]] == [1160, 1140] and 1000 not in got and 1020 not in got and 1040 not in got
    assert lsh.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert lsh.nearest(df, F.col("vec_id") == -1).count() == 0


def test_probe_order():
    rows = lsh.steps(3, 27)
    assert len(rows) == 27 and not rows[0].any() and len({tuple(r) for r in rows.tolist()}) == 27
    assert all(not (r[p] and r[5 - p]) for r in rows for p in range(3))
    tables = lsh.Tables(4, 3, 0.7, 2, 27)
    x = np.random.default_rng(1).normal(size=(50, 5))
    probes = tables.probes(0, x)
    cells = np.floor(tables.places(0, x))
    # every neighbouring cell once, own first
    for i in range(50):
        near = {int(tables.keys(0, cells[i: i + 1] + np.array([[a, b, c]]))[0]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
        assert set(probes[i].tolist()) == near and probes[i, 0] == tables.homes(0, x)[i]


def whitened(df):
    p = df.toPandas()
    return p, p.pivot(index="vec_id", columns="component", values="whitened").to_numpy()


@pytest.mark.parametrize("d", [3, 12])
def test_whitening_against_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(700, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    p, w = whitened(whitening.whiten(frame(spark, x).repartition(9)))
    whole = np.floor(x.astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), whole.sum(axis=0)
    y = whole - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    want = y @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    one = p[p.component == 1].sort_values("vec_id")
    assert (one.deviation.to_numpy() == ((n * whole - s) ** 2).sum(axis=1)).all() and (one.n == n).all()
    assert p.identity_error.nunique() == 1 and p.identity_error[0] < 1e-9
    assert np.abs(p.drop_duplicates("component").sort_values("component").explained.to_numpy() - values[::-1][:8] / values.sum()).max() < 1e-12


def test_whitening_edges(spark):
    flat = [[1.0, 2.0, 3.0], [2.0, 4.0, 3.0], [3.0, 6.0, 3.0], [3.0, 6.0, 3.0]]
    rows = flat + [[1.0, 2.0], None, [], [float("nan")] * 3, [1.0, None, 2.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0]]
    df = frame(spark, rows, [0, 1, None, 2, *range(4, 11)]).withColumn("n", F.lit("clash")).withColumn("d", F.lit("clash"))
    got = whitening.whiten(df).collect()
    three = [r for r in got if r["n"] == 4]
    assert len(three) == 12 and len(got) == 14
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in three) and three[0]["identity_error"] < 1e-9
    alone = [r for r in got if r["n"] == 1]
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alone)
    assert whitening.whiten(df.limit(0)).count() == 0
    # sums and deviations beyond a long are exact
    big = spark.createDataFrame([(i, [float(i) * 2**37, -1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    first = sorted((r["vec_id"], r["deviation"], int(r["deviation_exact"])) for r in whitening.whiten(big).collect() if r["component"] == 1)
    assert first[0] == (0, None, (10 * 2**47) ** 2) and first[2] == (2, 0, 0)


def lloyd(x, ids, k, scale, rounds, seed=1):
    x = np.floor(np.asarray(x, np.float64) * scale).astype(np.int64)
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    assign = lambda: np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    for _ in range(rounds):
        a = assign().argmin(axis=1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    d = assign()
    return d.argmin(axis=1), d.min(axis=1), c


@pytest.mark.parametrize("rounds,k,scale", [(0, 5, 8), (1, 16, 64), (9, 16, 64), (6, 30, 4), (3, 1, 64), (5, 2, 64)])
def test_centroids_equal_plain_rounds(spark, rounds, k, scale):
    x = clustered(1200, 12, 16, 0.4, seed=rounds)
    got = centroids.clusters(frame(spark, x).repartition(5), k, 16, scale, rounds).toPandas().sort_values("vec_id")
    a, d, c = lloyd(x, range(len(x)), k, scale, rounds)
    assert (got.cluster.to_numpy() == a).all() and (got.distance.to_numpy() == d).all() and (got.inertia == d.sum()).all()
    assert all(h == hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j, h in zip(got.cluster, got.centroid_sha256))
    sums = {j: int(d[a == j].sum()) for j in range(k)}
    assert all(sums[j] == s for j, s in zip(got.cluster, got.cluster_inertia))
    if rounds == 9:
        assert got.computed.mean() < 0.6 * k  # bounds spare most of the work once centroids come to rest


def test_centroid_bounds_never_lie():
    rng = np.random.default_rng(8)
    for case in range(60):
        k, b = int(rng.integers(2, 12)), int(rng.integers(1, 5))
        x = rng.integers(-3, 4, (80, 3)).astype(np.int64)  # many ties
        c = rng.integers(-3, 4, (k, 3)).astype(np.int64)
        held = centroids.Bounds.scanned(x, c, min(b, k - 1))
        for _ in range(6):
            new = c + rng.integers(-1, 2, c.shape) * (rng.random((k, 1)) < 0.5)
            moved = centroids._outward(((new - c) ** 2).sum(axis=1), 1)
            held.kept(max(1, held.ids.shape[1] - int(rng.integers(0, 2))))
            held.move(new, moved)
            c = new
            d = ((x[:, None] - c) ** 2).sum(axis=2)
            assert (held.a == d.argmin(axis=1)).all()


def test_centroid_edges(spark):
    rows = [[1.0, 2.0]] * 4 + [[5.0, 5.0], [-3.0, 2.0], None, [], [1.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e30, 1.0]]
    ids = [1, 1, None, None, 2, -4, *range(10, 17)]
    df = frame(spark, rows, ids).withColumn("a", F.lit("clash")).withColumn("q", F.lit("clash"))
    got = centroids.clusters(df, 16, 2, 64, 3)
    a, d, _ = lloyd(rows[:6], ids[:6], 16, 64, 3)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["distance"]) for r in got.collect()) == sorted((i is None, i or 0, int(v)) for i, v in zip(ids[:6], d))
    assert sorted(r["cluster"] for r in got.collect()) == sorted(a.tolist())
    assert centroids.clusters(df.limit(0), 16, 2).count() == 0 and centroids.clusters(df, 16, 3).columns == got.columns


def test_near_vectors_recall_at_the_registered_parameters(spark):
    """Planted neighbours at a cosine of 0.93 to 0.96, ids divisible by 100 against all rows, by degrees and by groups."""
    rng = np.random.default_rng(93)
    base = rng.normal(size=(4000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    u = rng.normal(size=base.shape)
    u -= (u * base).sum(axis=1, keepdims=True) * base
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.96, len(base))[:, None]
    x = np.stack([base, cos * base + np.sqrt(1 - cos**2) * u], axis=1).reshape(-1, 32)  # neighbours at 2i and 2i + 1
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(frame(spark, x.astype(np.float32))).collect()}
    wide = x.astype(np.float32).astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    want = have = 0
    for q in range(0, len(x), 100):
        near = np.flatnonzero(wide @ wide[q] >= 0.93)
        want += len(near) - 1
        have += min(got[q]["n_links"], len(near) - 1)
        assert got[q]["n_links"] <= len(near) - 1
        for j in near:
            assert got[q]["n_links"] < len(near) - 1 or got[q]["component_id"] == got[int(j)]["component_id"]
    assert want >= 80 and have >= 0.95 * want
