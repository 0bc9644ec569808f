import random

import pytest
from perigee.operators import ranges
from pyspark.sql import functions as F

KIND = "k long, start_ns long, end_ns long"


def brute_union(xs):
    out = []
    for s, e in sorted(xs):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def brute_subtract(xs, ms):
    keep = {p for s, e in xs for p in range(s, e + 1)} - {p for s, e in ms for p in range(s, e + 1)}
    return brute_union([(p, p) for p in keep])


def random_intervals(rng, n, top=300):
    return [(k, s, s + rng.choice([0, 0, 1, 2, 5, 40])) for k, s in ((rng.randrange(4), rng.randrange(top)) for _ in range(n))]


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 50)])
def test_union_and_subtract_against_brute_force(spark, seed, width):
    rng = random.Random(seed)
    a, m = random_intervals(rng, 60), random_intervals(rng, 40)
    x, y = spark.createDataFrame(a, KIND), spark.createDataFrame(m, KIND)
    got = sorted(map(tuple, ranges.union(x, ["k"], width).select("k", "start_ns", "end_ns").collect()))
    assert got == sorted((k, *i) for k in range(4) for i in brute_union([v[1:] for v in a if v[0] == k]))
    got = sorted(map(tuple, ranges.subtract(x, y).select("start_ns", "end_ns").collect()))
    assert got == brute_subtract([v[1:] for v in a], [v[1:] for v in m])


@pytest.mark.parametrize("width,top", [(3, 0), (3, 2), (1000, 2)])
def test_interval_join_meets_every_pair_once(spark, width, top):
    rng = random.Random(5)
    a, b = random_intervals(rng, 50), [*random_intervals(rng, 50), (0, -500, 900), (1, 10, 10)]
    x, y = spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND)
    got = sorted(map(tuple, ranges.interval_join(x, y, ["k"], width, top).select("k", "start_ns", "end_ns", "b_start_ns", "b_end_ns").collect()))
    assert got == sorted((p[0], *p[1:], *q[1:]) for p in a for q in b if p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2])


@pytest.mark.parametrize("width", [10, 10_000])
def test_islands(spark, width):
    rng = random.Random(3)
    ts = sorted(rng.sample(range(1000), 200))
    samples = [(0, t, rng.random() < 0.6) for t in ts]
    want, cur = [], None
    for i, (_, t, p) in enumerate(samples):
        if p:
            if cur and samples[i - 1][2] and t - samples[i - 1][1] <= 6:
                cur[1] = i
            else:
                cur = [i, i]
                want.append(cur)
        else:
            cur = None
    ends = []
    for a, z in want:
        last = samples[z][1]
        end = min(samples[z + 1][1] - 1 if z + 1 < len(samples) else last, last + 6)
        ends.append((samples[a][1], max(samples[a][1], end)))
    x = spark.createDataFrame(samples, "k long, ts_ns long, positive boolean")
    assert sorted(map(tuple, ranges.islands(x, ["k"], 6, width).select("start_ns", "end_ns").collect())) == ends


def test_empty_inputs(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(1, 5, 9)], KIND)
    assert ranges.union(none).count() == 0
    assert ranges.subtract(none, some).count() == 0
    assert [tuple(r) for r in ranges.subtract(some, none).collect()] == [(5, 9)]
    assert ranges.duration(none).first()[0] == 0
    assert ranges.subtract(some, spark.createDataFrame([(0, 0, 100)], KIND)).count() == 0
    assert sorted(map(tuple, ranges.subtract(some, spark.createDataFrame([(0, 6, 7)], KIND)).collect())) == [(5, 5), (8, 9)]


def test_interval_join_of_a_small_and_a_large_side(spark, monkeypatch):
    """Half of all points in one hour, intervals of a moment to a year: broadcast, shuffled and by plain comparison alike."""
    hour, rng = 3_600_000_000_000, random.Random(4)
    points = [("ab"[i % 2], rng.randrange(hour) if i % 2 else rng.randrange(400 * 24 * hour)) for i in range(400)]
    spans = [(i, "ab"[i % 3 % 2], s, s + rng.choice([-1, 0, 5, hour, 40 * hour, 24 * 365 * hour])) for i in range(60) for s in [rng.randrange(2 * hour) if i % 2 else rng.randrange(300 * 24 * hour)]]
    a = spark.createDataFrame([(k, t, t) for k, t in points] + [("a", 0, 200 * 24 * hour)], "k string, start_ns long, end_ns long")
    b = spark.createDataFrame(spans, "id long, k string, start_ns long, end_ns long")
    got = []
    for small in (0, 200_000):
        monkeypatch.setattr(ranges, "SMALL", small)
        x = ranges.interval_join(a, b, ["k"])
        assert ("BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString()) or not small
        got.append(sorted((r["k"], r["start_ns"], r["end_ns"], r["b_id"]) for r in x.collect()))
    want = sorted((k, s, e, i) for k, s, e in [(k, t, t) for k, t in points] + [("a", 0, 200 * 24 * hour)] for i, bk, bs, be in spans if k == bk and bs <= be and s <= be and bs <= e)
    assert got[0] == got[1] == want and len(want) > 500
    assert ranges.interval_join(a, b.where("1 = 0"), ["k"]).count() == 0


def test_runs_of_several_flags_in_one_pass(spark):
    rng = random.Random(9)
    rows = [(t * 10 + rng.randrange(5), rng.random() < 0.6, rng.choice([True, False, None])) for t in range(400) if rng.random() < 0.8]
    x = spark.createDataFrame(rows, "ts_ns long, p boolean, q boolean")
    got = ranges.run_counts(x, {"p": F.col("p"), "q": F.col("q")}, 14, 100).first()
    for n in "pq":
        assert got[n] == ranges.islands(x.select("ts_ns", F.col(n).alias("positive")), (), 14).count()
