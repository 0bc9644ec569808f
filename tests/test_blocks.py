"""Windows answered from blocks of samples: the same as from their pairs, and few blocks however long a window is."""

import random

import pytest
from pyspark.sql import functions as F

from perigee.operators import blocks, detect, ranges, signature


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(5)
    hour = 3_600 * 10**9
    rows = [(f"channel_{rnd.choice((41, 42))}", rnd.randrange(0, 80 * hour, hour // 7), rnd.choice([None, float("nan"), 5.0, rnd.gauss(1e6, 1.0)]), rnd.random() * 4) for _ in range(900)]
    ends = [(rnd.randrange(-hour, 90 * hour), rnd.randrange(0, 70 * hour)) for _ in range(40)] + [(3, -1), (hour, 0), (-9 * hour, hour)]
    s = spark.createDataFrame(sorted(set(rows), key=str), "channel string, ts_ns long, value double, score double").dropDuplicates(["channel", "ts_ns"]).localCheckpoint()
    w = spark.createDataFrame([(f"e{i}", a, a + n) for i, (a, n) in enumerate(ends + ends[:3])], "event_id string, start_ns long, end_ns long")
    return s, w


def test_features_equal_those_of_pairs(spark, made, monkeypatch):
    monkeypatch.setattr(blocks, "BASE", 3)
    monkeypatch.setattr(blocks, "SINGLE", 4)
    s, w = made
    names = ["channel_41", "channel_42"]
    got, want = ({(r["event_id"], r["channel"]): r for r in x.collect()} for x in (signature.window_features(s, w, names), signature.channel_features(signature.window_samples(s, w, names))))
    assert got.keys() == want.keys() and len(got) == 92
    for k, r in want.items():
        assert [got[k][c] for c in signature.PER_CHANNEL] == pytest.approx([r[c] for c in signature.PER_CHANNEL], rel=1e-9, abs=1e-9), k


def test_extents_and_alarms_equal_those_of_pairs(spark, made):
    s, w = made
    points = s.select("channel", "score", F.col("ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"))
    pairs = ranges.interval_join(points, w).select(F.col("b_event_id").alias("event_id"), "channel", F.col("start_ns").alias("ts_ns"), "score").localCheckpoint()
    want = {tuple(r) for r in pairs.groupBy("event_id", "channel").agg(F.count("*"), F.min("ts_ns"), F.max("ts_ns")).collect()}
    assert {tuple(r) for r in blocks.extents(s, w, ["channel"]).select("event_id", "channel", "samples", "first_ns", "last_ns").collect()} == want
    want = {tuple(r) for r in detect.event_alarms(pairs, 3.9).select("event_id", "alarm").collect()}
    assert {tuple(r) for r in detect.window_alarms(s, w, 3.9).collect()} == want and len({a for _, a in want}) == 2


def test_a_long_window_is_few_blocks(spark):
    x = spark.createDataFrame([(5, 1_000_003), (0, 8**6), (7, 300), (9, 9)], "low long, high long")
    rows = x.select("low", "high", blocks._cover(8).alias("b")).collect()
    for r in rows:
        held = sorted((b["block"] * 8 ** b["size"], (b["block"] + 1) * 8 ** b["size"]) for b in r["b"])
        assert all(a[1] == b[0] for a, b in zip(held, held[1:])) and sum(b - a for a, b in held) == r["high"] - r["low"]
        assert len(held) <= max(blocks.SINGLE if r["high"] - r["low"] <= blocks.SINGLE else 0, 16 * 8)
    assert len(rows[1]["b"]) == 1


def test_registered_window_queries_make_no_pairs(spark, monkeypatch):
    """Windows that overlap must not be joined to their samples one by one."""
    from perigee.plans import queries

    def refused(*_, **__):
        raise AssertionError("pairs of windows and samples")

    monkeypatch.setattr(ranges, "interval_join", refused)
    for name in ("j5_window_samples", "m6_event_alarms", "g1_channel_features", "g2_affected_channels"):
        assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_grid_passes_in_one_shuffle(spark):
    """The grid is read and shuffled once, not joined to itself twice."""
    from perigee.operators import orbit

    minute = 60 * 10**9
    heights = {1: [0, 6, 9, 2, 7], 2: [1, None, 2, 3, 4], 3: [6, 7, None, 8, 1], 4: [0, 0, 0, 0, 6]}
    grid = spark.createDataFrame([(k, m * minute, None if h is None else float(h)) for k, row in heights.items() for m, h in enumerate(row)], "object_id long, at_ns long, elevation_deg double")
    x = orbit.grid_passes(grid, 0)
    assert {(r["object_id"], r["aos_ns"] // minute, r["los_ns"] // minute, r["max_elevation_deg"], r["status"][:4]) for r in x.collect()} == {(1, 1, 3, 9.0, "PASS"), (3, 0, 2, 7.0, "PASS"), (2, 135, 146, 48.5, "ESTI"), (4, 135, 146, 48.5, "ESTI")}
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_checked_series_of_a_table_with_repeated_times(spark):
    from perigee.operators import series

    t = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 1.0)], "channel string, ts_ns long, value double")
    assert series.checked(t, repeated=True).count() == 3
    for bad in ("null as channel, 5L as ts_ns", "'a' as channel, cast(null as bigint) as ts_ns"):
        with pytest.raises(Exception, match="times don't increase"):
            series.checked(t.unionByName(spark.sql(f"select {bad}, 1.0D as value")), repeated=True).collect()
    with pytest.raises(Exception, match="times don't increase"):
        series.checked(t).collect()


def test_orbits_of_one_file_are_computed_by_all_cores(spark):
    from perigee.operators import orbit

    one = orbit.synthetic(spark, 300, 0).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    for x in (orbit.next_passes(one, (17.0, 78.0, 0.5), 0, hours=1), orbit.ground_track(one, 0, 3, 3)):
        parts = x.groupBy(F.spark_partition_id()).count().count()
        assert parts >= cores and x.select("object_id").distinct().count() == 300
