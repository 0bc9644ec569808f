"""Records that age through their tiers, across restarts, and figures of runs."""

import json
import time

from pyspark.sql import functions as F

from perigee.sources import manifests, tables
from perigee.streaming import jobs

ASKS = "object_id long, asked_ns long, payload string"


def test_records_age_through_all_tiers(spark, tmp_path):
    held = spark.createDataFrame([(7, "old of 7", 1)], "object_id long, payload string, at_ms long")
    spark.createDataFrame([], ASKS).write.parquet(str(tmp_path / "in"))

    def step(rows):
        spark.createDataFrame(rows, ASKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {tuple(r) for r in jobs.replay(spark, str(tmp_path / "in"), lambda s: jobs.record_tiers(s, 4, "none", held), str(tmp_path / "out"), once=True).collect()}
        new = before - step.seen
        step.seen |= before
        return {(r[0], r[1]): (r[2], r[3], r[4]) for r in new}

    step.seen = set()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        got = step([(1, 10, "first of 1"), (1, 11, None), (2, 12, None), (7, 13, None)])
        assert {k: v[:2] for k, v in got.items()} == {(1, 10): ("live", "first of 1"), (1, 11): ("cached", "first of 1"), (2, 12): ("fallback", "none"), (7, 13): ("stale", "old of 7")}
        time.sleep(5)
        # every step is a restart of the query from its checkpoint
        got = step([(1, 20, None), (2, 21, "first of 2"), (2, 22, None)])
        assert got[1, 20][:2] == ("stale", "first of 1") and got[1, 20][2] >= 4 and got[2, 21][0] == "live" and got[2, 22][0] == "cached"
        got |= step([(1, 30, "second of 1"), (1, 31, None)])
        assert got[1, 31][:2] == ("cached", "second of 1")
        assert any(v[0] == "expired" and v[1] == "first of 1" for k, v in got.items() if k[0] == 1)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_a_run_has_its_figures(spark, tmp_path):
    with manifests.Run(spark, "count", str(tmp_path)) as r:
        spark.range(50_000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "t"))
    got = r.record
    assert got["jobs"] >= 1 and got["stages"]["output_rows"] == 7 and got["stages"]["tasks"] >= 2 and got["stages"]["shuffle_write_bytes"] > 0
    assert got["stages"]["peak_execution_memory_bytes"] > 0 and any(e["id"] == "driver" for e in got["executors"]) and got["git"] is None and not got["failed"]
    assert json.loads(tables.canonical_json(got))["name"] == "count"
    spark.range(9).count()
    with manifests.Run(spark, "none") as r:
        pass
    assert r.record["jobs"] == 0 and r.record["stages"]["tasks"] == 0
    state = manifests.git_state(__file__.rsplit("/", 2)[0])
    assert state is None or len(state["commit"]) == 40
