import json
import time
import zipfile

import pytest
from perigee.operators import memory  # noqa: F401
from perigee.sources import archives, tables
from perigee.streaming import jobs
from pyspark.sql import functions as F


def test_telemetry_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("channel_41", 1, 1.25), ("channel_41", 2, float("nan")), ("channel_4", 3, None)], tables.TELEMETRY)
    tables.write_telemetry(x, str(tmp_path / "t"))
    got = sorted((r["channel"], r["ts_ns"], r["value"]) for r in tables.read_parquet(spark, str(tmp_path / "t")).collect())
    assert got == [("channel_4", 3, None), ("channel_41", 1, 1.25), ("channel_41", 2, None)]
    with pytest.raises(Exception, match="already exists"):
        tables.write_telemetry(x, str(tmp_path / "t"))
    with pytest.raises(tables.SchemaError):
        tables.write_telemetry(x.withColumn("extra", F.lit(1)), str(tmp_path / "u"))


def test_nanoseconds_arrive_as_long(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"t": pa.array([1325376000000000001], pa.timestamp("ns"))}), tmp_path / "n.parquet")
    assert tables.read_parquet(spark, str(tmp_path / "n.parquet")).first()["t"] == 1325376000000000001


def test_commands_need_definitions(spark, tmp_path):
    e = spark.createDataFrame([("a", 2, 1), ("b", 1, 0)], "telecommand string, ts_ns long, execution_value int")
    d = spark.createDataFrame([("a", 1), ("b", 3)], "telecommand string, priority int")
    assert tables.write_commands(e, d, str(tmp_path / "c")) == 2
    with pytest.raises(tables.SchemaError):
        tables.write_commands(e, d.where("telecommand = 'a'"), str(tmp_path / "x"))


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿record_id;name;value\n1;é;2\n2;;3\n".encode())
    x, form = archives.read_delimited(spark, str(tmp_path / "a.csv"))
    assert form["delimiter"] == ";" and form["header"] and x.columns == ["record_id", "name", "value"] and x.count() == 2
    (tmp_path / "b.txt").write_bytes(b"1\t2\n3\t\xe9\n")
    x, form = archives.read_delimited(spark, str(tmp_path / "b.txt"))
    assert form["encoding"] == "windows-1252" and x.columns == ["column_1", "column_2"] and x.collect()[1][1] == "é"
    assert archives.sniff(b"")["columns"] == []


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("deep.csv", "a")
    with zipfile.ZipFile(tmp_path / "out.zip", "w") as z:
        z.write(tmp_path / "in.zip", "sub/in.zip")
        z.writestr("x.txt", "hello")
    got = {(r["member"], r["depth"], r["size"]) for r in archives.members(spark, str(tmp_path), "out.zip").collect()}
    assert {m[:2] for m in got} == {("sub/in.zip", 0), ("sub/in.zip!deep.csv", 1), ("x.txt", 0)}


def test_elements(spark, tmp_path):
    rows = [{"NORAD_CAT_ID": 1, "EPOCH": "2024-01-01T00:00:00.123456", "MEAN_MOTION": 15.5}, {"NORAD_CAT_ID": 0}, {"NORAD_CAT_ID": 2, "MEAN_MOTION": "junk"}, {"NORAD_CAT_ID": 1, "OBJECT_NAME": "LAST", "EPOCH": "2024-01-02T00:00:00"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = tables.read_elements(spark, str(tmp_path / "c.json")).collect()
    assert [(r["object_id"], r["name"], r["mean_motion"]) for r in got] == [(1, "LAST", 15.0)]


def test_json_and_digests(spark, tmp_path):
    assert tables.canonical_json({"b": float("nan"), "a": [1]}) == tables.canonical_json({"a": (1,), "b": None})
    tables.write_json({"x": 1}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"x": 1}
    assert tables.identity({"a": 1, "b": 2}) == tables.identity({"b": 2, "a": 1})
    x = spark.range(10)
    assert tables.content_digest(x) == tables.content_digest(x.repartition(3)) != tables.content_digest(x.limit(9))
    assert "N/A" in tables.markdown(spark.createDataFrame([(None,)], "a int"), "t")
    tiers = [spark.createDataFrame([(1, "live")], "k int, v string"), spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")]
    assert sorted(map(tuple, tables.freshest(tiers, "k").select("k", "v").collect())) == [(1, "live"), (2, "old")]


SIGNED = "mission string, event_id string, t long, category string, vector array<double>, affected array<string>, telemetry_features map<string,double>, context_features map<string,double>"


def signed(event_id, t, category, vector, affected=("a",), score=1.0, near=10.0, count=1.0):
    return "m", event_id, t, category, list(vector), list(affected), {"agg_score_max": score}, {"nearest_tc_diff_sec": near, "tc_count_5m": count}


def test_streams(spark, tmp_path):
    S = 1_000_000_000
    rows = [signed(f"e{i}", i, "Rare Event", [1.0, 2.0]) for i in range(3)] + [signed("other", 9, "Anomaly", [-5.0, 1.0], ("z",), 1.0, 9999.0, 60.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SIGNED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = lambda s: jobs.memory_stream(s.withColumn("at", F.timestamp_seconds("t")).drop("t"))
    got = {r["event_id"]: r["status"] for r in jobs.replay(spark, str(tmp_path / "in"), t, str(tmp_path / "out")).collect()}
    assert len(got) == 4 and sum(got[f"e{i}"] == "KNOWN" for i in range(3)) == 2 and got["other"] == "UNKNOWN"
    samples = [("c", i * S, 9.0 if i % 100 < 3 else 0.0) for i in range(400)]
    spark.createDataFrame(samples, "channel string, ts_ns long, value double").write.parquet(str(tmp_path / "s"))
    p = spark.createDataFrame([("c", 0.0, 1.0)], "channel string, center double, scale double")
    got = jobs.replay(spark, str(tmp_path / "s"), lambda s: jobs.alarm_sessions(jobs.scored(s, p), "10 seconds", "0 seconds"), str(tmp_path / "so"))
    assert sorted(r["alarms"] for r in got.collect()) == [3, 3, 3]
    from perigee.operators import orbit

    ticks = spark.createDataFrame([(1_705_276_800,)], "s long").select(F.timestamp_seconds("s").alias("timestamp"))
    jobs.snapshot_writer(orbit.synthetic(spark, 5, 1_705_276_800 * S))(ticks, 0)
    assert spark.table("object_states").count() == 5


def test_replay_does_not_depend_on_files(spark, tmp_path):
    S = 1_000_000_000
    rows = [("c", i * S, 9.0 if i % 100 < 3 else 0.0) for i in range(4000)]
    p = spark.createDataFrame([("c", 0.0, 1.0)], "channel string, center double, scale double")
    got = []
    for n in (1, 7):
        spark.createDataFrame(rows, "channel string, ts_ns long, value double").orderBy(F.xxhash64("ts_ns")).repartition(n).write.parquet(str(tmp_path / f"in{n}"))
        out = jobs.replay(spark, str(tmp_path / f"in{n}"), lambda s: jobs.alarm_sessions(jobs.scored(s, p), "10 seconds"), str(tmp_path / f"out{n}"))
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] and len(got[0]) == 33 and {r[3] for r in got[0]} == {3}
    events = spark.createDataFrame([signed(f"e{i}", i, "Rare Event", [1.0, 2.0]) for i in range(3)], SIGNED)
    events.repartition(3, "t").write.parquet(str(tmp_path / "e"))
    t = lambda s: jobs.memory_stream(s.withColumn("at", F.timestamp_seconds("t")).drop("t"))
    known = jobs.replay(spark, str(tmp_path / "e"), t, str(tmp_path / "eo"), files=1).where("status = 'KNOWN'")
    assert known.count() == 2


def test_stream_decides_as_the_batch(spark, tmp_path):
    """The memory stream over all events at once equals the study in which every event asks."""
    import random

    from perigee.operators import memory

    rng = random.Random(4)
    rows = [signed(f"e{i:03d}", rng.randrange(300), rng.choice(["Rare Event", "Anomaly"]), [rng.choice([1.0, 2.0, -3.0]) for _ in range(4)], rng.sample("abcd", 2), rng.choice([1.0, 3.0, 6.0]), rng.choice([0.0, 50.0, 9000.0]), rng.choice([0.0, 3.0])) for i in range(70)]
    x = spark.createDataFrame(rows, SIGNED)
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    t = lambda s: jobs.memory_stream(s.withColumn("at", F.timestamp_seconds("t")).drop("t"), 0.85)
    got = {r["event_id"]: (r["status"], round(r["similarity"], 9), r["nearest_id"]) for r in jobs.replay(spark, str(tmp_path / "in"), t, str(tmp_path / "out")).collect()}
    cohort = x.select("event_id", "category", (F.col("t") * 1_000_000_000).alias("start_ns"), F.lit(True).alias("alarm"))
    want = {r["event_id"]: ("KNOWN" if r["recognized"] else "UNKNOWN", round(r["best_similarity"], 9), r["matched_id"]) for r in memory.study(x, cohort, 0.85, "open").collect()}
    assert got == want and {v[0] for v in got.values()} == {"KNOWN", "UNKNOWN"}
    short = lambda s: jobs.memory_stream(s.withColumn("at", F.timestamp_seconds("t")).drop("t"), 0.85, keep=1)
    assert jobs.replay(spark, str(tmp_path / "in"), short, str(tmp_path / "out2")).where("status = 'KNOWN'").count() < sum(v[0] == "KNOWN" for v in got.values())


def test_snapshot_ticks_and_refresh(spark, tmp_path):
    from perigee.operators import orbit

    now = 1_705_276_800
    objects = orbit.synthetic(spark, 1500, now * 1_000_000_000)
    ticks = spark.createDataFrame([(now,), (now + 1,)], "s long").select(F.timestamp_seconds("s").alias("timestamp"))
    assert jobs.object_ticks(ticks, objects, [40003, 41400]).count() == 4
    write = jobs.snapshot_writer(objects.limit(5), "snap", f"file://{tmp_path}/snap")
    write(ticks, 0)
    write(ticks, 1)
    snap = spark.table("snap")
    assert snap.count() == 5 and "FileScan" in snap._jdf.queryExecution().executedPlan().toString()
    assert jobs.is_fresh(snap, (now + 2) * 10**9) and not jobs.is_fresh(snap, (now + 9) * 10**9)
    loads = []
    q = jobs.start_refresh(spark, lambda: loads.append(1) or objects.limit(7), str(tmp_path / "state"), "fresh_catalog", "1 second")
    try:
        for _ in range(300):
            if spark.catalog.tableExists("fresh_catalog"):
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert loads and spark.table("fresh_catalog").count() == 7


def test_delimited_profiles(spark, tmp_path):
    from perigee.operators import profile
    from perigee.sources import archives

    path = tmp_path / "t.csv"
    path.write_text("event_id;Start Time;value;value\n" + "".join(f"{i};2024-01-01T00:{i:02d}:00Z;{i / 2};\n" for i in range(40)) + "40;2024-01-01T00:40:00Z\n41;2024-01-01T00:41:00Z;1;2;3;4\n", encoding="utf-8")
    got = profile.delimited(spark, str(path))
    one = got["summary"].first()
    assert (one["rows_read"], one["row_count"], one["is_estimate"], one["malformed_rows"], one["extra_fields"], one["duplicate_names"], one["delimiter"], one["header"]) == (42, 42, False, 2, 2, ["value"], ";", True)
    kinds = {r["column"]: r for r in got["columns"].collect()}
    assert (kinds["event_id"]["inferred_type"], kinds["value"]["inferred_type"], kinds["value"]["null_count"], kinds["value_4"]["null_count"]) == ("integer", "float", 1, 41)
    times = got["times"].collect()
    assert [(r["column"], r["representation"], r["by_name"], r["by_values"]) for r in times] == [("Start Time", "ISO-8601-like string", True, True)]
    step = profile.sampling_interval(got["times"]).first()
    assert (step["assessment"], step["interval"], step["unit"], step["intervals"]) == ("uniform", 60.0, "seconds", 41)
    assert [r["column"] for r in profile.value_candidates(got["observed"], got["columns"]).collect()] == ["value", "value_4"]
    part = profile.delimited(spark, str(path), row_limit=10)["summary"].first()
    assert part["rows_read"] == 10 and part["is_estimate"] and 35 <= part["row_count"] <= 50
    odd = tmp_path / "o.txt"
    odd.write_bytes("1|caf\xe9|2\n2|x|9\n4|y|7\n".encode("cp1252"))
    got = profile.delimited(spark, str(odd))
    assert got["summary"].first()["encoding"] == "windows-1252" and not got["summary"].first()["header"]
    assert got["columns"].where("`column` = 'column_2'").first()["examples"][0] == "caf\xe9"
    assert profile.sampling_interval(got["times"]).count() == 0 or got["times"].count() == 0
    assert archives.head(spark, str(path), 5)[0] == b"event"


def test_archive_members_are_opened_in_place(spark, tmp_path):
    import io
    import zipfile

    from perigee.sources import archives

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/a.csv", "x" * 1000)
        z.writestr("noext", "y")
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("channels/c.zip", inner.getvalue())
        z.writestr("labels.csv", "id\n1\n")
    found = archives.members(spark, str(tmp_path))
    assert sorted((r["member"], r["depth"], r["size"]) for r in found.collect()) == [("channels/c.zip", 0, len(inner.getvalue())), ("channels/c.zip!deep/a.csv", 1, 1000), ("channels/c.zip!noext", 1, 1), ("labels.csv", 0, 5)]
    one = archives.summary(found).first()
    assert (one["members"], one["archives"], one["extensions"]) == (4, 1, {".csv": 2, ".zip": 1, "<none>": 1})


def test_catalog_load_counts_and_reports(spark, tmp_path):
    rows = [{"NORAD_CAT_ID": "1", "EPOCH": "2024-01-01T00:00:00"}, {"NORAD_CAT_ID": "1", "EPOCH": "2024-01-02T00:00:00"}, {"NORAD_CAT_ID": "x"}, {"NORAD_CAT_ID": "2", "MEAN_MOTION": "bad"}, {"NORAD_CAT_ID": "-5"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    assert tuple(tables.load_counts(spark, str(tmp_path / "c.json")).first()) == (5, 2, 3, 1)
    with pytest.raises(ValueError, match="more than 2 rows"):
        tables.markdown(spark.range(3), "t", 2)
    assert tables.seconds(1_500_000_000) == "1.500000" and tables.seconds(None) == "N/A"
