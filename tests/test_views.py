import pytest
from perigee import cli, views
from perigee.operators import orbit, radio
from pyspark.sql import functions as F

S = 1_000_000_000
NOW = 1_705_276_800 * S


@pytest.fixture(scope="module")
def objects(spark):
    return orbit.synthetic(spark, 12, NOW).withColumn("ordinal", F.col("object_id")).withColumn("alt_id", F.lit("x")).withColumn("object_type", F.lit("payload")).cache()


def test_catalog_and_states(spark, objects):
    recent = spark.createDataFrame([(40001,), (40001,), (7,)], "object_id long")
    assert [r["object_id"] for r in views.catalog(objects, recent=recent).collect()] == [40001]
    assert views.catalog(objects, "synthetic-1", regime="LEO").count() == 3
    one = views.summary(objects, recent).first()
    assert (one["objects"], one["with_recent_rf"], one["regime_leo"], one["regime_geo"]) == (12, 1, 12, 0)
    x = views.states(objects, NOW, recent).toPandas()
    assert len(x) == 12 and x["recent_rf"].sum() == 1 and list(x.columns) == list(views.STATE)


def test_detail(spark, objects):
    obs = spark.createDataFrame([(40003, 0, "2024-01-15 00:00:00")], "object_id long, ordinal long, at string").withColumn("at", F.col("at").cast("timestamp"))
    a = radio.availability(obs, spark.createDataFrame([(40003, True)], "object_id long, decoder boolean"), F.lit("2024-01-15 01:00:00").cast("timestamp"), 24)
    r = views.detail(objects, 40003, (17.385, 78.4867, 0.545), NOW, a).first()
    assert r["rf_status"] == "AVAILABLE" and len(r["path"]) == 46 and r["age_hours"] == 0.0


def test_sources_and_timeline(spark):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    s = spark.createDataFrame([("a", 5, "2024-01-14 23:00:00"), ("b", 5, "2024-01-01 00:00:00"), ("c", 0, None)], "name string, rows long, refreshed string").withColumn("refreshed", F.col("refreshed").cast("timestamp"))
    assert [(r["state"], r["age_hours"]) for r in views.source_matrix(s, now).orderBy("name").collect()] == [("LIVE", 1.0), ("CACHED", 336.0), ("UNAVAILABLE", -1.0)]
    m = spark.createDataFrame([("m1", 2, "VALID_OPERATION"), ("m0", 1, "CONFIRMED_ANOMALY")], "memory_id string, ordinal long, label string")
    t = views.timeline(spark, m, spark.createDataFrame([("WARNING",)], "severity string")).collect()
    assert [r["kind"] for r in t] == ["NOMINAL", "MEMORY", "MEMORY", "ACTIVE"] and t[1]["label"] == "CONFIRMED_ANOMALY"
    f = views.feedback(m, spark.createDataFrame([("e",)], "event_id string"), "VALID_OPERATION", 9)
    assert f.count() == 3
    assert views.assets(spark, {"x": True, "y": False}).count() == 2
    words = spark.createDataFrame([(None,), (-1.0,), (0.5,), (3.2,), (100.0,)], "h double")
    assert [r[0] for r in words.select(views.freshness(F.col("h"))).collect()] == ["unknown", "unknown", "30 min", "3 h", "4 d"]
    assert spark.range(1).select(views.place(F.lit(-1.5), F.lit(2.25))).first()[0] == "1.50S 2.25E"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,value\n1,2\n")
    assert cli.main(["profile", str(tmp_path / "a.csv")]) == 0 and "integer" in capsys.readouterr().out
    assert cli.main(["query", "nothing", str(tmp_path)]) == 2
    a, b = cli.new_run(str(tmp_path), {"x": 1}), cli.new_run(str(tmp_path), {"x": 1})
    assert a != b and a.name[:12] == b.name[:12]


def test_mission_views_and_manifests(spark, tmp_path):
    import json

    from perigee.operators import memory
    from perigee.sources import manifests, tables

    m = spark.createDataFrame([("a", 1)], "memory_id string, ordinal long")
    one = views.mission_summary(spark, "demo", None, None, ["channel_1", "channel_2"], m).first()
    assert (one["operational_state"], one["channel_count"], one["stored_patterns"]) == ("Nominal", 2, 1)
    assert memory.cleared(m).count() == 0 and memory.cleared(m).columns == m.columns
    assert views.fleet(spark, []).first()["state"] == "NO AUTHORIZED FLEET" and views.fleet(spark, [("x", "X")]).first()["state"] == "AUTHORIZED"
    assert views.spacecraft(spark, "x", "X", ["channel_1"]).first()["stream_state"] == "HISTORICAL" and views.health(spark).first()["status"] == "ok"
    ev = spark.createDataFrame([("e1", "A", "x", 5, 12), ("e2", "A", "y", 15, 16), ("e3", "B", "x", 30, 31)], "event_id string, category string, class string, start_ns long, end_ns long")
    t = spark.createDataFrame([("c", i, 0.0) for i in range(1, 40)], "channel string, ts_ns long, value double")
    assert tuple(views.research(spark, ev, t, m).first()) == (3, 1, 1)
    got = manifests.split_manifest(ev, 0, 50, 10, 20, t)
    assert got["events_by_category"] == {"train": {"A": 1}, "validation": {"A": 1}, "test": {"B": 1}} and got["events_by_class"]["test"] == {"B": {"x": 1}}
    assert got["crossing"] == {"validation": ["e1"], "test": []} and got["telemetry_rows"] == {"train": 10, "validation": 10, "test": 19}
    assert manifests.boundaries(0, manifests.VALIDATION, manifests.TEST, 2 * 10**18)["train"]["end"] == "2006-10-01T00:00:00Z"
    with pytest.raises(Exception, match="outside the extent"):
        manifests.split_manifest(ev, 6, 50, 10, 20)
    with pytest.raises(ValueError):
        manifests.boundaries(0, 20, 10, 50)
    a, b = (manifests.subset_manifest({"t": x}, {"k": 1}) for x in (t, t.repartition(3)))
    assert a["tables"] == b["tables"] and a["identity"] == b["identity"]
    ev.write.parquet(str(tmp_path / "ev"))
    spark.createDataFrame([("telecommand_1", 4, 1)], "telecommand string, ts_ns long, priority long").write.parquet(str(tmp_path / "co"))
    for name, more in (("split", []), ("recurrence", []), ("context", [str(tmp_path / "co")])):
        assert cli.main([name, str(tmp_path / "ev"), *more, "--validation", "10", "--test", "20", "--out", str(tmp_path / name)]) == 0
    assert json.loads((tmp_path / "split").read_text())["events"] == 3 and "| A | x |" in (tmp_path / "recurrence").read_text() and "24h" in (tmp_path / "context").read_text()
    assert tables.identity({"a": 1}) != tables.identity({"a": 2})
