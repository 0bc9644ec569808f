"""Queries on catalog objects, radio observations, text profiles, signatures and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.functions import geo, text
from perigee.functions.clock import SECOND
from perigee.operators import detect, forest, labels, memory, orbit, profile, radio, series, signature
from perigee.plans import views as v
from perigee.plans.views import SELECTED, TEST, VALIDATION, sql
from perigee.sources import tables
from perigee.streaming import jobs

EPOCH = 1_705_276_800 * SECOND
STATION = (17.385, 78.4867, 0.545)
NOW = "2024-01-30 00:00:00"


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def objects(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(s, d, "part").select(
        (k + 10000).alias("object_id"), F.col("p_name").alias("name"), F.concat(F.lit("P-"), k.cast("string")).alias("alt_id"), F.col("p_brand").alias("object_type"), k.alias("ordinal"),
        (F.lit(0.9) + (k * 37 % 150) / 10.0).alias("mean_motion"), ((k % 50) / 1000.0).alias("eccentricity"), (k * 7 % 98).cast("double").alias("inclination"), (k * 17 % 360).cast("double").alias("raan"),
        (k * 29 % 360).cast("double").alias("arg_perigee"), (k * 53 % 360).cast("double").alias("mean_anomaly"), F.lit(0.00002).alias("bstar"), F.lit(EPOCH).alias("epoch_ns"))


def _places(s, d):
    """Positions by arithmetic alone, for the geometry that both engines compute."""
    k = F.col("p_partkey")
    return _table(s, d, "part").select((k + 10000).alias("object_id"), (6800.0 + k % 400).alias("x"), ((k * 31 % 8000) - 4000.0).alias("y"), ((k * 17 % 9000) - 4500.0).alias("z"), (F.lit(2460310.5) + (k % 100) / 10.0).alias("jd"))


def _elevations(s, d):
    """A stored grid of elevations by arithmetic alone: objects rise and set, some never, some don't set in time."""
    k, minute = F.col("p_partkey"), F.explode(F.sequence(F.lit(0), F.lit(239))).alias("minute")
    x = _table(s, d, "part").select("p_partkey", minute)
    height = F.when(k % 11 == 0, -10.0).when((k % 7 == 0) & (F.col("minute") > 100), 20.0).when((F.col("minute") * 13 + k) % 97 == 0, F.lit(None)).otherwise(((F.col("minute") + k * 17) % 90 - 70.0))
    return x.select((k + 10000).alias("object_id"), (F.lit(EPOCH) + F.col("minute").cast("long") * 60 * SECOND).alias("at_ns"), height.cast("double").alias("elevation_deg"))


def _raw(s, d):
    e = v.events(s, d)
    start = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("GS"), (F.col("event_id") % 11).cast("string")))
    number = F.when(F.col("event_id") % 5 == 0, "").otherwise((F.col("event_id") % 40 + 1).cast("string"))
    payload = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "start": "'), F.when(F.col("event_id") % 7 == 0, "").otherwise(start), F.lit('", "end": "'), start,
                       F.lit('", "station_name": "'), name, F.lit('", "station": "'), number, F.lit('", "status": "'), F.col("event_type"), F.lit('"}'))
    return e.select((F.col("user_id") + 10000).alias("object_id"), F.col("event_id").alias("ordinal"), payload.alias("payload"), (F.col("user_id") % 4 != 0).alias("decoder"))


#: Pieces of paths that every rule of the source kinds meets.
_DIRS = ("data/channels", "archive.zip!channels", "x", "telemetry/raw", "misc", "labels", "deep/a.b")
_NAMES = ("channel_41.csv", "channel_41.zip!channel_41", "readme.md", "values.parquet", "channel_7.npy", "telecommands.csv", "anomaly_types.csv", "channels.csv", "plain")
_HEADERS = ("event_id", "Start Time", "end", "channel", "subclass", "value", "timestamp", "reading", "epoch", "plain", "event_type", "finish")


def _paths(s, d):
    k = F.col("p_partkey")
    at = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    return _table(s, d, "part").select("p_partkey", F.concat(at(_DIRS, k % len(_DIRS)), F.lit("/"), at(_NAMES, F.floor(k / len(_DIRS)) % len(_NAMES))).alias("path"))


def _headers(s, d):
    k = F.col("n_nationkey")
    return _table(s, d, "nation").select(F.concat(F.element_at(F.array(*map(F.lit, _HEADERS)), (k % len(_HEADERS) + 1).cast("int")), F.when(k >= len(_HEADERS), F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("header"))


def _as_text(s, d):
    """Events as a table of text, with seconds under a name that says so."""
    return v.events(s, d).select("event_id", F.col("ts").cast("string").alias("ts"), "event_type", F.floor(F.col("ts_ns") / 10**9).cast("string").alias("event_time"))


def _entries(s, d):
    t = v.telemetry(s, d)
    n = t.groupBy("channel").agg(F.count("*").alias("row_count"), (F.count_if(F.col("value").isNull()) > 0).alias("missing"))
    x = series.intervals(t).join(n, "channel")
    return x.select(F.concat(F.lit("channels/"), F.col("channel"), F.lit(".parquet")).alias("path"), F.lit(".parquet").alias("format"), "row_count", F.when(F.col("interval_count") < 2, "unresolved").when(F.col("uniform"), "uniform").otherwise("varying").alias("assessment"), F.when(F.col("uniform"), F.col("mode_step_ns") / 1e9).alias("interval"), F.lit("seconds").alias("unit"), "missing")


def _now():
    return F.lit(NOW).cast("timestamp")


def _rf(s, d):
    r = _raw(s, d)
    return radio.availability(radio.observations(r), r.where("object_id % 3 <> 0").select("object_id", "decoder").distinct(), _now(), 72.0)


def _answers(s, d):
    e = _table(s, d, "embeddings").where("embedding is not null")
    num = lambda x: x.cast("double")
    return e.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("event_id"), "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        F.array(F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")), F.concat(F.lit("c"), (F.col("vec_id") % 5).cast("string"))).alias("affected"),
        F.create_map(F.lit("agg_score_max"), num(F.col("vec_id") % 10)).alias("telemetry_features"),
        F.create_map(F.lit("nearest_tc_diff_sec"), num(F.col("vec_id") * 13 % 1000), F.lit("tc_count_5m"), num(F.col("vec_id") % 7)).alias("context_features"))


def _memories(s, d):
    """What operators have confirmed: everything of one label."""
    return _answers(s, d).where("label = 0").select(F.col("event_id").alias("memory_id"), F.col("vec_id").alias("ordinal"), "vector", "affected", "telemetry_features", "context_features")


def _candidates(s, d):
    return _answers(s, d).where("label is null or label <> 0")


def _micros(c):
    """What isn't negative rounded to six digits as SQL does, which rounds the double product: Spark rounds decimal digits, so halves may go another way."""
    x = F.col(c) * 1e6
    return (F.floor(x) + (x - F.floor(x) >= 0.5).cast("int")) / 1e6


def _scored(s, d):
    t = v.telemetry(s, d)
    return detect.score(t, detect.fit_std(t, VALIDATION), 3.0)


def _test_events(s, d):
    return labels.assigned(labels.events(v.label_rows(s, d)), VALIDATION, TEST).where("split = 'test'")


def _features(s, d):
    x = signature.window_features(_scored(s, d), _test_events(s, d), SELECTED)
    return x.select("event_id", "channel", *[F.round(c, 6).alias(c) for c in signature.PER_CHANNEL])


def _signatures(s, d, with_commands=True, features=None):
    c = v.commands(s, d)
    return signature.signatures(_scored(s, d), _test_events(s, d), c if with_commands else c.where("1 = 0"), SELECTED, features=features)


def _study(s, d, mode, with_commands=True, features=None):
    x = tables.written(_signatures(s, d, with_commands, features))
    # any sample of a window above the threshold: its largest score is
    alarm = x.select("event_id", (F.col("telemetry_features.agg_score_max") > 1.65).alias("alarm"))
    ev = _test_events(s, d).where("category in ('Anomaly', 'Rare Event')")
    cohort = ev.join(alarm, "event_id", "left").select("event_id", "category", "start_ns", F.coalesce("alarm", F.lit(False)).alias("alarm"))
    return memory.study(x, tables.written(cohort), mode=mode)


#: What a replay takes for a known pattern; the vectors of the table are far apart.
REPLAYED = 0.45


def _replay(s, d, mode):
    """The sequential study over the table of vectors, with categories, times and alarms by number."""
    a = _answers(s, d)
    cohort = a.select("event_id", F.when(F.col("vec_id") % 3 == 0, "Anomaly").otherwise("Rare Event").alias("category"), (F.col("vec_id") * 17 % 211).alias("start_ns"), (F.col("vec_id") % 5 != 0).alias("alarm"))
    return memory.study(a.drop("label", "vec_id"), cohort, REPLAYED, mode)


def _replay_sql(mode: str, body: str) -> str:
    """The same, one candidate after the other, with what was learned so far as a list."""
    asks = "alarm" if mode == "gated" else "true"
    return f"""
      WITH RECURSIVE emb AS ({_EMB}),
      cohort AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'Anomaly' ELSE 'Rare Event' END AS category, vec_id * 17 % 211 AS start_ns, vec_id % 5 <> 0 AS alarm FROM emb),
      asked AS (SELECT *, {asks} AS queried, row_number() OVER (ORDER BY start_ns, event_id) AS place FROM cohort),
      could AS (SELECT *, row_number() OVER (ORDER BY place) AS n FROM asked WHERE queried AND category = 'Rare Event'),
      cosines AS (
        SELECT a_id, b_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cos FROM (
          SELECT a_id, b_id, x / (greatest(abs(x), abs(y)) + 1e-6::DOUBLE) AS x, y / (greatest(abs(x), abs(y)) + 1e-6::DOUBLE) AS y FROM (
            SELECT a.vec_id AS a_id, b.vec_id AS b_id, unnest(a.vector) AS x, unnest(b.vector) AS y FROM asked a JOIN could b ON a.queried AND b.place < a.place)) GROUP BY a_id, b_id),
      sims AS (
        SELECT a.event_id, b.event_id AS memory_id, b.n AS b_n, b.place, CASE WHEN a.score > 3.5 AND (b.score < 2.5 OR a.score > 2 * b.score) THEN 0.0 ELSE least(greatest(
                 0.4 * greatest(cos, 0) + 0.2 * len(list_intersect(a.affected, b.affected))::DOUBLE / len(list_distinct(list_concat(a.affected, b.affected)))
                 + 0.2 * exp(-abs(ln(1 + a.near) - ln(1 + b.near))) + 0.2 * exp(-abs(a.cnt - b.cnt) / 5), 0), 1) END AS similarity
        FROM cosines JOIN asked a ON a.vec_id = a_id JOIN could b ON b.vec_id = b_id),
      alike AS (SELECT c.n AS a_n, s.b_n FROM sims s JOIN could c USING (event_id) WHERE similarity >= {REPLAYED}),
      step(n, learned) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT s.n + 1, CASE WHEN bool_or(list_contains(s.learned, k.b_n)) THEN s.learned ELSE list_append(s.learned, s.n + 1) END
        FROM step s LEFT JOIN alike k ON k.a_n = s.n + 1 WHERE s.n < (SELECT count(*) FROM could) GROUP BY s.n, s.learned),
      learned AS (SELECT unnest(arg_max(learned, n)) AS n FROM step),
      best AS (SELECT event_id, max(similarity) AS s, arg_max(memory_id, (similarity, -place)) AS other FROM sims WHERE b_n IN (SELECT n FROM learned) AND similarity > 0 GROUP BY event_id),
      decided AS (
        SELECT a.event_id, a.category, round(coalesce(best.s, 0.0), 6) AS best_similarity, other AS matched_id, coalesce(s >= {REPLAYED}, false) AS recognized,
               coalesce(c.n IN (SELECT n FROM learned), false) AS stored, a.alarm AND NOT (coalesce(s >= {REPLAYED}, false) AND {str(mode == "gated").lower()}) AS alarm_after
        FROM asked a LEFT JOIN best USING (event_id) LEFT JOIN could c USING (event_id))
      {body}"""


def _ablation(s, d):
    out, features = None, tables.written(signature.window_features(_scored(s, d), _test_events(s, d), SELECTED))
    for name, flag in (("without", False), ("with", True)):
        x = memory.study_summary(_study(s, d, "open", flag, features)).select(F.lit(name).alias("commands"), "events", "recognized", "stored")
        out = x if out is None else out.unionByName(x)
    return out


def _round_trip(s, d):
    path = f"{tables.shared_folder(s)}/telemetry"
    tables.write_telemetry(v.telemetry(s, d).select("channel", "ts_ns", F.col("value").cast("float").alias("value")), path)
    return tables.read_parquet(s, path).groupBy("channel").agg(F.count("*").alias("samples"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def _sessions(s, d):
    t = v.telemetry(s, d)
    parameters = detect.fit_std(t, VALIDATION)

    def transform(stream):
        x = stream.select(F.concat(F.lit("channel_"), (41 + F.col("user_id") % 6).cast("string")).alias("channel"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "value")
        return jobs.alarm_sessions(jobs.scored(x, parameters, 1.0), "90 minutes")

    x = jobs.replay(s, f"{d}/events.parquet", transform, tables.shared_folder(s))
    return x.select("channel", (F.unix_micros("start") * 1000).alias("start_ns"), (F.unix_micros("end") * 1000).alias("end_ns"), "alarms")


def _updates(s, d):
    return v.events(s, d).select(F.col("user_id").alias("object_id"), "ts_ns", (F.col("event_id") * 37 % 360 - 180.0).alias("lon"), (F.col("event_id") * 13 % 180 - 90.0).alias("lat"))


QUERIES = {
    "p1_orbit_derived": lambda s, d: orbit.derived(objects(s, d)).select("object_id", "period_min", "semi_major_km", "apogee_km", "perigee_km", "regime"),
    "a21_regime_counts": lambda s, d: orbit.counts(orbit.derived(objects(s, d)), "regime", ["LEO", "MEO", "GEO", "HEO", "OTHER"]),
    "f7_catalog_filter": lambda s, d: orbit.filtered(orbit.derived(objects(s, d)), regime="MEO").select("object_id", "name", "regime"),
    "o3_catalog_search": lambda s, d: orbit.search(objects(s, d), "widget").select("object_id", "name", "tier"),
    "o3_catalog_search_id": lambda s, d: orbit.search(objects(s, d), " P-17 ").select("object_id", "name", "tier"),
    "s17_catalog_dedup": lambda s, d: orbit.deduplicated(objects(s, d).withColumn("object_id", F.col("ordinal") % 97)).select("object_id", "name", "ordinal"),
    "a22_freshest_update": lambda s, d: orbit.freshest(v.events(s, d).select(F.col("user_id").alias("object_id"), "ts_ns")),
    "p5_sub_points": lambda s, d: (lambda x: x.select("object_id", *[F.round(c, 6).alias(k) for k, c in geo.sub_point("x", "y", "z", "jd").items()]))(_places(s, d)),
    "p10_view_angles": lambda s, d: _places(s, d).select("object_id", *[F.round(c, 6).alias(k) for k, c in geo.view(STATION, (F.col("object_id") * 7 % 160) - 80.0, (F.col("object_id") * 11 % 360) - 180.0, 400.0 + F.col("object_id") % 600).items()]),
    "p11_visible_objects": lambda s, d: _places(s, d).where(geo.view(STATION, (F.col("object_id") * 7 % 160) - 80.0, (F.col("object_id") * 11 % 360) - 180.0, 400.0 + F.col("object_id") % 600)["elevation_deg"] >= 5).select("object_id"),
    "o7_nearest_point": lambda s, d: orbit.nearest_point(_places(s, d).select("object_id", "x", "y", (F.col("z") > 0).alias("visible")), 6900.0, 100.0, 500.0).select("object_id"),
    "w10_dead_reckoning": lambda s, d: series.dead_reckoned(_updates(s, d)),
    "p4_sgp4_states": lambda s, d: orbit.states(orbit.propagate(objects(s, d).withColumn("at_ns", F.lit(EPOCH + 3600 * SECOND)))).select("object_id", "error", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("alt_km", 2).alias("alt_km"), F.round("speed_kms", 3).alias("speed_kms")),
    "p6_ground_track": lambda s, d: orbit.ground_track(objects(s, d), EPOCH).select("object_id", "minute", "part", "error", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("alt_km", 2).alias("alt_km")),
    "p12_next_passes": lambda s, d: orbit.next_passes(objects(s, d), STATION, EPOCH),
    "p12_grid_passes": lambda s, d: orbit.grid_passes(_elevations(s, d), EPOCH),
    "r1_rf_normalize": lambda s, d: radio.observations(_raw(s, d)).select("object_id", "observation_id", F.unix_micros("at").alias("at_us"), "station", "status"),
    "r2_rf_status": lambda s, d: _rf(s, d).select("object_id", "observations", "recent_observations", "transmitters", "decoders", "rf_status"),
    "r3_recent_rf_ids": lambda s, d: radio.recent_ids(radio.observations(_raw(s, d)), _now(), 24.0),
    "f8_recent_objects": lambda s, d: objects(s, d).join(radio.recent_ids(radio.observations(_raw(s, d)), _now(), 24.0), "object_id", "left_semi").select("object_id", "name"),
    "a28_type_profile": lambda s, d: profile.columns(_table(s, d, "labels")).select("column", "row_count", "null_count", "inferred_type", F.array_join("examples", "|").alias("examples"), "role"),
    "x11_timestamp_candidates": lambda s, d: (lambda x: profile.timestamp_candidates(profile.observations(x, "event_id"), profile.columns(x.drop("event_id"))).select("column", "representation", "by_name", "by_values"))(_as_text(s, d)),
    "x11_sampling_interval": lambda s, d: (lambda x: profile.sampling_interval(profile.timestamp_candidates(profile.observations(x, "event_id"), profile.columns(x.drop("event_id")))).select("column", "assessment", "unit", "intervals"))(_as_text(s, d).drop("ts")),
    "x12_header_roles": lambda s, d: _headers(s, d).select("header", F.array_join(text.roles("header"), ",").alias("roles"), text.names_time("header").alias("names_time"), text.names_value("header").alias("names_value")),
    "a30_telemetry_summary": lambda s, d: profile.telemetry_summary(_entries(s, d)).select("files", "total_rows", "least_rows", "most_rows", F.array_join("formats", ",").alias("formats"), "uniform_files", "varying_files", "unresolved_files", F.size("steps").alias("steps"), "files_with_missing", "comparison"),
    "a27_extension_counts": lambda s, d: profile.extension_counts(_table(s, d, "pages").select(F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))),
    "a29_sampling": lambda s, d: profile.sampling(series.intervals(v.telemetry(s, d))),
    "x8_source_kind": lambda s, d: _paths(s, d).select("p_partkey", text.source_kind("path").alias("kind")),
    "o1_natural_sort": lambda s, d: labels.natural_places(v.commands(s, d), "telecommand"),
    "x23_digests": lambda s, d: (lambda k: _table(s, d, "customer").select("c_custkey", k["sha256"].alias("sha256"), k["md5"].alias("md5")))(text.digests(F.col("c_name").cast("binary"))),
    "x16_channel_jaccard": lambda s, d: (lambda x: x.select("event_id", F.round(text.jaccard(F.col("channels"), F.array(F.lit("channel_9"), F.lit("channel_41"), F.lit("channel_42"))), 6).alias("jaccard")))(v.label_rows(s, d).groupBy("event_id").agg(F.collect_set("channel").alias("channels"))),
    "i7_class_sets": lambda s, d: labels.class_sets(labels.assigned(labels.events(v.label_rows(s, d)), VALIDATION, TEST)),
    "s11_telemetry_round_trip": _round_trip,
    "g1_channel_features": _features,
    "g2_affected_channels": lambda s, d: signature.affected_channels(signature.window_features(_scored(s, d), _test_events(s, d), SELECTED)).select("event_id", F.array_join("affected", ",").alias("affected")),
    "g3_command_context": lambda s, d: signature.command_context(labels.events(v.label_rows(s, d)), v.commands(s, d)).withColumn("nearest_tc_diff_sec", F.round("nearest_tc_diff_sec", 6)),
    "g4_signatures": lambda s, d: _signatures(s, d).select("event_id", "num_affected", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 3).alias("vector_sum")),
    "g8_similarity_pairs": lambda s, d: memory.similar(_candidates(s, d), _memories(s, d), 0.4).withColumn("similarity", _micros("similarity")),
    "g9_nearest_memory": lambda s, d: memory.nearest(_candidates(s, d), _memories(s, d), 0.3).select("event_id", "nearest_id", _micros("similarity").alias("similarity"), "status"),
    "g11_gated_learning": lambda s, d: _study(s, d, "gated"),
    "g12_recurrence_study": lambda s, d: _study(s, d, "open"),
    "g13_context_ablation": _ablation,
    "g11_replayed_learning": lambda s, d: _replay(s, d, "gated").select("event_id", "category", _micros("best_similarity").alias("best_similarity"), "matched_id", "recognized", "stored", "alarm_after"),
    "g12_replayed_recurrence": lambda s, d: _replay(s, d, "open").select("event_id", "category", _micros("best_similarity").alias("best_similarity"), "matched_id", "recognized", "stored", "alarm_after"),
    "a24_recurrence_summary": lambda s, d: memory.recurrence_summary(_replay(s, d, "open")),
    "o4_catalog_search": lambda s, d: orbit.search(objects(s, d), "Widget", 50, starts=False).select("object_id", "name", "tier"),
    "g14_alerts": lambda s, d: memory.alerts(memory.nearest(_candidates(s, d), _memories(s, d), 0.3).withColumn("category", F.when(F.length("event_id") % 2 == 0, "Anomaly").otherwise("Rare Event"))).select("event_id", "status", "severity"),
    "a23_study_summary": lambda s, d: memory.study_summary(_study(s, d, "gated")),
    "m4_isolation_forest": lambda s, d: (lambda t: forest.score(t, forest.fit(t, VALIDATION)).groupBy("channel").agg(F.count("*").alias("samples"), F.count_if("alarm").alias("alarms")))(v.telemetry(s, d)),
    "t_alarm_sessions": _sessions,
}

_OBJ = "SELECT p_partkey + 10000 AS object_id, p_name AS name, 'P-' || p_partkey AS alt_id, p_partkey AS ordinal, 0.9 + (p_partkey * 37 % 150) / 10.0 AS mean_motion, (p_partkey % 50) / 1000.0 AS eccentricity FROM part"
_DER = """
      SELECT object_id, name, 1440.0 / mm AS period, pow(398600.4418 / pow(mm * (2 * pi() / 86400), 2), 1.0 / 3) AS a, least(greatest(eccentricity, 0), 0.99) AS e,
             CASE WHEN mm < 1.5 THEN 'GEO' WHEN mm < 10 THEN 'MEO' ELSE 'LEO' END AS regime FROM (SELECT *, mean_motion::DOUBLE AS mm FROM obj)"""
_PLACES = "SELECT p_partkey + 10000 AS object_id, (6800.0 + p_partkey % 400)::DOUBLE AS x, ((p_partkey * 31 % 8000) - 4000.0)::DOUBLE AS y, ((p_partkey * 17 % 9000) - 4500.0)::DOUBLE AS z, 2460310.5::DOUBLE + (p_partkey % 100) / 10.0::DOUBLE AS jd FROM part"
_MOD = "(({0}) - 360 * floor(({0}) / 360))"
_GMST = "280.46061837::DOUBLE + 360.98564736629::DOUBLE * (jd - 2451545.0) + 0.000387933::DOUBLE * ((jd - 2451545.0) / 36525) ** 2 - ((jd - 2451545.0) / 36525) ** 3 / 38710000.0"
_E2 = "(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE))"
_ECEF = lambda la, lo, h: f"6378.137::DOUBLE / sqrt(1 - {_E2} * sin(radians({la})) ** 2) AS n, radians({la}) AS la, radians({lo}) AS lo, {h} AS h"
_VIEW = f"""
      SELECT object_id, sqrt(dx * dx + dy * dy + dz * dz) AS range_km, degrees(asin(least(greatest((cos(sla) * cos(slo) * dx + cos(sla) * sin(slo) * dy + sin(sla) * dz) / sqrt(dx * dx + dy * dy + dz * dz), -1), 1))) AS elevation_deg,
             degrees(atan2(-sin(slo) * dx + cos(slo) * dy, -sin(sla) * cos(slo) * dx - sin(sla) * sin(slo) * dy + cos(sla) * dz)) + 360 AS az
      FROM (SELECT t.object_id, s.la AS sla, s.lo AS slo, (t.n + t.h) * cos(t.la) * cos(t.lo) - (s.n + s.h) * cos(s.la) * cos(s.lo) AS dx, (t.n + t.h) * cos(t.la) * sin(t.lo) - (s.n + s.h) * cos(s.la) * sin(s.lo) AS dy,
                   (t.n * (1 - {_E2}) + t.h) * sin(t.la) - (s.n * (1 - {_E2}) + s.h) * sin(s.la) AS dz
            FROM (SELECT object_id, {_ECEF('((object_id * 7 % 160) - 80.0)::DOUBLE', '((object_id * 11 % 360) - 180.0)::DOUBLE', '(400.0 + object_id % 600)::DOUBLE')} FROM places) t, (SELECT {_ECEF('17.385::DOUBLE', '78.4867::DOUBLE', '0.545::DOUBLE')}) s)"""
_RAWSQL = "SELECT user_id + 10000 AS object_id, event_id AS ordinal, user_id % 4 <> 0 AS decoder, event_type AS status, date_trunc('second', ts) AS seen, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'GS' || (event_id % 11) END AS sname, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 40 + 1)::VARCHAR END AS snum FROM events"
_HOURS = f"date_diff('microsecond', seen, TIMESTAMP '{NOW}') BETWEEN 0 AND {{}} * 3600000000"
_EMB = """
      SELECT 'v' || vec_id AS event_id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vector, list_distinct(['c' || (vec_id % 3), 'c' || (vec_id % 5)]) AS affected, (vec_id % 10)::DOUBLE AS score,
             (vec_id * 13 % 1000)::DOUBLE AS near, (vec_id % 7)::DOUBLE AS cnt FROM embeddings WHERE embedding IS NOT NULL"""
_COS = """
      SELECT a_id, b_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cos FROM (
        SELECT a_id, b_id, x / (greatest(abs(x), abs(y)) + 1e-6::DOUBLE) AS x, y / (greatest(abs(x), abs(y)) + 1e-6::DOUBLE) AS y FROM (
          SELECT a.vec_id AS a_id, b.vec_id AS b_id, unnest(a.vector) AS x, unnest(b.vector) AS y FROM emb a JOIN emb b ON (a.label IS NULL OR a.label <> 0) AND b.label = 0)) GROUP BY a_id, b_id"""
_SIM = """
      SELECT a.event_id, b.event_id AS memory_id, b.vec_id AS ordinal, CASE WHEN a.score > 3.5 AND (b.score < 2.5 OR a.score > 2 * b.score) THEN 0.0 ELSE least(greatest(
               0.4 * greatest(cos, 0) + 0.2 * len(list_intersect(a.affected, b.affected))::DOUBLE / len(list_distinct(list_concat(a.affected, b.affected)))
               + 0.2 * exp(-abs(ln(1 + a.near) - ln(1 + b.near))) + 0.2 * exp(-abs(a.cnt - b.cnt) / 5), 0), 1) END AS similarity
      FROM cosines JOIN emb a ON a.vec_id = a_id JOIN emb b ON b.vec_id = b_id"""
_NEAREST = "SELECT event_id, arg_max(memory_id, (similarity, -ordinal)) AS nearest_id, max(similarity) AS similarity, CASE WHEN max(similarity) >= 0.3 THEN 'KNOWN' ELSE 'UNKNOWN' END AS status FROM sims GROUP BY event_id"
_TESTEV = "SELECT * FROM assigned WHERE split = 'test'"
_WIN = """
      SELECT e.event_id, s.channel, s.ts_ns, s.value, s.score FROM tev e JOIN placed s ON s.ts_ns BETWEEN e.start_ns AND e.end_ns
      UNION ALL
      SELECT b.event_id, s.channel, s.ts_ns, s.value, s.score
      FROM (SELECT e.event_id, c.channel, (SELECT count(*) FROM placed p WHERE p.channel = c.channel AND p.ts_ns < e.start_ns) AS i
            FROM tev e, (SELECT DISTINCT channel FROM placed) c
            WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.channel = c.channel AND p.ts_ns BETWEEN e.start_ns AND e.end_ns)) b
      JOIN placed s ON s.channel = b.channel AND s.n BETWEEN b.i - 5 AND b.i + 4"""
_PLACED = "SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_ns) - 1 AS n FROM scored"
_FEAT = "SELECT event_id, channel, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS mag, arg_max(value, ts_ns) - arg_min(value, ts_ns) AS diff, max(score) AS score_max, avg(score) AS score_mean, var_pop(score) AS score_var FROM win GROUP BY event_id, channel"
_TYPE = "CASE WHEN t IS NULL THEN 'null' WHEN lower(t) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(t, '^[+-]?\\d+$') THEN 'integer' WHEN regexp_matches(t, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'float' ELSE 'string' END"
_CTX = "SELECT e.event_id, any_value(e.start_ns) AS start_ns, max(c.ts_ns) AS last_ns, " + ", ".join(f"count(CASE WHEN c.ts_ns >= e.start_ns - {n}000000000 THEN 1 END) AS tc_count_{k}" for k, n in (("5m", 300), ("30m", 1800), ("2h", 7200), ("24h", 86400))) + ", " + ", ".join(f"count(CASE WHEN c.priority = {p} AND c.ts_ns >= e.start_ns - 86400000000000 THEN 1 END) AS tc_p{p}_count" for p in range(4)) + " FROM ev e LEFT JOIN commands c ON c.ts_ns <= e.start_ns GROUP BY e.event_id"

_TOKENS, _HAS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))", "list_has_any({}, {})"
_ROLE = "CASE " + " ".join(f"WHEN list_has_any(list_distinct(regexp_extract_all(lower({{0}}), '[a-z0-9]+')), {list(w)}) THEN '{k}'" for k, w in text.ROLES.items()) + " END"

ORACLES = {
    "p1_orbit_derived": sql("SELECT object_id, round(period, 2) AS period_min, round(a, 2) AS semi_major_km, round(greatest(a * (1 + e) - 6378.137, 0), 2) AS apogee_km, round(greatest(a * (1 - e) - 6378.137, 0), 2) AS perigee_km, regime FROM der", obj=_OBJ, der=_DER),
    "a21_regime_counts": sql("SELECT k.regime, count(der.object_id) AS n FROM (VALUES ('LEO'), ('MEO'), ('GEO'), ('HEO'), ('OTHER')) k(regime) LEFT JOIN der ON der.regime = k.regime GROUP BY k.regime", obj=_OBJ, der=_DER),
    "f7_catalog_filter": sql("SELECT object_id, name, regime FROM der WHERE regime = 'MEO'", obj=_OBJ, der=_DER),
    "o3_catalog_search": sql("SELECT object_id, name, CASE WHEN lower(name) = 'widget' THEN 2 WHEN starts_with(lower(name), 'widget') THEN 3 ELSE 4 END AS tier FROM obj WHERE contains(lower(name), 'widget') ORDER BY tier, ordinal LIMIT 100", obj=_OBJ),
    "o4_catalog_search": sql("SELECT object_id, name, CASE WHEN lower(name) = 'widget' THEN 2 ELSE 4 END AS tier FROM obj WHERE contains(lower(name), 'widget') ORDER BY tier, ordinal LIMIT 50", obj=_OBJ),
    "g11_replayed_learning": _replay_sql("gated", "SELECT event_id, category, best_similarity, matched_id, recognized, stored, alarm_after FROM decided"),
    "g12_replayed_recurrence": _replay_sql("open", "SELECT event_id, category, best_similarity, matched_id, recognized, stored, alarm_after FROM decided"),
    "a24_recurrence_summary": _replay_sql("open", "SELECT count(*) AS windows, count(*) FILTER (NOT recognized) AS review_required, count(*) FILTER (recognized) AS recognized, round(count(*) FILTER (recognized) * 100.0::DOUBLE / count(*), 6) AS recognition_rate_pct FROM decided WHERE category = 'Rare Event'"),
    "o3_catalog_search_id": sql("SELECT object_id, name, CASE WHEN lower(alt_id) = 'p-17' THEN 1 ELSE 4 END AS tier FROM obj WHERE lower(alt_id) = 'p-17' OR contains(lower(name), 'p-17')", obj=_OBJ),
    "s17_catalog_dedup": sql("SELECT ordinal % 97 AS object_id, name, ordinal FROM obj WHERE ordinal % 97 > 0 QUALIFY row_number() OVER (PARTITION BY ordinal % 97 ORDER BY ordinal DESC) = 1", obj=_OBJ),
    "a22_freshest_update": "SELECT user_id AS object_id, max(epoch_us(ts)) * 1000 AS freshest_ns FROM events GROUP BY user_id",
    "p5_sub_points": sql(f"SELECT object_id, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round({_MOD.format('lon + 180')} - 180, 6) AS lon, round(sqrt(x * x + y * y + z * z) - 6378.137::DOUBLE, 6) AS alt_km FROM (SELECT *, degrees(atan2(y, x)) - {_MOD.format(_GMST)} AS lon FROM places)", places=_PLACES),
    "p10_view_angles": sql(f"SELECT object_id, round(range_km, 6) AS range_km, round(elevation_deg, 6) AS elevation_deg, round({_MOD.format('az')}, 6) AS azimuth_deg FROM view_of", places=_PLACES, view_of=_VIEW),
    "p11_visible_objects": sql("SELECT object_id FROM view_of WHERE elevation_deg >= 5", places=_PLACES, view_of=_VIEW),
    "o7_nearest_point": sql("SELECT object_id FROM places WHERE z > 0 AND sqrt((x - 6900) ** 2 + (y - 100) ** 2) <= 500 ORDER BY sqrt((x - 6900) ** 2 + (y - 100) ** 2), object_id LIMIT 1", places=_PLACES),
    "w10_dead_reckoning": f"SELECT object_id, ts_ns, {_MOD.format('lon + (' + _MOD.format('nlon - lon + 540') + ' - 180) / 2 + 540')} - 180 AS lon, (lat + nlat) / 2 AS lat FROM (SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM (SELECT user_id AS object_id, epoch_us(ts) * 1000 AS ts_ns, (event_id * 37 % 360 - 180)::DOUBLE AS lon, (event_id * 13 % 180 - 90)::DOUBLE AS lat FROM events) WINDOW w AS (PARTITION BY object_id ORDER BY ts_ns)) WHERE nlon IS NOT NULL",
    "p12_grid_passes": f"""
        WITH g AS (
          SELECT p_partkey + 10000 AS object_id, {EPOCH} + m * 60000000000 AS at_ns,
                 CASE WHEN p_partkey % 11 = 0 THEN -10.0 WHEN p_partkey % 7 = 0 AND m > 100 THEN 20.0 WHEN (m * 13 + p_partkey) % 97 = 0 THEN NULL ELSE ((m + p_partkey * 17) % 90) - 70.0 END::DOUBLE AS el
          FROM part, range(240) r(m)),
        a AS (SELECT object_id, min(at_ns) FILTER (el >= 5) AS aos FROM g GROUP BY object_id),
        e AS (SELECT a.object_id, any_value(aos) AS aos, min(at_ns) FILTER (at_ns > aos AND NOT coalesce(el >= 5, false)) AS los FROM g JOIN a USING (object_id) GROUP BY a.object_id),
        t AS (SELECT e.object_id, any_value(aos) AS aos, any_value(los) AS los, max(el) FILTER (at_ns >= aos AND at_ns < los) AS top FROM e JOIN g USING (object_id) GROUP BY e.object_id)
        SELECT object_id, CASE WHEN los IS NULL THEN {EPOCH + 135 * 60 * SECOND} ELSE aos END AS aos_ns, coalesce(los, {EPOCH + 135 * 60 * SECOND + 660 * SECOND}) AS los_ns,
               CASE WHEN los IS NULL THEN 48.5 ELSE round(top, 2) END AS max_elevation_deg, CASE WHEN los IS NULL THEN 660 ELSE (los - aos) // 1000000000 END AS duration_s,
               CASE WHEN los IS NULL THEN 'ESTIMATED_ORBITAL_PASS' ELSE 'PASS_PREDICTED' END AS status FROM t""",
    "r1_rf_normalize": sql("SELECT object_id, ordinal::VARCHAR AS observation_id, epoch_us(seen) AS at_us, CASE WHEN sname IS NOT NULL AND snum IS NOT NULL THEN sname || ' (#' || snum || ')' WHEN sname IS NOT NULL THEN sname WHEN snum IS NOT NULL THEN 'Station #' || snum ELSE 'Unknown station' END AS station, status FROM raw", raw=_RAWSQL),
    "r2_rf_status": sql("""
        SELECT object_id, observations, recent_observations, transmitters, decoders, CASE WHEN transmitters = 0 THEN 'NO TRANSMITTER' WHEN recent_observations = 0 THEN 'NO RECENT DATA' WHEN decoders = 0 THEN 'NO DECODER' ELSE 'AVAILABLE' END AS rf_status
        FROM (SELECT object_id, count(*) AS observations, count(*) FILTER (""" + _HOURS.format(72) + """) AS recent_observations, CASE WHEN object_id % 3 <> 0 THEN count(DISTINCT decoder) ELSE 0 END AS transmitters,
                     CASE WHEN object_id % 3 <> 0 THEN count(DISTINCT CASE WHEN decoder THEN 1 END) ELSE 0 END AS decoders FROM raw GROUP BY object_id)""", raw=_RAWSQL),
    "r3_recent_rf_ids": sql(f"SELECT DISTINCT object_id FROM raw WHERE {_HOURS.format(24)}", raw=_RAWSQL),
    "f8_recent_objects": sql(f"SELECT object_id, name FROM obj WHERE object_id IN (SELECT object_id FROM raw WHERE {_HOURS.format(24)})", raw=_RAWSQL, obj=_OBJ),
    "a28_type_profile": f"""
        SELECT "column", count(*) AS row_count, count(*) FILTER (t IS NULL) AS null_count,
               CASE WHEN count(DISTINCT k) FILTER (k <> 'null') = 0 THEN 'null' WHEN count(DISTINCT k) FILTER (k <> 'null') = 1 THEN any_value(k) FILTER (k <> 'null') WHEN bool_and(k IN ('null', 'integer', 'float')) THEN 'float' ELSE 'string' END AS inferred_type,
               array_to_string(list_slice(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), 1, 5), '|') AS examples, any_value({_ROLE.format('"column"')}) AS role
        FROM (SELECT *, {_TYPE} AS k FROM (SELECT "column", nullif(trim(val), '') AS t FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM labels) ON COLUMNS(*) INTO NAME "column" VALUE val))) GROUP BY "column\"""",
    "x11_timestamp_candidates": f"""
        SELECT "column", CASE WHEN by_values THEN 'ISO-8601-like string' WHEN "column" = 'event_time' THEN 'integer' ELSE 'string' END AS representation, by_name, by_values
        FROM (SELECT "column", any_value({_HAS.format(_TOKENS.format('"column"'), list(text.TIMES))}) AS by_name, bool_and(regexp_matches(val, '{text.ISO}')) AS by_values
              FROM (SELECT event_id, 'ts' AS "column", strftime(ts, '%Y-%m-%d %H:%M:%S') AS val FROM events UNION ALL SELECT event_id, 'event_type', event_type FROM events UNION ALL SELECT event_id, 'event_time', (epoch_us(ts) // 1000000)::VARCHAR FROM events)
              WHERE trim(val) <> '' GROUP BY "column") WHERE by_name OR by_values""",
    "x11_sampling_interval": """
        SELECT 'event_time' AS "column", CASE WHEN count(*) < 2 THEN 'unresolved' WHEN max(d) - min(d) <= 1e-9 * max(d) THEN 'uniform' ELSE 'varying' END AS assessment, 'raw timestamp units' AS unit, count(*)::INT AS intervals
        FROM (SELECT t - lag(t) OVER (ORDER BY event_id) AS d FROM (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events ORDER BY event_id LIMIT 512)) WHERE d > 0""",
    "x12_header_roles": f"""
        SELECT header, array_to_string(list_filter([{', '.join(f"CASE WHEN {_HAS.format(_TOKENS.format("header"), list(w))} THEN '{k}' END" for k, w in text.ROLES.items())}], lambda x: x IS NOT NULL), ',') AS roles, {_HAS.format(_TOKENS.format('header'), list(text.TIMES))} AS names_time, {_HAS.format(_TOKENS.format('header'), list(text.VALUES))} AS names_value
        FROM (SELECT list_extract({list(_HEADERS)}, (n_nationkey % {len(_HEADERS)} + 1)::INT) || CASE WHEN n_nationkey >= {len(_HEADERS)} THEN '-' || n_nationkey ELSE '' END AS header FROM nation)""",
    "a30_telemetry_summary": sql("""
        SELECT count(*) AS files, sum(n)::BIGINT AS total_rows, min(n) AS least_rows, max(n) AS most_rows, '.parquet' AS formats, count(*) FILTER (kind = 'uniform') AS uniform_files, count(*) FILTER (kind = 'varying') AS varying_files, count(*) FILTER (kind = 'unresolved') AS unresolved_files,
               count(DISTINCT CASE WHEN kind = 'uniform' THEN step END)::INT AS steps, count(*) FILTER (missing) AS files_with_missing,
               CASE WHEN bool_or(kind = 'varying') THEN 'varying within a file' WHEN count(DISTINCT CASE WHEN kind = 'uniform' THEN step END) > 1 THEN 'varying between files' WHEN bool_and(kind = 'uniform') THEN 'uniform' WHEN bool_or(kind = 'uniform') THEN 'partly measured' ELSE 'unresolved' END AS comparison
        FROM (SELECT channel, count(*) AS n, bool_or(value IS NULL) AS missing, min(step) AS step, CASE WHEN count(step) < 2 THEN 'unresolved' WHEN min(step) = max(step) THEN 'uniform' ELSE 'varying' END AS kind
              FROM (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY channel ORDER BY ts_ns) AS step FROM telemetry) GROUP BY channel)""", "telemetry"),
    "a27_extension_counts": "SELECT CASE WHEN ext = '' THEN '<none>' ELSE ext END AS extension, CASE WHEN top = '' THEN '<root>' ELSE top END AS top_level, count(*) AS file_count FROM (SELECT lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS ext, regexp_extract(path, '^([^/]+)/', 1) AS top FROM (SELECT regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages)) GROUP BY ALL",
    "a29_sampling": sql("SELECT count(*) AS channels, count(*) FILTER (lo = hi) AS uniform_channels, min(lo) AS min_step_ns, max(hi) AS max_step_ns, min(lo) = max(hi) AS all_equal FROM (SELECT channel, min(step) AS lo, max(step) AS hi FROM (SELECT channel, ts_ns - lag(ts_ns) OVER (PARTITION BY channel ORDER BY ts_ns) AS step FROM telemetry) GROUP BY channel)", "telemetry"),
    "x8_source_kind": f"""
        SELECT p_partkey, CASE WHEN {_HAS.format('every', list(text.LABELS))} THEN 'labels' WHEN {_HAS.format('every', list(text.COMMANDS))} THEN 'telecommands'
                               WHEN {_HAS.format('above', list(text.TELEMETRY))} OR {_HAS.format('list_filter(every, lambda x: NOT list_contains(own, x))', list(text.TELEMETRY))} THEN 'telemetry'
                               WHEN suffix IN {text.TABLES} THEN 'metadata' WHEN {_HAS.format('every', list(text.TELEMETRY))} AND suffix IN {text.ARRAYS} THEN 'telemetry' ELSE 'unclassified' END AS kind
        FROM (SELECT p_partkey, {_TOKENS.format('path')} AS every, {_TOKENS.format("regexp_replace(member, '/?[^/]*$', '')")} AS above, {_TOKENS.format("regexp_replace(name, '(.)[.][^.]+$', chr(92) || '1')")} AS own, lower(regexp_extract(name, '.([.][^.]+)$', 1)) AS suffix
              FROM (SELECT *, list_extract(string_split(member, '/'), -1) AS name
                    FROM (SELECT p_partkey, path, list_extract(string_split(path, '!'), -1) AS member
                          FROM (SELECT p_partkey, list_extract({list(_DIRS)}, (p_partkey % {len(_DIRS)} + 1)::INT) || '/' || list_extract({list(_NAMES)}, ((p_partkey // {len(_DIRS)}) % {len(_NAMES)} + 1)::INT) AS path FROM part))))""",
    "o1_natural_sort": sql("SELECT telecommand, row_number() OVER (ORDER BY regexp_extract(telecommand, '(\\d+)$', 1)::BIGINT, telecommand) AS place FROM (SELECT DISTINCT telecommand FROM commands)", "commands"),
    "x23_digests": "SELECT c_custkey, sha256(c_name) AS sha256, md5(c_name) AS md5 FROM customer",
    "x16_channel_jaccard": sql("SELECT event_id, round(len(list_intersect(c, k))::DOUBLE / len(list_distinct(list_concat(c, k))), 6) AS jaccard FROM (SELECT event_id, list(DISTINCT channel) AS c, ['channel_9', 'channel_41', 'channel_42'] AS k FROM label_rows GROUP BY event_id)", "label_rows"),
    "i7_class_sets": sql("SELECT class, CASE WHEN bool_or(split = 'test') AND bool_or(split <> 'test') THEN 'both' WHEN bool_or(split = 'test') THEN 'test only' ELSE 'before test' END AS seen FROM assigned GROUP BY class", "assigned"),
    "s11_telemetry_round_trip": sql("SELECT channel, count(*) AS samples, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM telemetry GROUP BY channel", "telemetry"),
    "g1_channel_features": sql("SELECT event_id, channel, " + ", ".join(f"round({c}, 6) AS {c}" for c in signature.PER_CHANNEL) + " FROM feat", "assigned", "scored", tev=_TESTEV, placed=_PLACED, win=_WIN, feat=_FEAT),
    "g2_affected_channels": sql("SELECT event_id, coalesce(string_agg(CASE WHEN score_max > 3 OR mag > 0.05 THEN channel END, ',' ORDER BY channel), '') AS affected FROM feat GROUP BY event_id", "assigned", "scored", tev=_TESTEV, placed=_PLACED, win=_WIN, feat=_FEAT),
    "g4_signatures": sql(f"""
        SELECT t.event_id, coalesce(f.hit, 0)::INT AS num_affected, {9 * len(SELECTED) + 2 + len(signature.CONTEXT)} AS dimensions,
               round(coalesce(f.total, 0) + coalesce(f.top, 0) + (t.end_ns - t.start_ns) / 1e9 + ln(1 + greatest(CASE WHEN last_ns IS NULL THEN 86400.0 ELSE (t.start_ns - last_ns) / 1e9 END, 0)) / 10 + ({' + '.join(signature.CONTEXT[1:])}) / 10.0, 3) AS vector_sum
        FROM tev t JOIN ctx c ON t.event_id = c.event_id
        LEFT JOIN (SELECT event_id, count(*) FILTER (score_max > 3 OR mag > 0.05) AS hit, max(score_max) AS top, sum({' + '.join(f'coalesce({c}, 0)' for c in signature.PER_CHANNEL)}) AS total FROM feat GROUP BY event_id) f ON t.event_id = f.event_id""",
        "assigned", "scored", "commands", tev=_TESTEV, placed=_PLACED, win=_WIN, feat=_FEAT, ctx=_CTX),
    "g3_command_context": sql("SELECT event_id, CASE WHEN last_ns IS NULL THEN 86400.0 ELSE round((start_ns - last_ns) / 1e9, 6) END AS nearest_tc_diff_sec, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in signature.CONTEXT[1:]) + " FROM ctx", "ev", "commands", ctx=_CTX),
    "g8_similarity_pairs": sql("SELECT event_id, memory_id, round(similarity, 6) AS similarity FROM sims WHERE similarity >= 0.4", emb=_EMB, cosines=_COS, sims=_SIM),
    "g9_nearest_memory": sql("SELECT event_id, nearest_id, round(similarity, 6) AS similarity, status FROM nearest", emb=_EMB, cosines=_COS, sims=_SIM, nearest=_NEAREST),
    "g14_alerts": sql("SELECT event_id, status, CASE WHEN status = 'KNOWN' THEN 'INFO' WHEN length(event_id) % 2 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM nearest", emb=_EMB, cosines=_COS, sims=_SIM, nearest=_NEAREST),
    "t_alarm_sessions": sql("""
        SELECT channel, min(us) * 1000 AS start_ns, (max(us) + 5400000000) * 1000 AS end_ns, count(*) AS alarms FROM (
          SELECT *, sum(CASE WHEN us - before <= 5400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
          FROM (SELECT channel, ts_ns // 1000 AS us, lag(ts_ns // 1000) OVER (PARTITION BY channel ORDER BY ts_ns) AS before FROM scored WHERE score > 1.0))
        GROUP BY channel, g HAVING max(us) + 5400000000 <= (SELECT max(ts_ns) // 1000000 * 1000 - 600000000 FROM scored WHERE score > 1.0)""", "scored"),
}
