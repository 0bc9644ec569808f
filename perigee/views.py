"""What a service would show, as frames: catalog, summary, states, object detail, sources and timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions import geo
from perigee.operators import memory, orbit

REGIMES = ("LEO", "MEO", "GEO", "HEO", "OTHER")
STATE = ("object_id", "name", "lat", "lon", "alt_km", "speed_kms", "regime", "recent_rf")


def catalog(objects: DataFrame, query: str | None = None, recent: DataFrame | None = None, most: int = 100, **filters) -> DataFrame:
    """Catalog rows by filters, those with recent radio data only where given, ranked where searched."""
    x = orbit.filtered(orbit.derived(objects), **filters)
    if recent is not None:
        x = x.join(recent.select("object_id").distinct(), "object_id", "left_semi")
    return orbit.search(x, query, most) if query else x.orderBy("ordinal").limit(most)


def summary(objects: DataFrame, recent: DataFrame) -> DataFrame:
    """One row: objects, those with recent radio data, freshest epoch and counts by regime, 0 where none."""
    x = orbit.derived(objects).join(recent.select("object_id").distinct().withColumn("r", F.lit(True)), "object_id", "left")
    by = [F.count_if(F.col("regime") == r).alias(f"regime_{r.lower()}") for r in REGIMES]
    return x.agg(F.count("*").alias("objects"), F.count("r").alias("with_recent_rf"), F.max("epoch_ns").alias("freshest_epoch_ns"), *by)


def states(objects: DataFrame, now_ns: int, recent: DataFrame) -> DataFrame:
    """The compact state of every object that can be propagated."""
    x = orbit.states(orbit.propagate(objects.withColumn("at_ns", F.lit(now_ns)))).where("error = 0").withColumn("regime", geo.regime("mean_motion"))
    return x.join(recent.select("object_id").distinct().withColumn("recent_rf", F.lit(True)), "object_id", "left").fillna(False, ["recent_rf"]).select(*STATE)


def detail(objects: DataFrame, object_id: int, station: tuple[float, float, float], now_ns: int, availability: DataFrame) -> DataFrame:
    """One object: orbit, age of its elements, next pass, path and radio availability."""
    one = objects.where(F.col("object_id") == object_id)
    path = orbit.ground_track(one, now_ns).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("minute", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")))).alias("path"))
    x = orbit.derived(one).withColumn("age_hours", geo.age_hours("epoch_ns", F.lit(now_ns)))
    return x.join(orbit.next_passes(one, station, now_ns), "object_id", "left").join(path, "object_id", "left").join(availability, "object_id", "left")


def source_matrix(sources: DataFrame, now: Column, stale_hours: float = 24.0) -> DataFrame:
    """Sources ``name, rows, refreshed``: LIVE while fresh, CACHED when older, UNAVAILABLE without rows; age -1 if never."""
    age = (F.unix_micros(now) - F.unix_micros("refreshed")) / 3.6e9
    state = F.when(F.coalesce("rows", F.lit(0)) == 0, "UNAVAILABLE").when(age <= stale_hours, "LIVE").otherwise("CACHED")
    return sources.withColumn("age_hours", F.coalesce(age, F.lit(-1.0))).withColumn("state", state)


def assets(spark: SparkSession, present: dict[str, bool]) -> DataFrame:
    """Research assets and whether each is there."""
    return spark.createDataFrame([(k, "AVAILABLE" if v else "UNAVAILABLE") for k, v in sorted(present.items())], "asset string, state string")


def timeline(spark: SparkSession, memories: DataFrame, active: DataFrame) -> DataFrame:
    """A nominal row, what is remembered in order, and the active event."""
    kind = "place int, ordinal long, kind string, label string"
    first = spark.createDataFrame([(0, 0, "NOMINAL", "start")], kind)
    kept = memory.listed(memories, None).select(F.lit(1).alias("place"), F.col("ordinal").cast("long").alias("ordinal"), F.lit("MEMORY").alias("kind"), "label")
    now = active.select(F.lit(2).alias("place"), F.lit(0).cast("long").alias("ordinal"), F.lit("ACTIVE").alias("kind"), F.col("severity").alias("label"))
    return first.unionByName(kept).unionByName(now).orderBy("place", "ordinal")


def feedback(memories: DataFrame, event: DataFrame, label: str, ordinal: int) -> DataFrame:
    """Memories with an operator's verdict on an event added."""
    new = event.withColumn("memory_id", F.concat_ws("_", F.lit("mem"), F.col("event_id"), F.lit(ordinal))).withColumn("label", F.lit(label)).withColumn("ordinal", F.lit(ordinal).cast("long"))
    return memory.stored(memories, new.select(*memories.columns))


def freshness(age_hours: Column) -> Column:
    """Age in words of a short form: minutes, hours or days; unknown if negative or missing."""
    return (F.when(age_hours.isNull() | (age_hours < 0), "unknown").when(age_hours < 1, F.concat(F.floor(age_hours * 60).cast("string"), F.lit(" min")))
            .when(age_hours < 48, F.concat(F.floor(age_hours).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(age_hours / 24).cast("string"), F.lit(" d"))))


def place(lat: Column, lon: Column) -> Column:
    """Latitude and longitude with hemispheres, two decimals."""
    return F.concat(F.format_number(F.abs(lat), 2), F.when(lat < 0, "S").otherwise("N"), F.lit(" "), F.format_number(F.abs(lon), 2), F.when(lon < 0, "W").otherwise("E"))


def mission_summary(spark: SparkSession, name: str, scenario: str | None, category: str | None, channels: list[str], memories: DataFrame) -> DataFrame:
    """One row on the mission that is shown: its scenario, channels and how many patterns are remembered."""
    one = [(name, category or "Nominal", channels, len(channels), scenario, "ACTIVE")]
    x = spark.createDataFrame(one, "mission string, operational_state string, channels array<string>, channel_count int, scenario string, detector_state string")
    return x.join(memories.agg(F.count("*").alias("stored_patterns")), F.lit(True))  # single rows


def fleet(spark: SparkSession, authorized: list[tuple[str, str]]) -> DataFrame:
    """Spacecraft ``spacecraft_id, name`` whose telemetry may be shown, and whether there are any."""
    rows = [(i, n, "AUTHORIZED") for i, n in authorized] or [(None, None, "NO AUTHORIZED FLEET")]
    return spark.createDataFrame(rows, "spacecraft_id string, name string, state string")


def spacecraft(spark: SparkSession, spacecraft_id: str, name: str, channels: list[str], state: str = "HISTORICAL") -> DataFrame:
    """The parameters of one spacecraft, a row a channel; a live stream is never claimed."""
    return spark.createDataFrame([(spacecraft_id, name, state, c) for c in channels], "spacecraft_id string, name string, stream_state string, parameter string")


def research(spark: SparkSession, ev: DataFrame, telemetry: DataFrame, memories: DataFrame) -> DataFrame:
    """One row on the research data: labelled events, channels and remembered patterns."""
    a = ev.agg(F.count_distinct("event_id").alias("labelled_events"))
    return a.join(telemetry.agg(F.count_distinct("channel").alias("channels")), F.lit(True)).join(memories.agg(F.count("*").alias("stored_patterns")), F.lit(True))


def health(spark: SparkSession) -> DataFrame:
    """One row: that the session answers, and the version it runs."""
    return spark.createDataFrame([("ok", spark.version)], "status string, spark_version string")
