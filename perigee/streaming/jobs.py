"""Streams: scoring, alarm sessions, the catalog snapshot and the sequential memory."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from perigee.functions.clock import SECOND, timestamp
from perigee.operators import detect, memory, orbit
from perigee.sources.tables import shared_folder, written

LOG = logging.getLogger(__name__)

DECISIONS = "mission string, event_id string, status string, similarity double, nearest_id string"


def scored(stream: DataFrame, parameters: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Samples scored as they arrive; parameters are one row per channel."""
    return detect.score(stream, parameters, threshold)


def alarm_sessions(scores: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of alarms per channel; samples later than the watermark are dropped."""
    x = scores.where("alarm").withColumn("at", timestamp("ts_ns")).withWatermark("at", late)
    s = x.groupBy("channel", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("alarms"), F.max("score").alias("score_max"))
    return s.select("channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "alarms", "score_max")


def windowed_rates(stream: DataFrame, length: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Samples and alarms per channel in sliding windows."""
    x = stream.withColumn("at", timestamp("ts_ns")).withWatermark("at", late)
    g = x.groupBy("channel", F.window("at", length, slide).alias("w")).agg(F.count("*").alias("samples"), F.count_if("alarm").alias("alarms"))
    return g.select("channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "alarms")


#: Snapshots that are kept before a folder is used again, and how old one may be.
SNAPSHOTS, SNAPSHOT_SECONDS = 8, 3.0


def snapshot_writer(objects: DataFrame, view: str = "object_states", folder: str | None = None):
    """For ``foreachBatch`` on a rate stream: states of all objects at the batch's last tick, as a view.

    A snapshot is written once and read by all who look at the view; ``at_ns`` is its time.
    """
    folder = folder or shared_folder(objects.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if now is not None:
            states = orbit.states(orbit.propagate(objects.withColumn("at_ns", F.lit(now * 1000))))
            path = f"{folder}/{number % SNAPSHOTS}"
            states.write.mode("overwrite").parquet(path)
            objects.sparkSession.read.schema(states.schema).parquet(path).createOrReplaceTempView(view)

    return write


def is_fresh(snapshot: DataFrame, now_ns: int, seconds: float = SNAPSHOT_SECONDS) -> bool:
    """Whether a snapshot has rows and is at most so old."""
    at = snapshot.agg(F.max("at_ns")).first()[0]
    return at is not None and 0 <= now_ns - at <= seconds * SECOND


def start_snapshot(spark: SparkSession, objects: DataFrame, checkpoint: str, every: str = "3 seconds"):
    """The running query that refreshes the snapshot."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(snapshot_writer(objects)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


#: Time between two loads of the catalog.
REFRESH = "7200 seconds"


def start_refresh(spark: SparkSession, load: Callable[[], DataFrame], checkpoint: str, view: str = "catalog", every: str = REFRESH):
    """The running query that loads the catalog again and again; a load that fails leaves the last one in place."""
    def refresh(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            try:
                fresh = written(load())
            except (OSError, ValueError, PySparkException, Py4JError) as e:  # the old catalog serves on, as after any failed fetch
                LOG.warning("catalog not refreshed: %s", e)
                return
            fresh.createOrReplaceTempView(view)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def object_ticks(ticks: DataFrame, objects: DataFrame, ids: list[int]) -> DataFrame:
    """States of the named objects at every tick of a rate stream."""
    some = objects.where(F.col("object_id").isin(list(ids)))  # as few as were named
    x = ticks.select((F.unix_micros("timestamp") * 1000).alias("at_ns")).join(F.broadcast(some), F.lit(True))
    return orbit.states(orbit.propagate(x))


#: One mission's memory, a list of each column.
MEMORY = "id array<string>, at array<long>, vector array<array<double>>, affected array<array<string>>, score array<double>, near array<double>, count array<double>"
_COLUMNS = ("id", "at", "vector", "affected", "score", "near", "count")


def memory_stream(events: DataFrame, threshold: float = 0.8, late: str = "1 hour", keep: int | None = None) -> DataFrame:
    """Decisions on signatures with ``mission, at`` and ``category``, with one memory per mission.

    Similarity is that of the batch operators, guard, channels and command context included. State is kept per
    key by Spark and survives restarts; inside a micro-batch events are taken in order of time and id. An
    unknown rare event is learned, a known pattern is named, the earliest of equals. ``keep`` bounds the state:
    patterns older than that many nanoseconds are forgotten. Events later than the watermark go.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(_COLUMNS, map(list, state.get))) if state.exists else {c: [] for c in _COLUMNS}
        rows = pd.concat(list(frames)).sort_values(["at_ns", "id"])
        out = []
        for r in rows.itertuples():
            if keep is not None and held["at"] and held["at"][0] < r.at_ns - keep:
                stay = [i for i, t in enumerate(held["at"]) if t >= r.at_ns - keep]
                held = {c: [v[i] for i in stay] for c, v in held.items()}
            # plain Python values, as the state store takes no others
            me = {"vector": [[float(v) for v in r.vector]], "affected": [[str(v) for v in r.affected]], "score": [float(r.score)], "near": [float(r.near)], "count": [float(r.count_)]}
            s = memory.similarities(me, held)[0] if held["id"] else []
            best = int(s.argmax()) if len(s) else -1
            top = float(s[best]) if best >= 0 else 0.0
            known = top >= threshold
            out.append((key[0], r.id, "KNOWN" if known else "UNKNOWN", top, held["id"][best] if top > 0 else None))
            if not known and r.category == "Rare Event":
                for c, v in zip(_COLUMNS, (r.id, int(r.at_ns), *(me[k][0] for k in _COLUMNS[2:]))):
                    held[c].append(v)
        state.update(tuple(held[c] for c in _COLUMNS))
        yield pd.DataFrame(out, columns=["mission", "event_id", "status", "similarity", "nearest_id"])

    x = memory._lean(events, "mission", F.col("event_id").cast("string").alias("id"), "at", F.unix_micros("at").alias("at_us"), "category")
    x = x.withColumn("at_ns", F.col("at_us") * 1000).withColumnRenamed("count", "count_").drop("at_us")
    return x.withWatermark("at", late).groupBy("mission").applyInPandasWithState(run, DECISIONS, MEMORY, "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, transform, out: str, mode: str = "append", files: int | None = None, once: bool = False) -> DataFrame:
    """Run a stream over the Parquet files at ``path`` until all are read, into Parquet below ``out``.

    All files present are one micro-batch, so a watermark drops nothing for the way rows are dealt to files.
    With ``files`` that many are read a micro-batch, and rows of later files may be late. ``once`` runs a single
    micro-batch, which state with processing times needs, as such a query always has another one to run.
    """
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    s = (s if files is None else s.option("maxFilesPerTrigger", files)).parquet(path)
    x = transform(s)
    q = x.writeStream.format("parquet").option("path", f"{out}/rows").outputMode(mode).option("checkpointLocation", f"{out}/state")
    q = (q.trigger(once=True) if once else q.trigger(availableNow=True)).start()
    q.awaitTermination()
    return spark.read.schema(x.schema).parquet(f"{out}/rows")


#: How long a record serves as cached, and what an answer says: whose record, from which tier, how old.
RECORD_SECONDS = 3600
ANSWERS = "object_id long, asked_ns long, tier string, payload string, age_s double"
TIERS = ("live", "cached", "stale", "fallback")


class RecordTiers(StatefulProcessor):
    """The newest record of an object: one state that Spark forgets after ``ttl`` seconds, and one that stays.

    Rows with a ``payload`` are records that were just fetched, those without ask. While the first state is
    there, answers are ``cached``; once it has gone they are ``stale``; an object that nothing was ever fetched for
    gets the ``fallback``. Each record is answered as ``live``. When a record's time is up, a timer says
    so once, unless a newer one has come.
    """

    def __init__(self, ttl: int, fallback: str):
        self.ttl, self.fallback = ttl, fallback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fresh = handle.getValueState("fresh", "payload string, at_ms long", ttlDurationMs=self.ttl * 1000)
        self.kept = handle.getValueState("kept", "payload string, at_ms long")

    def _take(self, payload: str, at_ms: int) -> None:
        self.fresh.update((payload, at_ms))
        self.kept.update((payload, at_ms))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms + self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        both = pd.concat(list(rows)).sort_values("asked_ns", kind="stable")
        for r in both.itertuples():
            if r.payload is not None and r.payload == r.payload:
                self._take(r.payload, now)
                out.append((key[0], r.asked_ns, "live", r.payload, 0.0))
            elif self.fresh.exists():
                payload, at = self.fresh.get()
                out.append((key[0], r.asked_ns, "cached", payload, (now - at) / 1000))
            elif self.kept.exists():
                payload, at = self.kept.get()
                out.append((key[0], r.asked_ns, "stale", payload, (now - at) / 1000))
            else:
                out.append((key[0], r.asked_ns, "fallback", self.fallback, None))
        yield pd.DataFrame(out, columns=["object_id", "asked_ns", "tier", "payload", "age_s"]).astype({"object_id": "int64", "asked_ns": "int64", "age_s": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        payload, at = self.kept.get()
        age = (timerValues.getCurrentProcessingTimeInMs() - at) / 1000
        yield pd.DataFrame({"object_id": [key[0]], "asked_ns": [expiredTimerInfo.getExpiryTimeInMs() * 1_000_000], "tier": ["expired"], "payload": [payload], "age_s": [age]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Records of an earlier store, ``payload, at_ms``: what is still young enough serves as cached."""
        for r in initialState.sort_values("at_ms").itertuples():
            self.kept.update((r.payload, int(r.at_ms)))
            if timerValues.getCurrentProcessingTimeInMs() - r.at_ms < self.ttl * 1000:
                self.fresh.update((r.payload, int(r.at_ms)))

    def close(self) -> None:
        pass


def record_tiers(stream: DataFrame, ttl: int = RECORD_SECONDS, fallback: str = "UNAVAILABLE", store: DataFrame | None = None) -> DataFrame:
    """Answers from the freshest tier: ``object_id, asked_ns, tier, payload, age_s``, and an ``expired`` row a record.

    ``stream`` has ``object_id, asked_ns, payload``: records (with a payload) and questions (without). State is
    kept per object in Spark's RocksDB store, with its time to live, and survives restarts; ``store`` has
    ``object_id, payload, at_ms`` of records to begin with. Times are those at which Spark works.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = stream.select("object_id", "asked_ns", "payload").groupBy("object_id")
    first = None if store is None else store.select("object_id", "payload", "at_ms").groupBy("object_id")
    return x.transformWithStateInPandas(RecordTiers(ttl, fallback), ANSWERS, "append", "ProcessingTime", initialState=first)
