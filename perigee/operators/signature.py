"""Signatures of event windows: telemetry features, command context and a scaled vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.clock import DAY, is_finite
from perigee.operators import blocks, context, ranges
from perigee.operators.ordered import asof, trailing_counts

PER_CHANNEL = ("mean", "std", "min", "max", "mag", "diff", "score_max", "score_mean", "score_var")
CONTEXT = ("nearest_tc_diff_sec", "tc_count_24h", "tc_count_2h", "tc_count_30m", "tc_count_5m", "tc_p0_count", "tc_p1_count", "tc_p2_count", "tc_p3_count")
#: Range of values from which a channel counts as affected whatever its scores.
MOVED = 0.05


def window_samples(scored: DataFrame, ev: DataFrame, channels: list[str], around: int = 5) -> DataFrame:
    """Samples of the named channels inside each event's window, ``event_id, channel, ts_ns, value, score``.

    A channel without a sample in the window gives the samples at the positions from ``around`` before to
    ``around - 1`` after the first one at or past the start, as far as the series goes. Only days that hold any of
    these are put in order; which days they are follows from the number of samples of each day. The windows
    without samples are written.
    """
    from perigee.sources.tables import written

    w, scored = ev.select("event_id", "start_ns", "end_ns"), scored.where(F.col("channel").isin(channels))
    points = scored.select("channel", "value", "score", F.col("ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"))
    inside = ranges.interval_join(points, w).select(F.col("b_event_id").alias("event_id"), "channel", F.col("start_ns").alias("ts_ns"), "value", "score")
    every = w.select("*", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    bare = written(every.join(inside.select("event_id", "channel").distinct(), ["event_id", "channel"], "left_anti"))
    if not bare.head(1):
        return inside
    day = F.floor(F.col("ts_ns") / DAY).cast("long")
    days = scored.groupBy("channel", day.alias("day")).agg(F.count("*").alias("c"))
    up = Window.partitionBy("channel").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = written(days.withColumn("end_ns", F.sum("c").over(up)).withColumn("start_ns", F.col("end_ns") - F.col("c") + 1))
    # positions that a window without samples may need: around those of its day
    asks = asof(bare.select("channel", F.floor(F.col("start_ns") / DAY).cast("long").alias("on")).distinct(), days.select("channel", "day", "start_ns", "end_ns"), "on", "day", ["channel"])
    same = F.coalesce(F.col("match.day") == F.col("on"), F.lit(False))
    last = F.coalesce("match.end_ns", F.lit(0))
    asks = asks.select("channel", (F.when(same, F.col("match.start_ns") - 1).otherwise(last) - around + 1).alias("start_ns"), (last + around).alias("end_ns"))
    held = ranges.interval_join(days, asks, ["channel"], width=1 << 12, top=4).select("channel", "day", (F.col("start_ns") - 1).alias("before")).distinct()
    own = Window.partitionBy("channel", "day").orderBy("ts_ns")
    placed = scored.select("channel", "ts_ns", "value", "score", day.alias("day")).join(held, ["channel", "day"])
    placed = placed.withColumn("n", F.row_number().over(own) + F.col("before")).drop("day", "before")
    at = asof(bare.withColumn("before_ns", F.col("start_ns") - 1), placed.select("channel", "ts_ns", "n"), "before_ns", "ts_ns", ["channel"])
    at = at.select("event_id", "channel", F.coalesce("match.n", F.lit(0)).alias("i"))
    positions = at.select("event_id", "channel", F.explode(F.sequence(F.col("i") - around + 1, F.col("i") + around)).alias("n"))
    near = positions.join(placed, ["channel", "n"]).select("event_id", "channel", "ts_ns", "value", "score")
    return inside.unionByName(near)


def channel_features(samples: DataFrame) -> DataFrame:
    """The nine features of every event and channel; 0 where no value is finite."""
    v = F.when(is_finite("value"), F.col("value").cast("double"))
    at = F.when(is_finite("value"), F.col("ts_ns"))
    x = samples.groupBy("event_id", "channel").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("mag"), (F.max_by(v, at) - F.min_by(v, at)).alias("diff"),
        F.max("score").alias("score_max"), F.avg("score").alias("score_mean"), F.var_pop("score").alias("score_var"))
    return x.fillna(0.0, list(PER_CHANNEL))


def window_features(scored: DataFrame, ev: DataFrame, channels: list[str], around: int = 5) -> DataFrame:
    """``channel_features`` of ``window_samples``, without pairs of windows and samples: joined from blocks of samples."""
    x = scored.where(F.col("channel").isin(channels)).select("channel", "ts_ns", F.when(is_finite("value"), F.col("value").cast("double")).alias("value"), "score")
    samples, held = blocks.numbered(x, ev, ["channel"])
    bare = F.col("high") <= F.col("low")
    held = held.select("start_ns", "end_ns", "channel", F.when(bare, F.greatest(F.col("low") - around, F.lit(0))).otherwise(F.col("low")).alias("low"), F.when(bare, F.col("low") + around).otherwise(F.col("high")).alias("high"))
    s = blocks.statistics(samples, held, ["channel"], ["value", "score"])
    spread = lambda c: F.try_divide(F.col(f"{c}.m2"), F.col(f"{c}.n"))
    average = lambda c: F.try_divide(F.col(f"{c}.total"), F.col(f"{c}.n"))
    s = s.select("start_ns", F.col("end_ns").alias("__end"), "channel", average("value").alias("mean"), F.sqrt(spread("value")).alias("std"), F.col("value.min").alias("min"), F.col("value.max").alias("max"),
                 (F.col("value.max") - F.col("value.min")).alias("mag"), (F.col("value.last.v") - F.col("value.first.v")).alias("diff"), F.col("score.max").alias("score_max"), average("score").alias("score_mean"), spread("score").alias("score_var"))
    w = ev.select("event_id", "start_ns", F.coalesce("end_ns", F.col("start_ns") - 1).alias("__end"))
    return w.join(s, ["start_ns", "__end"]).select("event_id", "channel", *PER_CHANNEL).fillna(0.0, list(PER_CHANNEL))


def affected_channels(features: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Channels whose score passes the threshold or whose values moved, in order, and the largest score."""
    hit = (F.col("score_max") > threshold) | (F.col("mag") > MOVED)
    return features.groupBy("event_id").agg(F.array_sort(F.array_compact(F.collect_list(F.when(hit, F.col("channel"))))).alias("affected"), F.max("score_max").alias("agg_score_max"))


def command_context(ev: DataFrame, commands: DataFrame) -> DataFrame:
    """``event_id`` and the nine context features; without a command before, the gap is a day and counts are 0."""
    near = context.nearest_commands(ev, commands).select("event_id", F.coalesce(F.col("delta_ns") / 1e9, F.lit(context.NO_COMMAND_SECONDS)).alias("nearest_tc_diff_sec"))
    windows = {f"tc_count_{k}": w for k, w in context.WINDOWS.items()} | {f"tc_p{p}_count": (context.WINDOWS["24h"], F.col("priority") == p) for p in context.PRIORITIES}
    x = trailing_counts(ev.select("event_id", "start_ns"), commands, "start_ns", "ts_ns", windows).drop("start_ns")
    return x.join(near, "event_id").select("event_id", *[F.col(c).cast("double").alias(c) for c in CONTEXT])


def signatures(scored: DataFrame, ev: DataFrame, commands: DataFrame, channels: list[str], threshold: float = 3.0, features: DataFrame | None = None) -> DataFrame:
    """One row per event: affected channels, features and context as maps, and the vector in order of its names.

    Telemetry features enter the vector as they are; context in seconds as a tenth of log(1 + x), other
    context as a tenth. ``features`` are those of ``window_features``, where they are there already; otherwise they
    are found here and written.
    """
    from perigee.sources.tables import written

    f = written(window_features(scored, ev, channels)) if features is None else features
    top = affected_channels(f, threshold)
    names = F.transform(F.array(*map(F.lit, PER_CHANNEL)), lambda n: F.concat(F.col("channel"), F.lit("_"), n))
    each = f.groupBy("event_id").agg(F.flatten(F.collect_list(F.arrays_zip(names.alias("k"), F.array(*PER_CHANNEL).alias("v")))).alias("pairs"))
    known = F.map_from_arrays(F.col("pairs.k"), F.col("pairs.v"))
    every = [f"{c}_{n}" for c in sorted(channels) for n in PER_CHANNEL]
    x = ev.select("event_id", "start_ns", "end_ns").join(each, "event_id", "left").join(top, "event_id", "left").join(command_context(ev, commands), "event_id")
    seconds = (F.col("end_ns") - F.col("start_ns")) / 1e9
    telemetry = {n: F.coalesce(F.element_at(known, n), F.lit(0.0)) for n in every} | {"agg_score_max": F.coalesce("agg_score_max", F.lit(0.0)), "duration_seconds": seconds}
    scaled = telemetry | {c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) / 10 if "sec" in c else F.col(c) / 10 for c in CONTEXT}
    order = sorted(scaled)
    affected = F.coalesce("affected", F.array().cast("array<string>"))
    return x.select("event_id", "start_ns", "end_ns", seconds.alias("duration_seconds"), affected.alias("affected"), F.size(affected).alias("num_affected"),
                    F.create_map(*[v for n, c in telemetry.items() for v in (F.lit(n), c)]).alias("telemetry_features"),
                    F.create_map(*[v for c in CONTEXT for v in (F.lit(c), F.col(c))]).alias("context_features"),
                    F.array(*[scaled[n] for n in order]).alias("vector"), F.array(*map(F.lit, order)).alias("names"))


def to_json(x: DataFrame) -> DataFrame:
    return x.select("event_id", F.to_json(F.struct(*x.columns)).alias("json"))


def from_json(x: DataFrame, like: DataFrame) -> DataFrame:
    """Signatures from JSON; missing lists and maps are empty."""
    y = x.select(F.from_json("json", like.schema).alias("s")).select("s.*")
    empty = {"affected": F.array(), "vector": F.array(), "names": F.array(), "telemetry_features": F.create_map(), "context_features": F.create_map()}
    return y.withColumns({c: F.coalesce(c, e.cast(like.schema[c].dataType)) for c, e in empty.items()})
