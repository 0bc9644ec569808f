"""Label-free detectors: one parameter row per channel, fitted on the training part, scored by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions.clock import SECOND, is_finite
from perigee.operators.blocks import numbered
from perigee.operators.ordered import exact_medians
from perigee.operators.ranges import islands, run_counts

MAD_SCALE = 1.4826


def _training(df: DataFrame, boundary: int | None) -> DataFrame:
    v = F.col("value").cast("double")
    x = df if boundary is None else df.where(F.col("ts_ns") <= boundary)
    return x.select("channel", v.alias("value")).where(is_finite("value"))


def fit_std(df: DataFrame, boundary: int | None = None) -> DataFrame:
    """``channel, center, scale, n``: mean and population deviation of finite training values."""
    return _training(df, boundary).groupBy("channel").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"), F.count("*").alias("n"))


def fit_mad(df: DataFrame, boundary: int | None = None) -> DataFrame:
    """``channel, center, scale, n``: median and scaled median absolute deviation. The medians are written, a row a channel."""
    from perigee.sources.tables import written

    x = _training(df, boundary)
    center = written(exact_medians(x, ["channel"], "value", "center"))
    far = x.join(center.drop("n"), "channel").select("channel", F.abs(F.col("value") - F.col("center")).alias("far"))
    scale = exact_medians(far, ["channel"], "far", "scale").select("channel", (F.col("scale") * MAD_SCALE).alias("scale"))
    return center.join(scale, "channel").select("channel", "center", "scale", "n")


def missing_channels(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Channels without a finite training value; fitting them is an error for callers that need all."""
    return df.select("channel").distinct().join(parameters, "channel", "left_anti")


def score_of(value: Column, center: Column, scale: Column) -> Column:
    """Distance from the centre in scales; 0 for what isn't finite, 10 for any deviation where the scale is 0."""
    value = value.cast("double")
    flat = F.when(value != center, F.lit(10.0)).otherwise(F.lit(0.0))
    return F.when(~is_finite(value), F.lit(0.0)).when(scale == 0, flat).otherwise(F.abs(value - center) / F.nullif(scale, F.lit(0.0)))


def score(df: DataFrame, parameters: DataFrame, threshold: float) -> DataFrame:
    """Adds ``score`` and ``alarm`` (strictly above); channels without parameters are left out."""
    x = df.join(parameters.select("channel", "center", "scale"), "channel")
    x = x.withColumn("score", score_of(F.col("value"), F.col("center"), F.col("scale"))).drop("center", "scale")
    return x.withColumn("alarm", F.col("score") > threshold)


def no_alarm(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(0.0)).withColumn("alarm", F.lit(False))


def across_channels(scored: DataFrame) -> DataFrame:
    """Per time: root mean square of the scores and whether any channel alarms."""
    return scored.groupBy("ts_ns").agg(F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("unusualness"), F.bool_or("alarm").alias("alarm"))


def event_alarms(scored_windows: DataFrame, threshold: float) -> DataFrame:
    """Per event, whether any sample of any channel in its window is strictly above the threshold."""
    return scored_windows.groupBy("event_id").agg(F.bool_or(F.col("score") > threshold).alias("alarm"), F.max("score").alias("score_max"))


def window_alarms(scored: DataFrame, ev: DataFrame, threshold: float) -> DataFrame:
    """``event_id, alarm`` of events with a sample: ``event_alarms`` of all samples inside, from running counts over all channels."""
    x = scored.select("ts_ns", F.lit(0).alias("any"), (F.col("score") > threshold).alias("alarm"))
    held = numbered(x.select("any", "ts_ns", "alarm"), ev, ["any"], {"alarms": F.col("alarm")})[1].where("high > low")
    return ev.select("event_id", "start_ns", "end_ns").join(held, ["start_ns", "end_ns"]).select("event_id", (F.col("alarms") > 0).alias("alarm"))


#: The longest gap in nanoseconds between alarms of one window.
CONTINUITY = 90 * SECOND


def alarm_windows(scored: DataFrame, max_gap_ns: int = CONTINUITY) -> DataFrame:
    """Windows in which any channel alarms, over all channels; alarms further apart than the gap are two."""
    x = across_channels(scored).select("ts_ns", F.col("alarm").alias("positive"))
    return islands(x, (), max_gap_ns)


def suite(df: DataFrame, boundary: int, max_gap_ns: int = CONTINUITY) -> DataFrame:
    """The baselines none, 3 and 5 deviations, and 5 median deviations: alarmed samples, times and windows of each.

    All are scored in one pass over the samples, which leaves one row a time with the alarms of each baseline; that
    table is written. Times without any alarm only break runs, so they are carried as one flag a baseline too.
    """
    from perigee.sources.tables import written

    limits = {"std3": ("std", 3.0), "std5": ("std", 5.0), "mad5": ("mad", 5.0)}
    both = fit_std(df, boundary).select("channel", F.col("center").alias("std_center"), F.col("scale").alias("std_scale"))
    both = both.join(fit_mad(df, boundary).select("channel", F.col("center").alias("mad_center"), F.col("scale").alias("mad_scale")), "channel")
    far = {k: score_of(F.col("value"), F.col(f"{k}_center"), F.col(f"{k}_scale")) for k in ("std", "mad")}
    x = df.join(both, "channel").select("ts_ns", *[far[k].alias(k) for k in far])
    at = written(x.groupBy("ts_ns").agg(*[F.count_if(F.col(k) > limit).alias(n) for n, (k, limit) in limits.items()]))
    sums = at.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in limits], *[F.count_if(F.col(n) > 0).alias(f"{n}_times") for n in limits], F.count("*").alias("all"))
    none = F.lit(0).cast("long")
    out = sums.where("all > 0").select(F.explode(F.array(F.struct(F.lit("no_alarm").alias("baseline"), none.alias("alarms"), none.alias("alarm_times")), *[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("alarms"), F.col(f"{n}_times").alias("alarm_times")) for n in limits])).alias("r")).select("r.*")
    runs = run_counts(at, {n: F.col(n) > 0 for n in limits}, max_gap_ns)
    runs = runs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("windows")) for n in limits])).alias("r")).select("r.*")
    return out.join(F.broadcast(runs), "baseline", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
