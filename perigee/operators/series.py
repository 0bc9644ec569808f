"""Quality and sampling of irregular series ``channel, ts_ns, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.clock import is_finite
from perigee.operators.ordered import exact_quantiles, neighbours, running_sum

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def quality(df: DataFrame) -> DataFrame:
    """One row per channel: counts, extent, repeated times, not-a-numbers, infinities and finite statistics."""
    v = F.col("value").cast("double")
    good = F.when(is_finite(v), v)
    bad = v.isNull() | F.isnan(v)
    return df.groupBy("channel").agg(
        F.count("*").alias("sample_count"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        (F.count("ts_ns") - F.count_distinct("ts_ns")).alias("duplicate_timestamps"), F.count_if(bad).alias("nan_count"),
        F.count_if(v == float("inf")).alias("positive_infinities"), F.count_if(v == float("-inf")).alias("negative_infinities"),
        F.count(good).alias("finite_count"), F.count_distinct(good).alias("distinct_finite"),
        F.round(F.avg(good), 6).alias("mean"), F.round(F.stddev_pop(good), 6).alias("std"))


def quantiles(df: DataFrame, points=QUANTILES) -> DataFrame:
    """Linear-interpolated quantiles of the finite values, one row per channel and point."""
    v = F.col("value").cast("double")
    return exact_quantiles(df.where(is_finite(v)), ["channel"], "value", points).drop("n")


def intervals(df: DataFrame) -> DataFrame:
    """One row per channel: number, distinct number, extremes and mode of the steps in time, and if they agree."""
    x = neighbours(df.select("channel", "ts_ns"), ["channel"], ["ts_ns"], ["ts_ns"]).where("prev is not null")
    x = x.select("channel", (F.col("ts_ns") - F.col("prev.ts_ns")).alias("step")).groupBy("channel", "step").agg(F.count("*").alias("n"))
    return x.groupBy("channel").agg(
        F.sum("n").alias("interval_count"), F.count("*").alias("distinct_intervals"), F.min("step").alias("min_step_ns"), F.max("step").alias("max_step_ns"),
        F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("mode_step_ns"), (F.count("*") == 1).alias("uniform"))


def violations(df: DataFrame) -> DataFrame:
    """Per channel, samples that don't come strictly after the one before in time (repeated times)."""
    x = neighbours(df.select("channel", "ts_ns"), ["channel"], ["ts_ns"], ["ts_ns"])
    return x.groupBy("channel").agg(F.count_if(F.col("ts_ns") <= F.col("prev.ts_ns")).alias("not_increasing"))


def checked(df: DataFrame, repeated: bool = False) -> DataFrame:
    """Samples ``channel, ts_ns, value`` as they are, with an error at a null time or channel and, unless ``repeated`` ones are allowed, at a repeated time."""
    x = df if repeated else neighbours(df, ["channel"], ["ts_ns"], ["ts_ns"])
    bad = F.col("ts_ns").isNull() | F.col("channel").isNull()
    if not repeated:
        bad = bad | F.coalesce(F.col("ts_ns") <= F.col("prev.ts_ns"), F.lit(False))
    wrong = F.concat(F.lit("times don't increase in channel "), F.coalesce("channel", F.lit("null")))
    return x.withColumn("ts_ns", F.when(bad, F.raise_error(wrong).cast("long")).otherwise(F.col("ts_ns"))).select(*df.columns)


def stride(df: DataFrame, most: int = 80) -> DataFrame:
    """Every ``n div most``-th sample of a channel that has more than ``most``."""
    n = df.groupBy("channel").agg(F.count("*").alias("__n"))
    x = running_sum(df, ["channel"], ["ts_ns"], F.lit(1), "__i").join(n, "channel")
    step = F.when(F.col("__n") > most, F.floor(F.col("__n") / most)).otherwise(1)
    return x.where(F.pmod(F.col("__i") - 1, step) == 0).drop("__n", "__i")


def leading(df: DataFrame, most: int = 10) -> DataFrame:
    """The first samples of every channel. The rank is cut inside each task, so only so many of each reach a shuffle."""
    first = Window.partitionBy("channel").orderBy("ts_ns")
    return df.withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= most).drop("__i")


def dead_reckoned(updates: DataFrame) -> DataFrame:
    """Longitude and latitude half-way to the next update, along the shorter way around."""
    x = neighbours(updates, ["object_id"], ["ts_ns"], ["ts_ns", "lon", "lat"]).where("next is not null")
    turn = F.pmod(F.col("next.lon") - F.col("lon") + 540, F.lit(360.0)) - 180
    lon = F.pmod(F.col("lon") + turn / 2 + 540, F.lit(360.0)) - 180
    return x.select("object_id", "ts_ns", lon.alias("lon"), ((F.col("lat") + F.col("next.lat")) / 2).alias("lat"))
