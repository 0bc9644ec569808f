"""Commands before events: nearest one, trailing counts and how often each category has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions.clock import HOUR, SECOND
from perigee.operators.labels import one_each
from perigee.operators.ordered import asof, exact_medians, trailing_counts

WINDOWS = {"5m": 300 * SECOND, "30m": 1800 * SECOND, "2h": 2 * HOUR, "24h": 24 * HOUR}
PRIORITIES = (0, 1, 2, 3)
NO_COMMAND_SECONDS = 86400.0


def priority_key(priority: str = "priority"):
    return F.coalesce(F.col(priority).cast("string"), F.lit("<missing>"))


def nearest_commands(ev: DataFrame, commands: DataFrame) -> DataFrame:
    """Events with the latest command at or before their start: ``telecommand, command_ns, delta_ns``."""
    c = commands.select("telecommand", F.col("ts_ns").alias("command_ns"), "priority")
    x = asof(ev, c, "start_ns", "command_ns", ties=["telecommand", "priority"])
    return x.select(*ev.columns, F.col("match.telecommand").alias("telecommand"), F.col("match.command_ns").alias("command_ns"), (F.col("start_ns") - F.col("match.command_ns")).alias("delta_ns"))


def command_counts(ev: DataFrame, commands: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Events with the number of commands in each trailing window, both ends included."""
    windows = WINDOWS if windows is None else windows
    if not windows or any(w <= 0 for w in windows.values()):
        raise ValueError("windows must be positive")
    return trailing_counts(ev, commands, "start_ns", "ts_ns", {f"count_{k}": v for k, v in windows.items()})


def priority_counts(ev: DataFrame, commands: DataFrame, window: int = 24 * HOUR) -> DataFrame:
    """``event_id, category, priority, commands`` in the trailing window, priorities with any command.

    A priority is a key of the counts, so the plan is the same whatever their number.
    """
    known = commands.select(F.col("priority").cast("long").alias("priority")).distinct()
    left = ev.select("event_id", "category", "start_ns").join(known, F.lit(True))
    x = trailing_counts(left, commands.withColumn("priority", F.col("priority").cast("long")), "start_ns", "ts_ns", {"commands": window}, ["priority"])
    return x.select("event_id", "category", "priority", "commands").where("commands > 0")


def delta_summary(near: DataFrame) -> DataFrame:
    """Per category: events, those with a command before, and min, median, mean and max of the gap in seconds."""
    near = near.withColumn("__d", F.col("delta_ns") / 1e9)
    d = F.col("__d")
    middle = exact_medians(near, ["category"], "__d", "median_s").drop("n").withColumn("median_s", F.round("median_s", 6))
    x = near.groupBy("category").agg(
        F.count("*").alias("event_count"), F.count("delta_ns").alias("with_command"), F.round(F.min(d), 6).alias("min_s"), F.round(F.try_divide(F.sum("delta_ns"), F.count("delta_ns")) / 1e9, 6).alias("mean_s"), F.round(F.max(d), 6).alias("max_s"))
    return x.join(middle, "category", "left")


def proximity(ev: DataFrame, commands: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Per category and window: events with a command in it and their share, 0 without events."""
    windows = WINDOWS if windows is None else windows
    x = command_counts(ev, commands, windows)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.col(f"count_{k}").alias("n")) for k in windows])).alias("w")
    x = x.select("category", pairs).groupBy("category", F.col("w.window").alias("window"))
    x = x.agg(F.count("*").alias("event_count"), F.count_if(F.col("w.n") > 0).alias("with_command"))
    return x.withColumn("rate", F.round(F.coalesce(F.try_divide("with_command", "event_count"), F.lit(0.0)), 6))


def command_streams(commands: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per defined command ``telecommand, priority``: executions, 0 where there are none, and their extent."""
    n = commands.groupBy("telecommand").agg(F.count("*").alias("executions"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    return one_each(definitions.select("telecommand", "priority"), "telecommand").join(n, "telecommand", "left").withColumn("executions", F.coalesce("executions", F.lit(0)))


def command_quality(commands: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row: definitions, executions, streams without one, and the extent of all."""
    return command_streams(commands, definitions).agg(F.count("*").alias("definitions"), F.sum("executions").alias("executions"), F.count_if(F.col("executions") == 0).alias("empty_streams"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def execution_counts(commands: DataFrame, by: str) -> DataFrame:
    """Executions and commands by priority, by value or by whatever column is named, and their extent."""
    return commands.groupBy(by).agg(F.count("*").alias("executions"), F.count_distinct("telecommand").alias("telecommands"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
