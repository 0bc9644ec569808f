"""Label rows, events and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.clock import split_of
from perigee.functions.text import trailing_number
from perigee.operators.ordered import exact_medians

SPLITS = ("train", "validation", "test")


def _refused(bad: Column, message: Column | str, kind: str = "string") -> Column:
    """Null, or an error where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message) if isinstance(message, str) else message).cast(kind))


def one_each(df: DataFrame, key: str) -> DataFrame:
    """The frame with at most one row a key; a key that stands twice is an error."""
    rest = [c for c in df.columns if c != key]
    x = df.groupBy(key).agg(F.count("*").alias("__n"), F.any_value(F.struct(*rest)).alias("__r"))
    twice = F.concat(F.lit(f"{key} stands more than once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.coalesce(_refused(F.col("__n") > 1, twice, x.schema["__r"].dataType.simpleString()), F.col("__r"))
    return x.select(key, checked.alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def many_to_one(df: DataFrame, right: DataFrame, key: str, right_key: str | None = None, required: str | None = None) -> DataFrame:
    """Left join to a table of definitions that must have one row a key; all rows of ``df`` stay.

    ``required`` names a column of ``right`` that must be there for every row; a row without it is an error.
    """
    facts = one_each(right, right_key or key).withColumnRenamed(right_key or key, key)
    out = df.join(facts, key, "left")
    if required:
        missing = F.concat(F.lit(f"{key} is undefined: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        kind = out.schema[required].dataType.simpleString()
        out = out.withColumn(required, F.coalesce(F.col(required), _refused(F.col(required).isNull(), missing, kind)))
    return out


def only_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Rows of the named channels; a name that is repeated or has no row is an error."""
    if len(set(channels)) != len(channels):
        raise ValueError("a channel is named twice")
    found = {r["channel"] for r in df.where(F.col("channel").isin(channels)).select("channel").distinct().collect()}
    if missing := sorted(set(channels) - found):
        raise ValueError(f"channels without a row: {missing}")
    return df.where(F.col("channel").isin(channels))


def channel_counts(rows: DataFrame) -> DataFrame:
    """``event_id, selected_channels, all_channels``: distinct channels of each event."""
    return rows.groupBy("event_id").agg(F.count_distinct(F.when(F.col("is_selected_channel"), F.col("channel"))).alias("selected_channels"), F.count_distinct("channel").alias("all_channels"))


def event_table(rows: DataFrame, types: DataFrame, selected: list[str]) -> DataFrame:
    """Label rows of events that touch a selected channel, with their type and channel counts.

    ``types`` must have one row per event id, or the join is refused; it keeps every label row.
    """
    ids = rows.where(F.col("channel").isin(selected)).select("event_id").distinct()
    kept = rows.join(ids, "event_id", "left_semi").withColumn("is_selected_channel", F.col("channel").isin(selected))
    out = many_to_one(kept, types, "event_id").join(channel_counts(kept), "event_id")
    return out.withColumn("multichannel", F.col("all_channels") > 1).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once: what a many-to-one join must not meet on its right."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def undefined_keys(df: DataFrame, definitions: DataFrame, key: str, defined: str) -> DataFrame:
    """Keys of ``df`` that ``definitions`` doesn't have."""
    return df.select(key).distinct().join(definitions.select(F.col(defined).alias(key)), key, "left_anti")


def natural_order(df: DataFrame, column: str = "channel") -> DataFrame:
    """Sorted by the number at the end of the name, names without one last, then by name."""
    return df.orderBy(trailing_number(column).asc_nulls_last(), column)


def natural_places(df: DataFrame, column: str) -> DataFrame:
    """``column, place``: distinct names in natural order, counted from 1. Names are few: one row a name."""
    names = df.select(column).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(trailing_number(column).asc_nulls_last(), column)))


def events(rows: DataFrame) -> DataFrame:
    """One row per event id from its selected rows: category, class and extent.

    An event with more than one category or class is an error.
    """
    x = rows.where("is_selected_channel").groupBy("event_id").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("category", "class") for n, f in (("low", F.min), ("high", F.max))], F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    both = F.concat(F.lit("more than one category or class: "), F.col("event_id").cast("string"))
    one = lambda c: F.coalesce(_refused(F.col(f"low_{c}") != F.col(f"high_{c}"), both), F.col(f"low_{c}")).alias(c)
    return x.select("event_id", one("category"), one("class"), "start_ns", "end_ns")


def class_sets(ev: DataFrame) -> DataFrame:
    """``class, seen``: classes of events only before the test part, only in it, or in both."""
    test = F.col("split") == "test"
    x = ev.groupBy("class").agg(F.bool_or(test).alias("late"), F.bool_or(~test).alias("early"))
    return x.select("class", F.when(F.col("late") & F.col("early"), "both").when(F.col("late"), "test only").otherwise("before test").alias("seen"))


def conflicting(rows: DataFrame) -> DataFrame:
    """Event ids with more than one category or class, which collapsing must not meet."""
    x = rows.where("is_selected_channel").groupBy("event_id").agg(F.count_distinct("category").alias("categories"), F.count_distinct("class").alias("classes"))
    return x.where("categories > 1 or classes > 1")


def assigned(ev: DataFrame, validation: int, test: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Events with the split of their start and whether they cross a boundary on either side."""
    start, end = F.col("start_ns"), F.col("end_ns")
    return (ev.withColumn("split", split_of("start_ns", validation, test, first, last))
            .withColumn("crosses_validation", (start <= validation) & (end > validation))
            .withColumn("crosses_test", (start <= test) & (end > test)))


def nested_counts(ev: DataFrame) -> DataFrame:
    """Events by split, by split and category, and by split, category and class, in one pass."""
    g = ev.groupingSets([["split"], ["split", "category"], ["split", "category", "class"]], "split", "category", "class")
    return g.agg(F.count("*").alias("event_count"), F.grouping_id().alias("depth"))


def split_counts(ev: DataFrame) -> DataFrame:
    """Events of every category by split, 0 where there are none."""
    return ev.groupBy("category").pivot("split", list(SPLITS)).count().fillna(0, list(SPLITS))


def recurrence(ev: DataFrame) -> DataFrame:
    """Per category and class: events, the first one, later ones and their splits."""
    at = F.struct("start_ns", "event_id")
    first = F.min_by(F.struct("event_id", "start_ns", "split"), at)
    x = ev.groupBy("category", "class").agg(
        F.count("*").alias("event_count"), first.alias("f"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return x.select("category", "class", "event_count", F.col("f.event_id").alias("first_event_id"), F.col("f.start_ns").alias("first_start_ns"),
                    F.col("f.split").alias("first_split"), (F.col("event_count") - 1).alias("later_count"), *SPLITS)


def rare_classes(ev: DataFrame, category: str = "Rare Event") -> DataFrame:
    """Classes of a category: whether they recur, were seen in training and again later, or are new in the test part."""
    x = recurrence(ev).where(F.col("category") == category)
    return x.select("class", (F.col("event_count") > 1).alias("recurrent"),
                    ((F.col("first_split") == "train") & (F.col("validation") + F.col("test") > 0)).alias("train_then_later"),
                    ((F.col("test") > 0) & (F.col("train") + F.col("validation") == 0)).alias("unseen_in_test"))


def summary(ev: DataFrame) -> DataFrame:
    """Per category and class: events, whether seen before the test part and whether repeated in it."""
    before = F.count_if(F.col("split") != "test")
    inside = F.count_if(F.col("split") == "test")
    return ev.groupBy("category", "class").agg(F.count("*").alias("event_count"), (before > 0).alias("observed_before_test"), ((before > 0) & (inside > 0)).alias("repeated_in_test"))


def quality(rows: DataFrame) -> DataFrame:
    """One row on a label table: rows, ids, extent, flags, durations (median cut to a whole number) and nulls."""
    d = F.col("end_ns") - F.col("start_ns")
    one = rows.agg(
        F.count("*").alias("row_count"), F.count_distinct("event_id").alias("event_count"), F.min("start_ns").alias("first_start_ns"), F.max("end_ns").alias("last_end_ns"),
        F.count_if("is_selected_channel").alias("selected_rows"), F.min(d).alias("min_duration_ns"), F.max(d).alias("max_duration_ns"),
        F.count_if(d == 0).alias("zero_durations"), F.count_if(F.col("category").isNull()).alias("null_categories"), F.count_if(F.col("class").isNull()).alias("null_classes"))
    middle = exact_medians(rows.withColumn("__d", d), (), "__d").select(F.floor("median").cast("long").alias("median_duration_ns"))
    return one.join(middle, F.lit(True), "left")  # single rows


def quality_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("row_count"), F.count_distinct("event_id").alias("event_count"))
