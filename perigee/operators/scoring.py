"""Corrected event-wise scores of prediction intervals against labelled events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.operators import ranges
from perigee.operators.ordered import running_sums
from perigee.sources.tables import written

POSITIVE = {"unusual": ("Anomaly", "Rare Event"), "operational": ("Anomaly",)}
MASKED = ("Communication Gap",)


def selected(rows: DataFrame) -> DataFrame:
    """Label rows of selected channels, where that is marked. A row that ends before it starts is an error."""
    x = rows.where("is_selected_channel") if "is_selected_channel" in rows.columns else rows
    wrong = F.concat(F.lit("a label ends before it starts: "), F.coalesce(F.col("event_id").cast("string"), F.lit("null")))
    return x.withColumn("end_ns", F.when(F.col("end_ns") < F.col("start_ns"), F.raise_error(wrong).cast("long")).otherwise(F.col("end_ns")))


def event_intervals(rows: DataFrame, categories=None) -> DataFrame:
    """``event_id, start_ns, end_ns``, united per event, of selected label rows of the categories."""
    x = selected(rows)
    x = x if categories is None else x.where(F.col("category").isin(*categories) if categories else F.lit(False))
    return ranges.union(x, ["event_id"])


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Label rows that end before they start, which scoring refuses."""
    return rows.where("end_ns < start_ns")


def _by_category(predictions: DataFrame, rows: DataFrame, low: int, high: int, masked) -> tuple[DataFrame, DataFrame]:
    """Events, those found by the kept and by all predictions, per category; and one row on false predictions.

    One sweep over the ends of predictions, labels and the range knows at every moment what is open, so the
    kept predictions are its runs, and false time and nominal time are sums over it.
    """
    x = selected(rows)
    domain = predictions.sparkSession.createDataFrame([(low, high)], "start_ns long, end_ns long")
    mask = x.where(F.col("category").isin(*masked) if masked else F.lit(False))
    s = ranges.sweep({"p": predictions, "m": mask, "l": x, "d": domain})
    state = lambda end: {"raw": (F.col(f"p{end}") > 0) & (F.col(f"d{end}") > 0), "kept": (F.col(f"p{end}") > 0) & (F.col(f"d{end}") > 0) & (F.col(f"m{end}") == 0), "free": F.col(f"l{end}") == 0, "inside": F.col(f"d{end}") > 0}
    now, then = state(""), state("_before")
    wrong = lambda t: {"raw": t["raw"], "kept": t["kept"], "fp": t["kept"] & t["free"], "nominal": t["inside"] & t["free"]}
    flags = {f"{k}_on": v for k, v in wrong(now).items()} | {f"{k}_was": v for k, v in wrong(then).items()}
    begins = lambda k: (F.col(f"{k}_on") & ~F.col(f"{k}_was")).cast("long")
    s = running_sums(s.withColumns(flags).select("t_ns", "l", *flags), (), ["t_ns"], {"kept_run": begins("kept"), "raw_run": begins("raw")})
    s = written(s)  # read once for the times and once for the runs
    # a run of integers is one shorter than the moments it holds: every start of one takes that one away
    part = lambda k: F.coalesce(F.sum(F.when(F.col(f"{k}_was") & ~F.col(f"{k}_on"), F.col("t_ns") - 1).when(F.col(f"{k}_on") & ~F.col(f"{k}_was"), -F.col("t_ns"))), F.lit(0))
    time = s.agg(part("fp").alias("fp_time_ns"), part("nominal").alias("nominal_ns"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k == "kept").alias("kept"), F.col(f"{k}_run").alias("run"), F.col(f"{k}_on").alias("on"), F.col(f"{k}_was").alias("was")) for k in ("kept", "raw")])).alias("r")
    # a moment belongs to a run while it is on, and once more where it ends
    edges = s.select("t_ns", "l", kinds).select("t_ns", "l", "r.*").where(F.col("on") | F.col("was"))
    both = edges.groupBy("kept", "run").agg(F.min(F.when(F.col("on") & ~F.col("was"), F.col("t_ns"))).alias("start_ns"), (F.max(F.when(~F.col("on"), F.col("t_ns"))) - 1).alias("end_ns"), F.bool_or(F.col("on") & (F.col("l") > 0)).alias("labelled"))
    events = x.where((F.col("end_ns") >= low) & (F.col("start_ns") <= high)).select("event_id", "category", F.greatest("start_ns", F.lit(low)).alias("start_ns"), F.least("end_ns", F.lit(high)).alias("end_ns"))
    found = ranges.interval_join(events, both).groupBy("category").agg(
        F.count_distinct(F.when(F.col("b_kept"), F.col("event_id"))).alias("found"), F.count_distinct(F.when(~F.col("b_kept"), F.col("event_id"))).alias("found_raw"))
    total = events.groupBy("category").agg(F.count_distinct("event_id").alias("events"))
    cats = total.join(found, "category", "left").fillna(0, ["found", "found_raw"])
    false = both.where("kept").agg(F.count_if(~F.col("labelled")).alias("fp"))
    return cats, time.join(false, F.lit(True))  # single rows


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _scores(cats: DataFrame, one: DataFrame, modes: dict[str, tuple], beta: float) -> DataFrame:
    if beta <= 0:
        raise ValueError("beta must be positive")
    sums = []
    for m, positive in modes.items():
        inside = F.col("category").isin(*positive)
        sums += [F.struct(F.lit(m).alias("mode"), F.coalesce(F.sum(F.when(inside, F.col("found"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(inside, F.col("events"))), F.lit(0)).alias("positives"))]
    pick = lambda c, name: F.coalesce(F.sum(F.when(F.col("category") == c, F.col(name))), F.lit(0))
    x = cats.agg(F.array(*sums).alias("m"), pick("Rare Event", "found").alias("rare_alarms"), pick("Rare Event", "events").alias("rare_events"), pick("Communication Gap", "found_raw").alias("gap_predictions"), pick("Communication Gap", "events").alias("gap_events"))
    x = x.withColumn("m", F.explode("m")).select("m.*", "rare_alarms", "rare_events", "gap_predictions", "gap_events").join(one, F.lit(True))
    tp, fp = F.col("tp"), F.col("fp")
    tnr = F.when(F.col("nominal_ns") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("fp_time_ns") / F.nullif(F.col("nominal_ns"), F.lit(0))))
    x = x.withColumn("fn", F.col("positives") - tp).withColumn("tnr", tnr)
    x = x.withColumn("precision", _ratio(tp, tp + fp) * F.col("tnr")).withColumn("recall", _ratio(tp, F.col("positives")))
    b = beta * beta
    return x.withColumn("f_beta", _ratio((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")))


def f_beta(predictions: DataFrame, rows: DataFrame, low: int, high: int, positive, masked=MASKED, beta: float = 0.5) -> DataFrame:
    """One row: true and false positives, misses, false time, nominal time, corrected precision, recall and F.

    Predictions are cut to ``[low, high]`` and to what the masked categories leave. A positive event counts as
    found when any prediction overlaps it; a prediction is false when it overlaps no label of any category.
    Precision is multiplied by the share of nominal time that is free of false predictions.
    """
    x = _scores(*_by_category(predictions, rows, low, high, masked), {"one": tuple(positive)}, beta)
    return x.select("tp", "fp", "fn", "fp_time_ns", "nominal_ns", "tnr", "precision", "recall", "f_beta")


def modes(predictions: DataFrame, rows: DataFrame, low: int, high: int, beta: float = 0.5) -> DataFrame:
    """A row per mode with all of ``f_beta``, rare and gap alarms, and the burden on operators.

    ``burden_precision`` counts rare alarms among what operators must look at.
    """
    x = _scores(*_by_category(predictions, rows, low, high, MASKED), POSITIVE, beta)
    return x.withColumn("burden_precision", _ratio(F.col("tp"), F.col("tp") + F.col("rare_alarms") + F.col("fp"))).withColumn("rare_alarm_rate", _ratio(F.col("rare_alarms"), F.col("rare_events")))
