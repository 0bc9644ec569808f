"""Queries on telemetry, labels, commands and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from perigee.functions.clock import SECOND
from perigee.operators import blocks, context, detect, labels, ranges, scoring, series
from perigee.plans import views as v
from perigee.plans.views import HIGH, LOW, SELECTED, TEST, VALIDATION, sql, subtract_sql, union_sql

GAP = 90 * 60 * SECOND


def _ev(s, d):
    return labels.assigned(labels.events(v.label_rows(s, d)), VALIDATION, TEST)


def _scored(s, d, threshold=1.0):
    t = v.telemetry(s, d)
    return detect.score(t, detect.fit_std(t, VALIDATION), threshold)


def _islands(s, d):
    x = _scored(s, d).select("channel", "ts_ns", F.col("alarm").alias("positive"))
    return ranges.islands(x, ["channel"], GAP)


def _predictions(s, d):
    """Windows of half an hour around samples far out, a workload of many short predictions."""
    x = _scored(s, d, 1.7).where("alarm")
    return x.select((F.col("ts_ns") - 900 * SECOND).alias("start_ns"), (F.col("ts_ns") + 900 * SECOND).alias("end_ns"))


def _types(s, d):
    r = v.label_rows(s, d)
    return r.groupBy("event_id").agg(F.min("category").alias("category"), F.min("class").alias("class"))


def _definitions(s, d):
    """Commands by name with a priority; some are never executed."""
    k = F.col("n_nationkey")
    return s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("telecommand_"), k.cast("string")).alias("name"), (k % 4).alias("priority"))


def _window_samples(s, d):
    """Samples of every channel inside every event: how many, the first and the last."""
    ev = _ev(s, d).select("event_id", "start_ns", "end_ns")
    return blocks.extents(_scored(s, d).select("channel", "ts_ns"), ev, ["channel"])


def split_assign(s, d):
    return _ev(s, d).select("event_id", "category", "class", "start_ns", "end_ns", "split", "crosses_validation", "crosses_test")


QUERIES = {
    "x4_split_assign": split_assign,
    "j1_event_table": lambda s, d: labels.event_table(v.label_rows(s, d).drop("category", "class", "is_selected_channel"), _types(s, d), SELECTED),
    "j2_undefined_commands": lambda s, d: labels.undefined_keys(v.commands(s, d), _definitions(s, d).where("priority < 3"), "telecommand", "name"),
    "j2_defined_commands": lambda s, d: labels.many_to_one(v.commands(s, d).drop("priority"), _definitions(s, d), "telecommand", "name", "priority").select("telecommand", "ts_ns", "priority"),
    "j3_execution_counts": lambda s, d: context.execution_counts(v.commands(s, d), "telecommand"),
    "a1_events": lambda s, d: labels.events(v.label_rows(s, d)),
    "a2_channel_counts": lambda s, d: labels.channel_counts(v.label_rows(s, d)),
    "a3_nested_counts": lambda s, d: labels.nested_counts(_ev(s, d)).select("split", "category", "class", "event_count"),
    "a4_split_counts": lambda s, d: labels.split_counts(_ev(s, d)),
    "a5_recurrence": lambda s, d: labels.recurrence(_ev(s, d)),
    "a6_rare_classes": lambda s, d: labels.rare_classes(_ev(s, d)),
    "a7_class_summary": lambda s, d: labels.summary(_ev(s, d)),
    "a8_std_fit": lambda s, d: detect.fit_std(v.telemetry(s, d), VALIDATION).select("channel", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "n"),
    "a9_mad_fit": lambda s, d: detect.fit_mad(v.telemetry(s, d), VALIDATION).select("channel", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "n"),
    "a10_quantiles": lambda s, d: series.quantiles(v.telemetry(s, d)).withColumn("quantile_value", F.round("quantile_value", 6)),
    "a11_series_quality": lambda s, d: series.quality(v.telemetry(s, d)),
    "a12_intervals": lambda s, d: series.intervals(v.telemetry(s, d)),
    "a13_event_quality": lambda s, d: labels.quality(v.label_rows(s, d)),
    "a13_event_quality_by_category": lambda s, d: labels.quality_by_category(v.label_rows(s, d)),
    "a14_command_quality": lambda s, d: context.command_quality(v.commands(s, d), _definitions(s, d).withColumnRenamed("name", "telecommand")),
    "a14_command_streams": lambda s, d: context.command_streams(v.commands(s, d), _definitions(s, d).withColumnRenamed("name", "telecommand")),
    "a14_priority_counts": lambda s, d: context.execution_counts(v.commands(s, d), "priority"),
    "a15_delta_summary": lambda s, d: context.delta_summary(context.nearest_commands(_ev(s, d), v.commands(s, d))),
    "a16_proximity": lambda s, d: context.proximity(_ev(s, d), v.commands(s, d)),
    "a17_priority_totals": lambda s, d: context.priority_counts(_ev(s, d), v.commands(s, d)).groupBy("category", "priority").agg(F.sum("commands").alias("commands"), F.count("*").alias("event_count")),
    "a20_unusualness": lambda s, d: detect.across_channels(_scored(s, d)).withColumn("unusualness", F.round("unusualness", 6)),
    "w1_steps": lambda s, d: series.violations(v.telemetry(s, d)),
    "w2_checked_series": lambda s, d: series.checked(labels.only_channels(v.telemetry(s, d), SELECTED), repeated=True).groupBy("channel").agg(F.count("*").alias("samples"), F.max("ts_ns").alias("last_ns")),
    "w3_islands": _islands,
    "w4_interval_union": lambda s, d: ranges.union(v.label_rows(s, d), ["channel"]),
    "w4_global_union": lambda s, d: ranges.union(v.label_rows(s, d)),
    "w8_stride": lambda s, d: series.stride(v.telemetry(s, d)),
    "w9_leading": lambda s, d: series.leading(v.telemetry(s, d)),
    "i2_subtract": lambda s, d: ranges.subtract(v.label_rows(s, d).where("category <> 'Rare Event'"), v.label_rows(s, d).where("category = 'Rare Event'")),
    "i3_clip": lambda s, d: ranges.clip(v.label_rows(s, d), VALIDATION, TEST, ["channel"]),
    "i4_duration": lambda s, d: ranges.duration(ranges.union(v.label_rows(s, d))),
    "j4_nearest_commands": lambda s, d: context.nearest_commands(_ev(s, d), v.commands(s, d)).select("event_id", "telecommand", "command_ns", "delta_ns"),
    "j5_window_samples": lambda s, d: _window_samples(s, d).select("event_id", "channel", "samples", "first_ns", "last_ns"),
    "j6_detected_events": lambda s, d: ranges.detected_ids(_predictions(s, d), v.label_rows(s, d).where("is_selected_channel")),
    "j7_overlap_flags": lambda s, d: ranges.overlap_flags(ranges.union(_predictions(s, d)), v.label_rows(s, d).where("is_selected_channel")),
    "j8_command_counts": lambda s, d: context.command_counts(_ev(s, d), v.commands(s, d)).select("event_id", "count_5m", "count_30m", "count_2h", "count_24h"),
    "m2_std_alarms": lambda s, d: _scored(s, d, 3.0).groupBy("channel").agg(F.count("*").alias("samples"), F.count_if("alarm").alias("alarms")),
    "m3_mad_alarms": lambda s, d: (lambda t: detect.score(t, detect.fit_mad(t, VALIDATION), 2.0).groupBy("channel").agg(F.count("*").alias("samples"), F.count_if("alarm").alias("alarms")))(v.telemetry(s, d)),
    "m6_event_alarms": lambda s, d: detect.window_alarms(_scored(s, d), _ev(s, d), 1.5),
    "m7_baseline_suite": lambda s, d: detect.suite(v.telemetry(s, d), VALIDATION, GAP),
    "e2_event_f_beta": lambda s, d: scoring.f_beta(_predictions(s, d), v.label_rows(s, d), LOW, HIGH, ("Anomaly", "Rare Event")).select("tp", "fp", "fn", "fp_time_ns", "nominal_ns", *[F.round(c, 6).alias(c) for c in ("tnr", "precision", "recall", "f_beta")]),
    "e3_two_mode_metrics": lambda s, d: scoring.modes(_predictions(s, d), v.label_rows(s, d), LOW, HIGH).select("mode", "tp", "fp", "fn", "fp_time_ns", "nominal_ns", "rare_alarms", "rare_events", "gap_predictions", "gap_events", *[F.round(c, 6).alias(c) for c in ("f_beta", "burden_precision", "rare_alarm_rate")]),
}

_DEFINED = "SELECT 'telecommand_' || n_nationkey AS telecommand, n_nationkey % 4 AS priority FROM nation"
_PRED = "SELECT ts_ns - 900000000000 AS start_ns, ts_ns + 900000000000 AS end_ns FROM scored WHERE score > 1.7"
_SEL = "SELECT event_id, start_ns, end_ns, category FROM label_rows WHERE is_selected_channel"
_CLIP = f"SELECT greatest(start_ns, {LOW}) AS start_ns, least(end_ns, {HIGH}) AS end_ns FROM ({{}}) WHERE end_ns >= {LOW} AND start_ns <= {HIGH}"
_RAW = _CLIP.format(union_sql(_PRED))
_GAPS = f"SELECT * FROM ({_SEL}) WHERE category = 'Communication Gap'"
_POS = "SELECT DISTINCT event_id FROM sel WHERE category IN ({}) AND end_ns >= " + str(LOW) + " AND start_ns <= " + str(HIGH)
_HIT = "SELECT count(DISTINCT s.event_id) AS n FROM sel s JOIN {} k ON k.start_ns <= s.end_ns AND s.start_ns <= k.end_ns WHERE category IN ({})"


def _mode_sql(mode: str, cats: str) -> str:
    return f"""
      SELECT '{mode}' AS mode, (SELECT n FROM ({_HIT.format('kept', cats)})) AS tp,
             (SELECT count(*) FROM kept k WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE k.start_ns <= s.end_ns AND s.start_ns <= k.end_ns)) AS fp,
             (SELECT count(*) FROM ({_POS.format(cats)})) AS positives,
             (SELECT coalesce(sum(end_ns - start_ns), 0) FROM outside)::BIGINT AS fp_time_ns,
             (SELECT coalesce(sum(end_ns - start_ns), 0) FROM nominal)::BIGINT AS nominal_ns"""


_SCORES = """
      SELECT *, positives - tp AS fn, CASE WHEN nominal_ns = 0 THEN 1.0 ELSE greatest(0.0, 1 - fp_time_ns::DOUBLE / nominal_ns) END AS tnr,
             CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS event_precision, CASE WHEN positives > 0 THEN tp::DOUBLE / positives ELSE 0.0 END AS recall
      FROM modes0"""
_CORRECT = "SELECT *, event_precision * tnr AS precision, CASE WHEN 0.25 * event_precision * tnr + recall > 0 THEN 1.25 * event_precision * tnr * recall / (0.25 * event_precision * tnr + recall) ELSE 0.0 END AS f_beta FROM scores"


def _score_sql(modes0: str, body: str) -> str:
    return sql(body, "label_rows", "scored", sel=_SEL, raw=_RAW, kept=subtract_sql("SELECT * FROM raw", _GAPS), outside=subtract_sql("SELECT start_ns, end_ns FROM kept", "SELECT start_ns, end_ns FROM sel"),
               nominal=subtract_sql(f"SELECT {LOW}::BIGINT AS start_ns, {HIGH}::BIGINT AS end_ns", "SELECT start_ns, end_ns FROM sel"), modes0=modes0, scores=_SCORES, correct=_CORRECT)


_W = {"5m": 300, "30m": 1800, "2h": 7200, "24h": 86400}
_COUNTS = "SELECT e.event_id, any_value(e.category) AS category, " + ", ".join(f"count(CASE WHEN c.ts_ns >= e.start_ns - {s}000000000 THEN 1 END) AS count_{k}" for k, s in _W.items()) + " FROM ev e LEFT JOIN commands c ON c.ts_ns <= e.start_ns AND c.ts_ns >= e.start_ns - 86400000000000 GROUP BY e.event_id"
_NEAR = """
      SELECT e.event_id, e.category, c.telecommand, c.ts_ns AS command_ns, e.start_ns - c.ts_ns AS delta_ns
      FROM ev e LEFT JOIN commands c ON c.ts_ns <= e.start_ns
      QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY c.ts_ns DESC NULLS LAST, c.telecommand DESC, c.priority DESC) = 1"""
_ISLANDS = f"""
      SELECT channel, min(ts_ns) AS start_ns, greatest(min(ts_ns), least(coalesce(arg_max(after, ts_ns), max(ts_ns)), max(ts_ns) + {GAP})) AS end_ns FROM (
        SELECT *, sum(CASE WHEN before_p AND ts_ns - before_t <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
          SELECT channel, ts_ns, p, lag(p) OVER w AS before_p, lag(ts_ns) OVER w AS before_t, coalesce(lead(ts_ns) OVER w - 1, ts_ns) AS after
          FROM (SELECT channel, ts_ns, score > 1.0 AS p FROM scored) x WINDOW w AS (PARTITION BY channel ORDER BY ts_ns)) y WHERE p) z
      GROUP BY channel, g"""
_SPLITS = "count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test"
_RECUR = f"SELECT category, class, count(*) AS event_count, arg_min(event_id, (start_ns, event_id)) AS first_event_id, min(start_ns) AS first_start_ns, arg_min(split, (start_ns, event_id)) AS first_split, count(*) - 1 AS later_count, {_SPLITS} FROM assigned GROUP BY category, class"
_WINDOWED = "SELECT s.channel, s.ts_ns, s.value, s.score, e.event_id FROM scored s JOIN ev e ON s.ts_ns BETWEEN e.start_ns AND e.end_ns"

ORACLES = {
    "x4_split_assign": sql("SELECT event_id, category, class, start_ns, end_ns, split, crosses_validation, crosses_test FROM assigned", "assigned"),
    "j1_event_table": sql("""
        SELECT event_id, channel, start_ns, end_ns, category, class, selected_channels, all_channels, is_selected_channel, all_channels > 1 AS multichannel, end_ns - start_ns AS duration_ns
        FROM label_rows JOIN counts USING (event_id) WHERE selected_channels > 0""", "label_rows", counts="SELECT event_id, count(DISTINCT CASE WHEN is_selected_channel THEN channel END) AS selected_channels, count(DISTINCT channel) AS all_channels FROM label_rows GROUP BY event_id"),
    "j2_undefined_commands": sql("SELECT DISTINCT telecommand FROM commands WHERE telecommand NOT IN (SELECT telecommand FROM definitions WHERE priority < 3)", "commands", definitions=_DEFINED),
    "j2_defined_commands": sql("SELECT c.telecommand, c.ts_ns, d.priority FROM commands c LEFT JOIN definitions d ON c.telecommand = d.telecommand", "commands", definitions=_DEFINED),
    "j3_execution_counts": sql("SELECT telecommand, count(*) AS executions, count(DISTINCT telecommand) AS telecommands, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM commands GROUP BY telecommand", "commands"),
    "a1_events": sql("SELECT * FROM ev", "ev"),
    "a2_channel_counts": sql("SELECT event_id, count(DISTINCT CASE WHEN is_selected_channel THEN channel END) AS selected_channels, count(DISTINCT channel) AS all_channels FROM label_rows GROUP BY event_id", "label_rows"),
    "a3_nested_counts": sql("SELECT split, category, class, count(*) AS event_count FROM assigned GROUP BY GROUPING SETS ((split), (split, category), (split, category, class))", "assigned"),
    "a4_split_counts": sql(f"SELECT category, {_SPLITS} FROM assigned GROUP BY category", "assigned"),
    "a5_recurrence": sql(_RECUR, "assigned"),
    "a6_rare_classes": sql("SELECT class, event_count > 1 AS recurrent, first_split = 'train' AND validation + test > 0 AS train_then_later, test > 0 AND train + validation = 0 AS unseen_in_test FROM recur WHERE category = 'Rare Event'", "assigned", recur=_RECUR),
    "a7_class_summary": sql("SELECT category, class, event_count, train + validation > 0 AS observed_before_test, train + validation > 0 AND test > 0 AS repeated_in_test FROM recur", "assigned", recur=_RECUR),
    "a8_std_fit": sql("SELECT channel, round(center, 6) AS center, round(scale, 6) AS scale, n FROM std_fit", "std_fit"),
    "a9_mad_fit": sql("SELECT channel, round(center, 6) AS center, round(scale, 6) AS scale, n FROM mad_fit", "mad_fit"),
    "a10_quantiles": sql("SELECT channel, point::DOUBLE AS point, round(list_extract(q, i), 6) AS quantile_value FROM (SELECT channel, quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM telemetry WHERE isfinite(value) GROUP BY channel) x, (VALUES (1, 0.0), (2, 0.25), (3, 0.5), (4, 0.75), (5, 1.0)) p(i, point)", "telemetry"),
    "a11_series_quality": sql("""
        SELECT channel, count(*) AS sample_count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(ts_ns) - count(DISTINCT ts_ns) AS duplicate_timestamps,
               count(*) FILTER (value IS NULL OR isnan(value)) AS nan_count, count(*) FILTER (value = 'inf'::DOUBLE) AS positive_infinities, count(*) FILTER (value = '-inf'::DOUBLE) AS negative_infinities,
               count(*) FILTER (isfinite(value)) AS finite_count, count(DISTINCT value) FILTER (isfinite(value)) AS distinct_finite, round(avg(value) FILTER (isfinite(value)), 6) AS mean, round(stddev_pop(value) FILTER (isfinite(value)), 6) AS std
        FROM telemetry GROUP BY channel""", "telemetry"),
    "a12_intervals": sql("""
        SELECT channel, sum(n)::BIGINT AS interval_count, count(*) AS distinct_intervals, min(step) AS min_step_ns, max(step) AS max_step_ns, arg_min(step, (-n, step)) AS mode_step_ns, count(*) = 1 AS uniform
        FROM (SELECT channel, step, count(*) AS n FROM (SELECT channel, ts_ns - lag(ts_ns) OVER (PARTITION BY channel ORDER BY ts_ns) AS step FROM telemetry) x WHERE step IS NOT NULL GROUP BY channel, step) y GROUP BY channel""", "telemetry"),
    "a13_event_quality": sql("""
        SELECT count(*) AS row_count, count(DISTINCT event_id) AS event_count, min(start_ns) AS first_start_ns, max(end_ns) AS last_end_ns, count(*) FILTER (is_selected_channel) AS selected_rows,
               min(end_ns - start_ns) AS min_duration_ns, floor(median(end_ns - start_ns))::BIGINT AS median_duration_ns, max(end_ns - start_ns) AS max_duration_ns, count(*) FILTER (end_ns = start_ns) AS zero_durations,
               count(*) FILTER (category IS NULL) AS null_categories, count(*) FILTER (class IS NULL) AS null_classes FROM label_rows""", "label_rows"),
    "a13_event_quality_by_category": sql("SELECT category, count(*) AS row_count, count(DISTINCT event_id) AS event_count FROM label_rows GROUP BY category", "label_rows"),
    "a14_command_quality": sql("SELECT count(DISTINCT d.telecommand) AS definitions, count(c.ts_ns) AS executions, count(DISTINCT CASE WHEN c.ts_ns IS NULL THEN d.telecommand END) AS empty_streams, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM definitions d LEFT JOIN commands c ON c.telecommand = d.telecommand", "commands", definitions=_DEFINED),
    "a14_command_streams": sql("SELECT d.telecommand, any_value(d.priority) AS priority, count(c.ts_ns) AS executions, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM definitions d LEFT JOIN commands c ON c.telecommand = d.telecommand GROUP BY d.telecommand", "commands", definitions=_DEFINED),
    "a14_priority_counts": sql("SELECT priority, count(*) AS executions, count(DISTINCT telecommand) AS telecommands, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM commands GROUP BY priority", "commands"),
    "a15_delta_summary": sql("SELECT category, count(*) AS event_count, count(delta_ns) AS with_command, round(min(delta_ns / 1e9), 6) AS min_s, round(median(delta_ns / 1e9), 6) AS median_s, round(sum(delta_ns)::DOUBLE / count(delta_ns) / 1e9, 6) AS mean_s, round(max(delta_ns / 1e9), 6) AS max_s FROM near GROUP BY category", "ev", "commands", near=_NEAR),
    "a16_proximity": sql(" UNION ALL ".join(f"SELECT category, '{k}' AS \"window\", count(*) AS event_count, count(*) FILTER (count_{k} > 0) AS with_command, round(count(*) FILTER (count_{k} > 0) / count(*)::DOUBLE, 6) AS rate FROM counts GROUP BY category" for k in _W), "ev", "commands", counts=_COUNTS),
    "a17_priority_totals": sql("""
        SELECT category, priority, sum(n)::BIGINT AS commands, count(*) AS event_count FROM (
          SELECT e.event_id, e.category, c.priority, count(*) AS n FROM ev e JOIN commands c ON c.ts_ns <= e.start_ns AND c.ts_ns >= e.start_ns - 86400000000000 GROUP BY e.event_id, e.category, c.priority) x
        GROUP BY category, priority""", "ev", "commands"),
    "a20_unusualness": sql("SELECT ts_ns, round(sqrt(avg(score * score)), 6) AS unusualness, bool_or(score > 1.0) AS alarm FROM scored GROUP BY ts_ns", "scored"),
    "w1_steps": sql("SELECT channel, count(*) FILTER (step <= 0) AS not_increasing FROM (SELECT channel, ts_ns - lag(ts_ns) OVER (PARTITION BY channel ORDER BY ts_ns) AS step FROM telemetry) x GROUP BY channel", "telemetry"),
    "w2_checked_series": sql("SELECT channel, count(*) AS samples, max(ts_ns) AS last_ns FROM telemetry GROUP BY channel", "telemetry"),
    "w3_islands": sql(_ISLANDS, "scored"),
    "w4_interval_union": sql(union_sql("SELECT * FROM label_rows", ("channel",)), "label_rows"),
    "w4_global_union": sql(union_sql("SELECT * FROM label_rows"), "label_rows"),
    "w8_stride": sql("SELECT channel, ts_ns, value FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_ns) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM telemetry) x WHERE n <= 80 OR i % (n // 80) = 0", "telemetry"),
    "w9_leading": sql("SELECT channel, ts_ns, value FROM telemetry QUALIFY row_number() OVER (PARTITION BY channel ORDER BY ts_ns) <= 10", "telemetry"),
    "i2_subtract": sql(subtract_sql("SELECT * FROM label_rows WHERE category <> 'Rare Event'", "SELECT * FROM label_rows WHERE category = 'Rare Event'"), "label_rows"),
    "i3_clip": sql(f"SELECT channel, greatest(start_ns, {VALIDATION}) AS start_ns, least(end_ns, {TEST}) AS end_ns FROM ({union_sql('SELECT * FROM label_rows', ('channel',))}) u WHERE end_ns >= {VALIDATION} AND start_ns <= {TEST}", "label_rows"),
    "i4_duration": sql(f"SELECT sum(end_ns - start_ns)::BIGINT AS duration_ns FROM ({union_sql('SELECT * FROM label_rows')}) u", "label_rows"),
    "j4_nearest_commands": sql("SELECT event_id, telecommand, command_ns, delta_ns FROM near", "ev", "commands", near=_NEAR),
    "j5_window_samples": sql("SELECT event_id, channel, count(*) AS samples, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM windowed GROUP BY event_id, channel", "ev", "scored", windowed=_WINDOWED),
    "j6_detected_events": sql(f"SELECT DISTINCT s.event_id FROM label_rows s JOIN ({_PRED}) k ON k.start_ns <= s.end_ns AND s.start_ns <= k.end_ns WHERE is_selected_channel", "label_rows", "scored"),
    "j7_overlap_flags": sql(f"SELECT k.*, EXISTS (SELECT 1 FROM label_rows s WHERE is_selected_channel AND k.start_ns <= s.end_ns AND s.start_ns <= k.end_ns) AS overlaps FROM ({union_sql(_PRED)}) k", "label_rows", "scored"),
    "j8_command_counts": sql("SELECT event_id, count_5m, count_30m, count_2h, count_24h FROM counts", "ev", "commands", counts=_COUNTS),
    "m2_std_alarms": sql("SELECT channel, count(*) AS samples, count(*) FILTER (score > 3.0) AS alarms FROM scored GROUP BY channel", "scored"),
    "m3_mad_alarms": sql("SELECT t.channel, count(*) AS samples, count(*) FILTER (abs(value - center) / scale > 2.0) AS alarms FROM telemetry t JOIN mad_fit f ON t.channel = f.channel GROUP BY t.channel", "mad_fit"),
    "m6_event_alarms": sql("SELECT event_id, bool_or(score > 1.5) AS alarm FROM windowed GROUP BY event_id", "ev", "scored", windowed=_WINDOWED),
    "m7_baseline_suite": sql(f"""
        SELECT baseline, sum(n)::BIGINT AS alarms, count(*) FILTER (n > 0) AS alarm_times, count(*) FILTER (n > 0 AND coalesce(NOT before_on OR ts_ns - before_ns > {GAP}, true)) AS windows
        FROM (SELECT *, lag(n > 0) OVER w AS before_on, lag(ts_ns) OVER w AS before_ns FROM per WINDOW w AS (PARTITION BY baseline ORDER BY ts_ns)) GROUP BY baseline""", "scored", "mad_fit",
        far="SELECT ts_ns, score, 0.0 AS mad FROM scored UNION ALL SELECT ts_ns, 0.0, abs(value - center) / scale FROM telemetry t JOIN mad_fit f ON t.channel = f.channel",
        per="SELECT b.baseline, ts_ns, count(*) FILTER (score > std OR mad > dev) AS n FROM far, (VALUES ('no_alarm', 1e9, 1e9), ('std3', 3.0, 1e9), ('std5', 5.0, 1e9), ('mad5', 1e9, 5.0)) b(baseline, std, dev) GROUP BY b.baseline, ts_ns"),
    "e2_event_f_beta": _score_sql(_mode_sql("unusual", "'Anomaly', 'Rare Event'"), "SELECT tp, fp, fn, fp_time_ns, nominal_ns, round(tnr, 6) AS tnr, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_beta, 6) AS f_beta FROM correct"),
    "e3_two_mode_metrics": _score_sql(_mode_sql("unusual", "'Anomaly', 'Rare Event'") + " UNION ALL " + _mode_sql("operational", "'Anomaly'"), f"""
        SELECT mode, tp, fp, fn, fp_time_ns, nominal_ns, rare_alarms, rare_events, gap_predictions, gap_events, round(f_beta, 6) AS f_beta,
               round(CASE WHEN tp + rare_alarms + fp > 0 THEN tp::DOUBLE / (tp + rare_alarms + fp) ELSE 0.0 END, 6) AS burden_precision, round(CASE WHEN rare_events > 0 THEN rare_alarms::DOUBLE / rare_events ELSE 0.0 END, 6) AS rare_alarm_rate
        FROM correct, (SELECT n AS rare_alarms FROM ({_HIT.format('kept', "'Rare Event'")})) a, (SELECT count(*) AS rare_events FROM ({_POS.format("'Rare Event'")})) b,
             (SELECT n AS gap_predictions FROM ({_HIT.format('raw', "'Communication Gap'")})) c, (SELECT count(*) AS gap_events FROM ({_POS.format("'Communication Gap'")})) g"""),
}
