"""Telemetry, labels, commands, catalog and observations derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions.clock import SECOND, ns

#: 2024-01-16 and 2024-01-21, and the evaluated range 2024-01-01 to 2024-02-01.
VALIDATION, TEST = 1_705_363_200 * SECOND, 1_705_795_200 * SECOND
LOW, HIGH = 1_704_067_200 * SECOND, 1_706_745_600 * SECOND
SELECTED = [f"channel_{i}" for i in range(41, 47)]


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts_ns", ns("ts"))


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    channel = F.concat(F.lit("channel_"), (F.lit(41) + F.col("user_id") % 6).cast("string"))
    return events(spark, d).select(channel.alias("channel"), "ts_ns", "value")


def commands(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("telecommand_"), (F.col("user_id") % 20).cast("string"))
    return events(spark, d).where("event_type = 'click'").select(name.alias("telecommand"), "ts_ns", (F.col("event_id") % 4).alias("priority"))


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'error' and value > 80")
    number = F.col("event_id")
    category = F.when(number % 10 < 5, "Anomaly").when(number % 10 < 9, "Rare Event").otherwise("Communication Gap")
    channel = F.explode(F.array(41 + number % 6, 41 + (number + 1) % 6, F.lit(9).cast("long"))).alias("c")
    x = e.select(F.concat(F.lit("id_"), number.cast("string")).alias("event_id"), channel, F.col("ts_ns").alias("start_ns"),
                 (F.col("ts_ns") + F.floor(F.col("value") * 60) * SECOND).alias("end_ns"), category.alias("category"), F.concat(F.lit("class_"), (number % 7).cast("string")).alias("class"))
    return x.withColumn("channel", F.concat(F.lit("channel_"), F.col("c").cast("string"))).withColumn("is_selected_channel", F.col("c") >= 41).drop("c")


SQL = {
    "telemetry": "SELECT 'channel_' || (41 + user_id % 6) AS channel, epoch_us(ts) * 1000 AS ts_ns, value FROM events",
    "commands": "SELECT 'telecommand_' || (user_id % 20) AS telecommand, epoch_us(ts) * 1000 AS ts_ns, event_id % 4 AS priority FROM events WHERE event_type = 'click'",
    "label_rows": """
      SELECT 'id_' || event_id AS event_id, 'channel_' || c AS channel, epoch_us(ts) * 1000 AS start_ns,
             epoch_us(ts) * 1000 + floor(value * 60)::BIGINT * 1000000000 AS end_ns,
             CASE WHEN event_id % 10 < 5 THEN 'Anomaly' WHEN event_id % 10 < 9 THEN 'Rare Event' ELSE 'Communication Gap' END AS category,
             'class_' || (event_id % 7) AS class, c >= 41 AS is_selected_channel
      FROM (SELECT *, unnest([41 + event_id % 6, 41 + (event_id + 1) % 6, 9]) AS c FROM events WHERE event_type = 'error' AND value > 80)""",
    "ev": """
      SELECT event_id, min(category) AS category, min(class) AS class, min(start_ns) AS start_ns, max(end_ns) AS end_ns
      FROM label_rows WHERE is_selected_channel GROUP BY event_id""",
    "assigned": f"""
      SELECT *, CASE WHEN start_ns <= {VALIDATION} THEN 'train' WHEN start_ns <= {TEST} THEN 'validation' ELSE 'test' END AS split,
             start_ns <= {VALIDATION} AND end_ns > {VALIDATION} AS crosses_validation, start_ns <= {TEST} AND end_ns > {TEST} AS crosses_test
      FROM ev""",
    "std_fit": f"""
      SELECT channel, avg(value) AS center, stddev_pop(value) AS scale, count(*) AS n FROM telemetry
      WHERE ts_ns <= {VALIDATION} AND isfinite(value) GROUP BY channel""",
    "med": f"SELECT channel, median(value) AS center FROM telemetry WHERE ts_ns <= {VALIDATION} AND isfinite(value) GROUP BY channel",
    "mad_fit": f"""
      SELECT t.channel, any_value(center) AS center, median(abs(value - center)) * 1.4826 AS scale, count(*) AS n
      FROM telemetry t JOIN med ON t.channel = med.channel WHERE ts_ns <= {VALIDATION} AND isfinite(value) GROUP BY t.channel""",
    "scored": """
      SELECT t.*, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0.0 WHEN scale = 0 THEN CASE WHEN value <> center THEN 10.0 ELSE 0.0 END
                       ELSE abs(value - center) / scale END AS score
      FROM telemetry t JOIN std_fit f ON t.channel = f.channel""",
}


def union_sql(source: str, keys: tuple[str, ...] = ()) -> str:
    """SQL of the union of closed intervals of a source per key."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    names = "".join(f"{k}, " for k in keys)
    return f"""SELECT {names}min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM (
      SELECT *, sum(fresh) OVER ({part} ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
        SELECT *, CASE WHEN start_ns <= 1 + max(end_ns) OVER ({part} ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM (SELECT DISTINCT {names}start_ns, end_ns FROM ({source}) s) x) y) z GROUP BY {names}g"""


def subtract_sql(source: str, masks: str) -> str:
    """SQL of the union of a source less the union of masks."""
    return union_sql(f"""
      SELECT s AS start_ns, e AS end_ns FROM (
        SELECT coalesce(lag(m.end_ns) OVER w + 1, x.start_ns) AS s, m.start_ns - 1 AS e
        FROM ({union_sql(source)}) x JOIN ({union_sql(masks)}) m ON m.start_ns <= x.end_ns AND x.start_ns <= m.end_ns
        WINDOW w AS (PARTITION BY x.start_ns, x.end_ns ORDER BY m.start_ns)
        UNION ALL
        SELECT coalesce(max(m.end_ns) + 1, x.start_ns), x.end_ns
        FROM ({union_sql(source)}) x LEFT JOIN ({union_sql(masks)}) m ON m.start_ns <= x.end_ns AND x.start_ns <= m.end_ns
        GROUP BY x.start_ns, x.end_ns) f
      WHERE s <= e""")


def sql(body: str, *names: str, **more: str) -> str:
    """A statement over named views, in order, with further ones of its own."""
    needs = {"ev": ("label_rows",), "assigned": ("label_rows", "ev"), "std_fit": ("telemetry",), "med": ("telemetry",), "mad_fit": ("telemetry", "med"), "scored": ("telemetry", "std_fit")}
    order: list[str] = []
    for n in names:
        for k in (*needs.get(n, ()), n):
            if k not in order:
                order.append(k)
    ctes = [f"{k} AS ({SQL[k]})" for k in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(ctes)} {body}"
