"""Tables of telemetry, commands, labels and catalogs: checked readers and writers."""

from __future__ import annotations

import hashlib
import json
import math
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TELEMETRY = "channel string, ts_ns long, value float"
COMMANDS = "telecommand string, ts_ns long, execution_value short, priority short"
ELEMENTS = ("OBJECT_NAME string, NORAD_CAT_ID string, OBJECT_ID string, EPOCH string, MEAN_MOTION string, ECCENTRICITY string, INCLINATION string, "
            "RA_OF_ASC_NODE string, ARG_OF_PERICENTER string, MEAN_ANOMALY string, BSTAR string")


#: Begins the message of a job that meets a command without one definition.
UNDEFINED = "no single definition of command "


class SchemaError(ValueError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a local master gets a temporary folder; on a cluster, whose executors couldn't read
    it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet into the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table, columns pruned at the scan. Nanosecond timestamps arrive as LONG."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def require(df: DataFrame, schema: str) -> DataFrame:
    """The frame, if its columns are just those of the schema, in name and type."""
    want = StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    if {f.name: f.dataType for f in want} != have:
        raise SchemaError(f"expected {want.simpleString()}, got {df.schema.simpleString()}")
    return df


def write_telemetry(df: DataFrame, path: str, rows_a_file: int = 10_000_000, rows_a_group: int = 1_000_000) -> dict[str, int]:
    """Telemetry by channel, sorted by time inside files so that row-group statistics prune; NaN becomes null.

    Files are cut by rows, so a channel with most samples is written by many tasks; row groups too. Times and
    values aren't dictionary-coded. Returns ``rows`` and ``nulls``, counted by the job that writes.
    """
    x = require(df, TELEMETRY).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    seen = Observation()
    x = x.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"))
    x = x.repartition("channel", F.floor(F.col("ts_ns") / F.lit(86_400_000_000_000))).sortWithinPartitions("channel", "ts_ns")
    w = x.write.partitionBy("channel").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).option("parquet.block.row.count.limit", rows_a_group)
    for c in ("ts_ns", "value"):
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    w.mode("errorifexists").parquet(path)
    return {k: seen.get[k] for k in ("rows", "nulls")}


def write_commands(executions: DataFrame, definitions: DataFrame, path: str) -> int:
    """Commands with the priority of their definition, sorted by time; returns the rows, refuses undefined ones.

    One job: an execution without a definition ends it, and nothing is left at the path; rows are counted as
    they are written. A definition that stands more than once multiplies no row: it ends the job too.
    """
    known = definitions.groupBy("telecommand").agg(F.first("priority").alias("priority"), F.count("*").alias("__n"))
    wrong = F.concat(F.lit(UNDEFINED), F.coalesce(F.col("telecommand"), F.lit("null")))
    x = executions.join(known, "telecommand", "left")
    x = x.withColumn("priority", F.when(F.coalesce("__n", F.lit(0)) == 1, F.col("priority").cast("short")).otherwise(F.raise_error(wrong).cast("short")))
    x = x.select("telecommand", F.col("ts_ns").cast("long").alias("ts_ns"), F.col("execution_value").cast("short").alias("execution_value"), "priority")
    seen = Observation()
    # counted after the exchange, which a range partitioning's sampling passes over as well
    x = x.repartitionByRange("ts_ns").sortWithinPartitions("ts_ns").observe(seen, F.count("*").alias("rows"))
    try:
        x.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    except PySparkException as e:
        if UNDEFINED in str(e):
            raise SchemaError("executions without one definition") from e
        raise
    return seen.get["rows"]


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated text with a header; a byte order mark before the first name is dropped."""
    r = spark.read.option("header", True).option("mode", "FAILFAST" if schema else "PERMISSIVE")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))


def load_counts(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """One row on a catalog file: records read, accepted and rejected ones, and objects after the last of each id; one pass."""
    good = F.col("accepted")
    x = _elements(spark, path, most).withColumn("accepted", good & (F.col("object_id") > 0))
    return x.agg(F.count("*").alias("records"), F.count_if(good).alias("accepted"), (F.count("*") - F.count_if(good)).alias("rejected"), F.count_distinct(F.when(good, F.col("object_id"))).alias("objects"))


def read_elements(spark: SparkSession, path: str, most: int = 500, seen: Observation | None = None) -> DataFrame:
    """A catalog of orbital elements from JSON: the first records, valid ids, the last of each id.

    A record with a field that can't be read is left out on its own; the rest stays. ``seen``, where given, gets
    ``records`` and ``accepted`` of whatever job reads the catalog.
    """
    from perigee.operators.orbit import deduplicated

    x = _elements(spark, path, most)
    if seen is not None:
        x = x.observe(seen, F.count("*").alias("records"), F.count_if("accepted").alias("accepted"))
    return deduplicated(x.where("accepted").drop("accepted"))


def _elements(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The first records of a catalog, and whether each has all it needs."""
    raw = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    x = raw.withColumn("ordinal", F.monotonically_increasing_id()).orderBy("ordinal").limit(most)
    d = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.when(F.col(c).isNull(), F.lit(default)))
    from perigee.functions.clock import parse_ns

    x = x.select(F.col("NORAD_CAT_ID").try_cast("long").alias("object_id"), F.coalesce("OBJECT_NAME", F.lit("UNKNOWN")).alias("name"), F.col("OBJECT_ID").alias("alt_id"), parse_ns("EPOCH").alias("epoch_ns"),
                 d("MEAN_MOTION", 15.0).alias("mean_motion"), d("ECCENTRICITY", 0.0005).alias("eccentricity"), d("INCLINATION", 51.64).alias("inclination"), d("RA_OF_ASC_NODE", 0.0).alias("raan"),
                 d("ARG_OF_PERICENTER", 0.0).alias("arg_perigee"), d("MEAN_ANOMALY", 0.0).alias("mean_anomaly"), d("BSTAR", 0.00001).alias("bstar"), "ordinal")
    needs = ("object_id", "mean_motion", "eccentricity", "inclination", "raan", "arg_perigee", "mean_anomaly", "bstar")
    return x.withColumn("accepted", F.forall(F.array(*[F.col(c).isNotNull() for c in needs]), lambda v: v))


def freshest(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first tier that has the key: live before cached before stale."""
    both = None
    for i, t in enumerate(tiers):
        x = t.withColumn("tier", F.lit(i))
        both = x if both is None else both.unionByName(x)
    row = F.struct(*[c for c in both.columns if c != key])
    return both.groupBy(key).agg(F.min_by(row, "tier").alias("r")).select(key, "r.*")


def canonical_json(value: Any) -> str:
    """Sorted keys, NaN as null, a newline at the end."""
    def clean(v: Any) -> Any:
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, (list, tuple, set)) else v

    return json.dumps(clean(value), sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def write_json(value: Any, path: str) -> None:
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(canonical_json(value), encoding="utf-8")
    part.replace(target)


def identity(config: dict) -> str:
    """Digest of a configuration, whatever the order of its keys."""
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def content_digest(df: DataFrame) -> dict[str, Any]:
    """Rows and an order-free digest of a frame's content, in one pass."""
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return {"rows": r["n"], "digest": f"{(r['x'] or 0) & (1 << 64) - 1:016x}-{int(r['s'] or 0) & (1 << 64) - 1:016x}", "columns": df.schema.simpleString()}


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256, MD5 and CRC-32 of every file below a path."""
    from perigee.functions.text import digests

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", *[c.alias(k) for k, c in digests(F.col("content")).items()])


def seconds(value_ns: int | None) -> str:
    """Nanoseconds as seconds with six decimals, N/A where missing."""
    return "N/A" if value_ns is None else f"{value_ns / 1e9:.6f}"


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; missing numbers are N/A. More than ``most`` rows are an error, not a cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    body = ["| " + " | ".join("N/A" if v is None else str(v) for v in r) + " |" for r in got]
    return "\n".join([f"# {title}", "", head, *body, ""])
