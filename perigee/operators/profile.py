"""Profiles of text tables: types, nulls, examples and roles per column."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.functions.text import looks_iso, merged_type, names_time, names_value, role, roles, source_kind, value_type

#: Examples of a column, values of it that are looked at in order, and of those the ones that must look like times.
EXAMPLES, OBSERVED, TIMED = 5, 512, 50


def columns(df: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One row per column: rows, nulls, inferred type, smallest distinct examples and a role.

    Types are grouped before values meet. Examples are the smallest few distinct values; a task keeps that many of
    each column, whatever it reads, and only these are shuffled.
    """
    if examples < 0:
        raise ValueError("examples can't be negative")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in df.columns])).alias("c")
    x = df.select(cells).select("c.column", F.nullif(F.trim("c.text"), F.lit("")).alias("text")).withColumn("kind", value_type("text"))
    kinds = x.groupBy("column", "kind").agg(F.count("*").alias("n"), F.count("text").alias("filled"))
    kinds = kinds.groupBy("column").agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - F.col("filled")).alias("null_count"), F.collect_set("kind").alias("kinds"))
    names = df.columns
    plain = df.select(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(names)])

    def smallest(batches):
        held = [pa.array([], pa.string()) for _ in names]
        for batch in batches:
            for i, values in enumerate(batch.columns):
                values = pa.concat_arrays([pc.unique(values.drop_null()), held[i]])
                held[i] = pc.unique(values).take(pc.array_sort_indices(pc.unique(values))[:examples])
        column = [c for c, v in zip(names, held) for _ in range(len(v))]
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()), pa.concat_arrays(held) if held else pa.array([], pa.string())], ["column", "text"])

    w = Window.partitionBy("column").orderBy("text")
    few = plain.mapInArrow(smallest, "column string, text string").distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= examples)
    few = few.groupBy("column").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    out = kinds.join(few, "column", "left")
    return out.select("column", "row_count", "null_count", merged_type(F.col("kinds")).alias("inferred_type"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), role("column").alias("role"))


def observations(df: DataFrame, order: str, most: int = OBSERVED, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, place, values``: the first filled values of every column, in order. The rank is cut inside each task."""
    names = [c for c in (columns or df.columns) if c != order]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), F.col(c).cast("string").alias("text")) for i, c in enumerate(names)])).alias("c")
    x = df.select(F.col(order).alias("__at"), cells).select("__at", "c.*").where("trim(text) <> ''")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("column", "place").orderBy("__at"))).where(F.col("i") <= most)
    found = x.groupBy("column", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda v: v["text"]).alias("values"))
    every = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(names)], "column string, place int")
    return every.join(found, ["column", "place"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def timestamp_candidates(observed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Columns that may hold times, by name or by their first values: ``column, place, representation, by_name, by_values``.

    ``observed`` comes from ``observations`` and ``kinds`` has ``column, inferred_type``.
    """
    x = observed.join(kinds.select("column", "inferred_type"), "column", "left")
    by_values = (F.size("values") > 0) & F.forall(F.slice("values", 1, TIMED), looks_iso)
    x = x.withColumns({"by_name": names_time("column"), "by_values": by_values}).where("by_name or by_values")
    kind = F.when(F.col("by_values"), "ISO-8601-like string").when(F.col("inferred_type") == "integer", "integer").when(F.col("inferred_type") == "float", "floating-point").otherwise("string")
    return x.select("column", "place", kind.alias("representation"), "by_name", "by_values", "values")


def value_candidates(observed: DataFrame, kinds: DataFrame) -> DataFrame:
    """``column, inferred_type, basis``: columns named like values, else all that can't be times."""
    x = observed.select("column").join(kinds.select("column", "inferred_type"), "column", "left").withColumn("named", names_value("column"))
    times = timestamp_candidates(observed, kinds).select("column", F.lit(True).alias("time"))
    x = x.join(times, "column", "left").withColumn("any", F.max("named").over(Window.partitionBy()))  # one row a column
    return x.where(F.col("named") | ~F.col("any") & F.col("time").isNull()).select("column", "inferred_type", F.when(F.col("any"), "name").otherwise("not a time").alias("basis"))


def sampling_interval(candidates: DataFrame) -> DataFrame:
    """One row on the first candidate: whether its observed times step evenly.

    ``assessment`` is ``uniform``, ``varying`` or, without two steps forward, ``unresolved``; with the step, the
    least and the largest one, their unit and number. Equal is to nine digits.
    """
    first = candidates.agg(F.min_by(F.struct("column", "representation", "values"), "place").alias("f")).select("f.*")
    iso, number = F.col("representation") == "ISO-8601-like string", F.col("representation").isin("integer", "floating-point")
    parsed = F.when(iso, F.transform("values", lambda v: F.unix_micros(F.try_to_timestamp(F.regexp_replace(v, ",", "."))) / 1e6)).when(number, F.transform("values", lambda v: v.try_cast("double")))
    x = first.withColumn("p", F.filter(F.coalesce(parsed, F.array().cast("array<double>")), lambda v: v.isNotNull()))
    n = F.greatest(F.size("p") - 1, F.lit(0))
    x = x.withColumn("d", F.filter(F.zip_with(F.slice("p", F.lit(2), n), F.slice("p", F.lit(1), n), lambda b, a: b - a), lambda v: v > 0))
    even = F.forall("d", lambda v: F.abs(v - F.get("d", 0)) <= F.greatest(F.greatest(F.abs(v), F.abs(F.get("d", 0))) * 1e-9, F.lit(1e-12)))
    known, uniform = F.size("d") >= 2, (F.size("d") >= 2) & even
    return x.select("column", F.when(uniform, "uniform").when(known, "varying").otherwise("unresolved").alias("assessment"), F.when(uniform, F.get("d", 0)).alias("interval"),
                    F.when(known, F.array_min("d")).alias("least"), F.when(known, F.array_max("d")).alias("largest"), F.when(iso, "seconds").when(number, "raw timestamp units").alias("unit"), F.size("d").alias("intervals"))


def delimited(spark: SparkSession, path: str, row_limit: int | None = None, examples: int = EXAMPLES) -> dict[str, DataFrame]:
    """A delimited file of unknown form: ``columns``, ``observed``, ``times``, and one row of ``summary``.

    ``summary`` has the rows read and, where a limit cut them, an estimate of all by the bytes read; rows with
    too few or too many fields, fields beyond the header, and names that stand twice. Missing fields are empty.
    """
    from perigee.sources.archives import fields

    rows, form, size = fields(spark, path, row_limit)
    names, n = form["columns"], len(form["columns"])
    twice = sorted({c for c in names if names.count(c) > 1})
    unique = [c if names.index(c) == i else f"{c}_{i + 1}" for i, c in enumerate(names)]
    table = rows.select("line", *[F.get("fields", i).alias(c) for i, c in enumerate(unique)])
    seen = rows.agg(F.count("*").alias("rows_read"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.size("fields") != n).alias("malformed_rows"), F.coalesce(F.sum(F.greatest(F.size("fields") - n, F.lit(0))), F.lit(0)).alias("extra_fields"))
    cut = F.lit(row_limit is not None) & (F.col("rows_read") >= F.lit(row_limit or 0)) & (F.col("bytes") + form["head_bytes"] < size)
    estimate = F.when(cut & (F.col("bytes") > 0), F.greatest(F.col("rows_read"), F.round(F.col("rows_read") * (size - form["head_bytes"]) / F.col("bytes")).cast("long"))).otherwise(F.col("rows_read"))
    summary = seen.select(F.lit(path).alias("path"), "rows_read", estimate.alias("row_count"), cut.alias("is_estimate"), "malformed_rows", "extra_fields", F.lit(twice).cast("array<string>").alias("duplicate_names"),
                          F.lit(form["delimiter"]).alias("delimiter"), F.lit(form["encoding"]).alias("encoding"), F.lit(form["header"]).alias("header"))
    observed = observations(table, "line")
    kinds = columns(table.drop("line"), examples)
    return {"columns": kinds, "observed": observed, "times": timestamp_candidates(observed, kinds), "summary": summary}


def extension_counts(paths: DataFrame, column: str = "path") -> DataFrame:
    """Files by extension and by first directory."""
    ext = F.lower(F.regexp_extract(column, r"(\.[^./\\]+)$", 1))
    top = F.regexp_extract(column, r"^([^/]+)/", 1)
    return paths.groupBy(F.when(ext == "", "<none>").otherwise(ext).alias("extension"), F.when(top == "", "<root>").otherwise(top).alias("top_level")).agg(F.count("*").alias("file_count"))


def sampling(intervals: DataFrame) -> DataFrame:
    """One row over all channels: whether each is even, and whether all share one step."""
    return intervals.agg(F.count("*").alias("channels"), F.count_if("uniform").alias("uniform_channels"), F.min("min_step_ns").alias("min_step_ns"), F.max("max_step_ns").alias("max_step_ns"),
                         (F.bool_and("uniform") & (F.min("min_step_ns") == F.max("max_step_ns"))).alias("all_equal"))


def _sets(column: str) -> Column:
    return F.sort_array(F.collect_set(column))


def telemetry_summary(entries: DataFrame) -> DataFrame:
    """One row over profiled files: ``path, format, row_count, assessment, interval, unit, missing``.

    Files and rows in total, the least and the most rows of a file, formats, how many sample evenly, unevenly
    or unknown, the distinct even steps, files with missing values, and how the files compare.
    """
    uniform = F.col("assessment") == "uniform"
    steps = F.sort_array(F.collect_set(F.when(uniform & F.col("interval").isNotNull(), F.struct("interval", "unit"))))
    x = entries.agg(
        F.count("*").alias("files"), F.sum("row_count").alias("total_rows"), F.min("row_count").alias("least_rows"), F.max("row_count").alias("most_rows"), _sets("format").alias("formats"),
        F.count_if(uniform).alias("uniform_files"), F.count_if(F.col("assessment") == "varying").alias("varying_files"), F.count_if(F.coalesce(F.col("assessment"), F.lit("unresolved")) == "unresolved").alias("unresolved_files"),
        steps.alias("steps"), F.count_if("missing").alias("files_with_missing"))
    compared = (F.when(F.col("varying_files") > 0, "varying within a file").when(F.size("steps") > 1, "varying between files").when((F.size("steps") == 1) & (F.col("uniform_files") == F.col("files")), "uniform")
                .when(F.size("steps") == 1, "partly measured").otherwise("unresolved"))
    return x.withColumn("comparison", compared)


def command_summary(tables: DataFrame) -> DataFrame:
    """One row over command files ``path, row_count, is_estimate, columns``: a file inside an archive holds executions, others definitions."""
    inside = F.col("path").contains("!")
    priority = F.flatten(F.collect_list(F.when(~inside, F.filter("columns", lambda c: F.arrays_overlap(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit("impact"), F.lit("priority")))))))
    return tables.agg(F.sum(F.when(~inside, F.col("row_count"))).alias("definitions"), F.count_if(inside).alias("execution_files"), F.sum(F.when(inside, F.col("row_count"))).alias("executions"),
                      F.coalesce(F.bool_or(inside & F.col("is_estimate")), F.lit(False)).alias("executions_are_estimate"), F.array_sort(F.array_distinct(priority)).alias("priority_fields"))


def label_fields(observed: DataFrame) -> DataFrame:
    """``column, roles, values``: columns of a label table by role, and the distinct observed values of categories."""
    r = roles("column")
    return observed.select("column", r.alias("roles"), F.when(F.array_contains(r, "category"), F.array_sort(F.array_distinct("values"))).alias("values")).where(F.size("roles") > 0)


def dataset(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: ``path, kind, row_count, column_count, null_count, types, roles, times``.

    Tables are few and each row comes from one pass over its table.
    """
    out = None
    for path, df in sorted(tables.items()):
        k = columns(df, 0)
        x = k.agg(F.max("row_count").alias("row_count"), F.count("*").alias("column_count"), F.sum("null_count").alias("null_count"), _sets("inferred_type").alias("types"), _sets("role").alias("roles"), F.sort_array(F.collect_list(F.when(names_time("column"), F.col("column")))).alias("times"))
        x = x.select(F.lit(path).alias("path"), "row_count", "column_count", "null_count", "types", "roles", "times")
        out = x if out is None else out.unionByName(x)
    return out.select("path", source_kind("path").alias("kind"), *[c for c in out.columns if c != "path"])


def open_questions(profile: DataFrame, telemetry: DataFrame | None = None) -> list[str]:
    """What the structure of a dataset leaves open, by rule."""
    kinds = {r["kind"] for r in profile.select("kind").distinct().collect()}
    out = []
    if "telemetry" not in kinds:
        out.append("no table was recognised as telemetry, so schema, times and sampling are unknown")
    else:
        out += ["time standard and zone of telemetry are not stated by its structure", "missing values other than nulls and NaN can't be told"]
        if telemetry is not None and (telemetry.first()["comparison"] or "").startswith("varying"):
            out.append("why sampling varies is unknown")
    if "telecommands" in kinds:
        out.append("the meaning of command values and priorities is unknown")
    if "labels" in kinds:
        out.append("whether label intervals include their ends, and how rows of many channels relate, is unknown")
    return [*out, "release, licence and origin can't be read off the files"]
