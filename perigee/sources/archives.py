"""Archives and delimited files of unknown form."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.sources.zips import MEMBERS, MemberReader, _batch, read_members

DELIMITERS = (",", "\t", ";", "|")
#: Words of header names. Fixed values.
HEADERS = frozenset("category channel class description end endtime id identifier name priority start starttime subclass telecommand time timestamp value".split())
SAMPLE = 64 * 1024


def members(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Members of all ZIP files below a path, nested ones too: ``path, member, depth, size, packed_size, crc32``.

    The data source ``perigee_zip`` cuts large archives into ranges of members, a task each. Stores that Arrow
    can't open are read through Spark's reader, whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    first = files.select("path").first()
    names = ["path", "member", "depth", "size", "packed_size", "crc32"]
    if first is None or first["path"].split(":", 1)[0] in ("file", "hdfs", "s3", "gs"):
        return read_members(spark, path, pattern.lstrip("*").lower()).where("not directory").select(*names)

    def by_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = MemberReader({"path": path})
        for batch in batches:
            for p, data in zip(*batch.columns):
                yield _batch(list(reader._walk(io.BytesIO(data.as_py()), p.as_py(), "", 0)))

    return files.select("path", "content").mapInArrow(by_content, MEMBERS).where("not directory").select(*names)


def summary(found: DataFrame) -> DataFrame:
    """One row an archive of ``members``: files, nested archives, bytes packed and unpacked, and files by extension."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split("member", "[/!]"), -1), r".(\.[^.]+)$", 1))
    x = found.withColumn("ext", F.when(ext == "", "<none>").otherwise(ext)).groupBy("path", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.when(F.col("depth") == 0, F.col("packed_size")).otherwise(0)).alias("packed"))
    return x.groupBy("path").agg(F.sum("n").alias("members"), F.coalesce(F.sum(F.when(F.col("ext") == ".zip", F.col("n"))), F.lit(0)).alias("archives"), F.sum("size").alias("size"), F.sum("packed").alias("packed_size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))


def sniff(sample: bytes) -> dict:
    """Encoding, delimiter and whether a header stands, from the first bytes of a file."""
    try:
        text, encoding = sample.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError as e:
        if len(sample) == SAMPLE and e.start >= len(sample) - 4:  # cut inside a character
            text, encoding = sample[: e.start].decode("utf-8-sig"), "UTF-8"
        else:
            text, encoding = sample.decode("cp1252", "replace"), "windows-1252"
    lines = [x for x in text.splitlines() if x.strip()][:50]
    score = {d: (min(x.count(d) for x in lines), sum(x.count(d) for x in lines)) for d in DELIMITERS} if lines else {}
    best = max(DELIMITERS, key=lambda d: score.get(d, (0, 0))) if lines else ","
    first = [c.strip().strip('"') for c in lines[0].split(best)] if lines else []
    words = {w for c in first for w in re.findall("[a-z0-9]+", c.lower())}
    named = bool(words & HEADERS) or bool(first) and all(c and not c[0].isdigit() and c[0] not in "+-." for c in first)
    return {"encoding": encoding, "delimiter": best, "header": named, "columns": first if named else [f"column_{i + 1}" for i in range(len(first))]}


def head(spark: SparkSession, path: str, size: int = SAMPLE) -> tuple[bytes, int]:
    """The first bytes of a file, through the store's own reader, and its length; of a folder its first file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = store.getFileStatus(p)
    if status.isDirectory():
        inside = sorted((s for s in store.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda s: s.getPath().getName())
        if not inside:
            return b"", 0
        status = inside[0]
    stream = store.open(status.getPath())
    try:
        return bytes(stream.readNBytes(size)), status.getLen()
    finally:
        stream.close()


def fields(spark: SparkSession, path: str, row_limit: int | None = None) -> tuple[DataFrame, dict, int]:
    """Rows of a delimited file as ``line, fields, bytes`` without the header, its form, and its length in bytes.

    Lines keep their order in ``line``. With a limit only the first rows are kept.
    """
    sample, size = head(spark, path)
    form = sniff(sample)
    skip = int(form["header"])
    form["head_bytes"] = sample.find(b"\n") + 1 if skip else 0
    encoding = "utf-8-sig" if form["encoding"] == "UTF-8" else "cp1252"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            got = [next(csv.reader([b.decode(encoding, "replace").rstrip("\r")], delimiter=form["delimiter"]), []) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.string())), pa.array([len(b) + 1 for b in raw], pa.int64())], ["line", "fields", "bytes"])

    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("raw")).where(F.col("line") >= skip)
    if row_limit is not None:
        x = x.where(F.col("line") < row_limit + skip)  # lines of the first split are numbered one by one
    return x.where(F.length("raw") > 0).mapInArrow(run, "line long, fields array<string>, bytes long"), form, size


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A delimited file of unknown form as text columns, and what was found; unnamed columns are numbered.

    The form is read from the first 64 KiB, the file itself by Spark's reader.
    """
    form = sniff(head(spark, path)[0])
    names = [c.lstrip("﻿") or f"column_{i + 1}" for i, c in enumerate(form["columns"])]
    names = [n if names.index(n) == i else f"{n}_{i + 1}" for i, n in enumerate(names)]
    if not names:
        return spark.createDataFrame([], "column_1 string"), form
    schema = ", ".join(f"`{n}` string" for n in names)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # for windows-1252
    r = spark.read.option("header", form["header"]).option("sep", form["delimiter"]).option("encoding", form["encoding"]).option("enforceSchema", True)
    return r.schema(schema).csv(path), form
