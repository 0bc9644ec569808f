"""ZIP archives as a Spark data source, and their extraction as a sink that commits whole or not at all.

Reading: the driver reads the directories of large archives only and cuts them into ranges of members of about
equal packed size; small archives are grouped whole. A task opens its archives where they lie and unpacks just its
own members. Equality and prefix filters on ``path`` and ``member`` are pushed down.

Extraction: what may be written is decided as a join of members with what lies at the destination, before
anything is. Tasks unpack into a folder of their own run, checking size and CRC; only the commit moves files to
their places, and an abort removes the folder.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, StringStartsWith, WriterCommitMessage

MEMBERS = "path string, member string, ordinal int, depth int, size long, packed_size long, crc32 long, mode int, directory boolean, content binary"
#: Packed bytes and members of a partition, and rows and bytes of a batch.
SPLIT, RANGE, ROWS, BYTES = 64 << 20, 20_000, 1024, 16 << 20
#: Depth of nested archives that are followed, and bytes of one that stay in memory.
DEEPEST, SPOOLED = 6, 8 << 20
#: Bits of a Unix mode that say what a file is, and their value for a symbolic link.
KIND, LINK = 0xF000, 0xA000


def quoted(path: str) -> str:
    """The form of a local path that Arrow reads: ``file:/x`` is ``file:///x``."""
    return "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quoted(path) if ":" in path.split("/", 1)[0] else "file://" + path)


@dataclass
class Range(InputPartition):
    """Members ``first`` to ``last`` (None: all) of some archives."""

    archives: tuple[tuple[str, int, int | None], ...]

    def __init__(self, archives):
        super().__init__(0)
        self.archives = tuple(archives)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.ending = options["path"], options.get("ending", ".zip")
        self.content = options.get("content", "false").lower() == "true"
        self.split, self.range = int(options.get("split", SPLIT)), int(options.get("range", RANGE))
        self.wanted: list[tuple[str, str, bool]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute in (("path",), ("member",)) and isinstance(f.value, str):
                self.wanted.append((f.attribute[0], f.value, isinstance(f, EqualTo)))
            else:
                yield f

    def _fits(self, column: str, text: str) -> bool:
        return all(text == v if equal else text.startswith(v) for c, v, equal in self.wanted if c == column)

    def _may_hold(self, prefix: str) -> bool:
        """Whether members below a nested archive can pass the filters."""
        return all(v.startswith(prefix) or not equal and prefix.startswith(v) for c, v, equal in self.wanted if c == "member")

    def partitions(self) -> list[Range]:
        store, root = opened(self.root)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = quoted(self.root)[: quoted(self.root).index(root)] if root in quoted(self.root) else ""
        files = sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(self.ending) and self._fits("path", scheme + f.path))
        out, group, total = [], [], 0
        for path, size in files:
            if size >= self.split:
                with store.open_input_file(opened(path)[1]) as f, zipfile.ZipFile(f) as z:
                    first = held = 0
                    for i, m in enumerate(z.infolist()):
                        held += m.compress_size
                        if held >= self.split or i - first >= self.range:
                            out.append(Range([(path, first, i + 1)]))
                            first, held = i + 1, 0
                    out.append(Range([(path, first, None)]))
                continue
            group.append((path, 0, None))
            total += size
            if total >= self.split:
                out.append(Range(group))
                group, total = [], 0
        return out + ([Range(group)] if group else [])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, first, last in partition.archives:
            store, name = opened(path)
            with store.open_input_file(name) as f:
                for row in self._walk(f, path, "", 0, first, last):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= ROWS or held >= BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)

    def _walk(self, file, path: str, prefix: str, depth: int, first: int = 0, last: int | None = None, ordinal: int | None = None) -> Iterator[tuple]:
        with zipfile.ZipFile(file) as z:
            for i, m in list(enumerate(z.infolist()))[first:last]:
                at, name = i if ordinal is None else ordinal, prefix + m.filename
                if self._fits("member", name):
                    data = z.read(m) if self.content and not m.is_dir() else None
                    yield path, name, at, depth, m.file_size, m.compress_size, m.CRC, m.external_attr >> 16, m.is_dir(), data
                if name.lower().endswith(".zip") and not m.is_dir() and depth < DEEPEST and self._may_hold(name + "!"):
                    with tempfile.SpooledTemporaryFile(SPOOLED) as inner:
                        with z.open(m) as packed:
                            shutil.copyfileobj(packed, inner, 1 << 20)
                        yield from self._walk(inner, path, name + "!", depth + 1, ordinal=at)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    names = [f.split()[0] for f in MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


class ZipMembers(DataSource):
    """``spark.read.format("perigee_zip")``: members of all archives below a path, nested ones too.

    Options: ``ending`` of the archives' names, ``content`` (false: null) and ``split``, packed bytes a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "perigee_zip"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def read_members(spark: SparkSession, path: str, ending: str = ".zip", content: bool = False, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("perigee_zip").option("ending", ending).option("content", str(content).lower()).option("split", split).load(path)


# ---------------------------------------------------------------- extraction


class Refused(ValueError):
    pass


def safe_target(member: Column) -> Column:
    """Where a member goes below the destination; null for a name that isn't safe.

    Not safe are names that are empty, absolute, of a drive or with a colon, hold a NUL, or step up.
    """
    name = F.replace(member, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(name, "/"), lambda p: ~p.isin("", "."))
    bad = member.isNull() | name.startswith("/") | F.contains(name, F.lit(":")) | F.contains(name, F.lit("\0")) | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def extraction_plan(members: DataFrame, there: DataFrame) -> DataFrame:
    """``path, ordinal, member, target, size, crc32, status`` of the files of archives.

    ``there`` has ``target, size, crc32`` of what lies at the destination. ``status`` is ``unsafe`` (name),
    ``link``, ``duplicate`` (two members of one target, whatever their case, or a file where another member needs a folder), ``conflict`` (another
    file lies there), ``same`` (that file lies there) or ``write``.
    """
    x = members.where("depth = 0").withColumn("target", safe_target(F.col("member")))
    key = F.lower("target")
    x = x.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    folders = x.where("target is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/"))), lambda i: F.array_join(F.slice(F.split(F.lower("target"), "/"), 1, i - 1), "/"))).alias("__key")).where("__key <> ''").distinct()
    x = x.where("not directory").withColumn("__key", key)
    x = x.join(folders.withColumn("__folder", F.lit(True)), "__key", "left")
    x = x.join(there.select(F.lower("target").alias("__key"), F.col("size").alias("__size"), F.col("crc32").alias("__crc")), "__key", "left")
    status = (F.when(F.col("target").isNull(), "unsafe").when(F.col("mode").bitwiseAND(KIND) == LINK, "link").when((F.col("__n") > 1) | F.coalesce("__folder", F.lit(False)), "duplicate")
              .when(F.col("__size").isNull(), "write").when((F.col("__size") == F.col("size")) & (F.col("__crc") == F.col("crc32")), "same").otherwise("conflict"))
    return x.select("path", "ordinal", "member", "target", "size", "crc32", status.alias("status"))


def lying(spark: SparkSession, destination: str) -> DataFrame:
    """``target, size, crc32`` of the files below a destination, which needn't exist; read by Spark, by task."""
    store, root = opened(destination)
    if not store.get_file_info(root).type == fs.FileType.Directory or not store.get_file_info(fs.FileSelector(root)):
        return spark.createDataFrame([], "target string, size long, crc32 long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(destination)
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    return files.select(F.col("path").substr(at + len(root.rstrip("/")) + 1, F.length("path")).alias("target"), F.col("length").alias("size"), F.crc32("content").alias("crc32"))


@dataclass
class Unpacked(WriterCommitMessage):
    targets: list[str]
    size: int


class ExtractionWriter(DataSourceWriter):
    def __init__(self, destination: str, run: str):
        self.destination, self.run = destination, run

    def _root(self) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.destination)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/.extracting-{self.run}"

    def write(self, rows: Iterator) -> Unpacked:
        store, _, part = self._root()
        targets, total, mine = [], 0, uuid.uuid4().hex
        archive, held, z = None, None, None
        try:
            for r in rows:
                if r["path"] != archive:
                    if z is not None:
                        z.close()
                        held.close()
                    source, name = opened(r["path"])
                    archive, held = r["path"], source.open_input_file(name)
                    z = zipfile.ZipFile(held)
                to = f"{part}/{mine}/{r['target']}"
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                size = crc = 0
                with z.open(z.infolist()[r["ordinal"]]) as packed, store.open_output_stream(to) as out:
                    while block := packed.read(1 << 20):
                        size, crc = size + len(block), zlib.crc32(block, crc)
                        out.write(block)
                if (size, crc) != (r["size"], r["crc32"]):
                    raise Refused(f"{r['member']} isn't of the size and CRC that its archive says")
                targets.append(f"{mine}/{r['target']}")
                total += size
        finally:
            if z is not None:
                z.close()
                held.close()
        return Unpacked(targets, total)

    def commit(self, messages: list) -> None:
        store, root, part = self._root()
        made = []
        try:
            for t in (t for m in messages if m is not None for t in m.targets):
                to = f"{root}/{t.split('/', 1)[1]}"
                if store.get_file_info(to).type != fs.FileType.NotFound:
                    raise Refused(f"{to} has come since the plan was made")
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                store.move(f"{part}/{t}", to)
                made.append(to)
        except Exception:
            for to in made:
                store.delete_file(to)
            self.abort(messages)
            raise
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, _, part = self._root()
        if store.get_file_info(part).type == fs.FileType.Directory:
            store.delete_dir(part)


class ZipExtraction(DataSource):
    @classmethod
    def name(cls) -> str:
        return "perigee_unzip"

    def schema(self) -> str:
        return "path string, ordinal int, member string, target string, size long, crc32 long"

    def writer(self, schema, overwrite: bool) -> ExtractionWriter:
        return ExtractionWriter(self.options["path"], self.options["run"])


#: Names of refused members that an error lists.
NAMED = 10


def extract(spark: SparkSession, path: str, destination: str, forbidden: tuple[str, ...] = ()) -> dict[str, int]:
    """Unpack all archives below ``path`` into ``destination``; returns ``written, same, size``.

    Nothing is written if any member is unsafe, a link, a duplicate or in conflict with what lies there, or if
    the destination is or lies below one of the ``forbidden`` folders. Files of equal size and CRC are left as they are, so a
    second run writes nothing. A run that fails or is killed leaves no file at its place; its folder, whose name
    begins with ``.extracting-``, goes with the abort or may be removed later.
    """
    inside = lambda a, b: a == b or a.startswith(b + "/")
    plain = lambda p: opened(p)[1].rstrip("/")
    if any(inside(plain(destination), plain(f)) for f in forbidden) or ".." in plain(destination).split("/"):
        raise Refused(f"{destination} must not be written to")
    from perigee.sources.tables import written

    plan = written(extraction_plan(read_members(spark, path), lying(spark, destination)))
    counts = {r["status"]: (r["n"], r["size"]) for r in plan.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    if refused := sorted(set(counts) - {"write", "same"}):
        some = plan.where(F.col("status").isin(refused)).select("status", "member").orderBy("status", "member").limit(NAMED).collect()
        raise Refused("; ".join(f"{r['status']}: {r['member']!r}" for r in some))
    spark.dataSource.register(ZipExtraction)
    rows = plan.where("status = 'write'").drop("status")
    if "write" in counts:
        tasks = max(1, min(10_000, counts["write"][1] // SPLIT + 1))
        rows = rows.repartitionByRange(tasks, "path", "ordinal").sortWithinPartitions("path", "ordinal")
        rows.write.format("perigee_unzip").option("run", uuid.uuid4().hex).mode("append").save(destination)
    return {"written": counts.get("write", (0, 0))[0], "same": counts.get("same", (0, 0))[0], "size": counts.get("write", (0, 0))[1]}
