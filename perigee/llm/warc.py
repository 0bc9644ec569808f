"""WARC archives: written whole-file compressed, normalised to one gzip member per record, read by offset.

Archives are rows of ``path, content``, the columns that Spark's binaryFile reader gives for existing files,
so that any store Spark reaches will do. The normaliser inflates a whole-file stream once, a piece at a time,
rewrites every record as a member of its own and gives the offset and length of each.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import join_spread, saved, table

#: Payloads from this many bytes up are stored once.
LEAST = 100
#: Uncompressed bytes after which an archive is closed.
ARCHIVE = 8 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
_PIECE = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, compressed as a whole, by member, or not at all; inflated once, piece by piece."""
    held, need = bytearray(), None
    for piece in _inflated(content):
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", bytes(held[:end]))
                if length is None:
                    raise ValueError("a record without a length")
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if bytes(held).strip():
        raise ValueError("an archive ends inside a record")


def _inflated(content: bytes) -> Iterator[bytes]:
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), _PIECE):
            yield content[at: at + _PIECE]
        return
    stream, rest = zlib.decompressobj(31), memoryview(content)
    while len(rest):
        piece, rest = bytes(rest[:_PIECE]), rest[_PIECE:]
        while piece:
            yield stream.decompress(piece, _PIECE)
            piece = stream.unconsumed_tail
            if stream.eof:
                piece = stream.unused_data
                stream = zlib.decompressobj(31)
    yield stream.flush()


def normalise(content: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """An archive with every record as its own gzip member, and each one's (offset, length)."""
    out, index = bytearray(), []
    for r in records(content):
        member = gzip.compress(r, LEVEL, mtime=0)
        index.append((len(out), len(member)))
        out += member
    return bytes(out), index


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n, size = TaskContext.get().partitionId(), 0, 0
    stream, out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), bytearray()

    def closed() -> pa.RecordBatch:
        content = bytes(out) + stream.flush()
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{n:05d}.warc.gz"]), pa.array([content], pa.binary())], ["path", "content"])

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*batch.columns):
            data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
            out += stream.compress(data)
            size += len(data)
            if size >= ARCHIVE:
                yield closed()
                n, size = n + 1, 0
                stream, out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), bytearray()
    if size:
        yield closed()


def write_archives(pages: DataFrame) -> DataFrame:
    """``path, content`` of archives, each one gzip stream, with a record for every row of ``pages``.

    ``pages`` has ``page_id, url, html``. Of rows with equal payloads of at least 100 bytes the one with the
    smallest page_id is the response and the others revisit it, rows without an id among them; rows that
    repeat that id are responses too, and so are all where no row has an id. Digests are grouped without
    their payloads, so a payload that a third of the pages share costs a partial minimum a task; pages meet
    the decisions by id, revisits only.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    x = x.withColumn("digest", F.sha2("payload", 256))
    long = saved(x.where(F.octet_length("payload") >= LEAST).select("page_id", "digest"), "warc-digests")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows"), F.count_if(F.col("page_id").isNull()).alias("n"))
    first = saved(first.where("rows > 1 or n > 0"), "warc-first")
    shared = first.where("rows > 1").select("digest", "refers_to", "rows")
    revisits = join_spread(long, shared, ["digest"], "rows", long.count()).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = saved(revisits, "warc-revisits")
    if nameless := first.agg(F.sum("n")).first()[0]:
        # long payloads without an id have only the digest to go by, which many may share
        by_digest = F.col("page_id").isNull() & (F.octet_length("payload") >= LEAST)
        found = join_spread(x.where(by_digest), first.where("n > 0").drop("rows"), ["digest"], "n", nameless)
        x = x.where(~by_digest).join(revisits, ["page_id", "digest"], "left").unionByName(found)
    else:
        x = x.join(revisits, ["page_id", "digest"], "left")
    return x.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write, "path string, content binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """``path, content, index`` of ``path, content``: a gzip member per record, and the sidecar of offsets.

    ``index`` is an array of ``offset, length`` in record order. An archive that ends inside a record raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                data, index = normalise(content.as_py() or b"")
                spans = pa.array([[{"offset": a, "length": n} for a, n in index]], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([data], pa.binary()), spans], ["path", "content", "index"])

    return archives.select("path", "content").mapInArrow(run, "path string, content binary, index array<struct<offset: long, length: long>>")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index as a table: ``path, offset, length``, one row a record."""
    return normalised.select("path", F.explode("index").alias("i")).select("path", "i.offset", "i.length")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for content, spans in zip(*batch.columns):
            content, rows = content.as_py(), []
            for span in spans.as_py():
                head, block = split_record(gzip.decompress(content[span["offset"]: span["offset"] + span["length"]]))
                http, _, payload = block.partition(b"\r\n\r\n")
                number = lambda name: int(v) if (v := head[name][len("<urn:page:"): -1]) != "None" else None  # noqa: B023,E731
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError("a payload differs from its digest")
                rows.append((number("warc-record-id"), size, digest, head["warc-type"], number("warc-refers-to") if "warc-refers-to" in head else None))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archives(archives: DataFrame, offsets: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: every record, fetched by its offset.

    ``archives`` has ``path, content`` with a member per record and ``offsets`` is their sidecar, ``path, offset,
    length``. A response's payload has to agree with its digest. A revisit's payload is that of the response it
    refers to, whose own length and digest it gets; one that refers to nothing, or to a response of another
    digest, is an error.
    """
    # an archive is closed at a bounded size, and so are its offsets
    spans = offsets.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spans"))
    found = archives.select("path", "content").join(spans, "path").select("content", "spans")
    found = saved(found.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-records")
    again = found.where("record_type = 'revisit'")
    wanted = again.groupBy(F.col("refers_to").alias("id"), F.col("payload_digest").alias("digest")).agg(F.count("*").alias("n"))
    there = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("bytes"))
    facts = saved(wanted.join(there, ["id", "digest"], "left"), "warc-referred")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = join_spread(again.withColumnsRenamed({"refers_to": "id", "payload_digest": "digest"}), facts, ["id", "digest"], "n", total)
    size = F.coalesce("bytes", F.raise_error(F.lit("a revisit refers to no payload")).cast("long"))
    again = again.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("id").alias("refers_to"))
    return found.where("record_type <> 'revisit'").unionByName(again)


def archived(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; a null html is an empty payload, equal payloads have equal digests.

    The sidecar of offsets is a table of its own, and records are read through it. Nulls in page_id and url are
    kept, repeated rows and ids are records of their own. Empty tables give empty results; extra columns are
    ignored.
    """
    whole = saved(write_archives(pages), "warc-whole")
    members = saved(normalise_archives(whole), "warc-members")
    return read_archives(members, saved(sidecar(members), "warc-offsets"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
