"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are majority bits over the XXH64 of three-word shingles. Pairs within two bits are found with
seven structured masks: bit ``i`` gets the vector ``i % 7 + 1`` of GF(2)^3 and mask ``v`` keeps the bits whose
vector has an odd inner product with ``v``. Any two differing bits span at most two dimensions, so some
non-zero ``v`` is orthogonal to both and that table sees the pair agree: no pair in the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import components, join_spread, saved, table, text_of

BITS, RADIUS, TABLES = 64, 2, 7
#: Buckets up to this many fingerprints are compared pair by pair; larger ones go through wildcard keys.
PAIRWISE = 48
SPACES = " \t\n\x0b\x0c\r"
_FOLD = {ord(x): x.lower() for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | dict.fromkeys(map(ord, SPACES[1:]), " ")
_STEP = 1 << 16


def masks() -> list[int]:
    """Mask ``v`` of 1 to 7: bit ``i`` is kept when popcount((i % 7 + 1) & v) is odd."""
    return [sum(1 << i for i in range(BITS) if ((i % TABLES + 1) & v).bit_count() & 1) for v in range(1, TABLES + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 where it has no words."""
    words = [w for w in (text or "").translate(_FOLD).split(" ") if w]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [" ".join(words)] if len(words) < 3 else map(" ".join, zip(words, words[1:], words[2:]))
    total, n, part = np.zeros(BITS, np.int64), 0, []
    for s in shingles:
        part.append(digest(s, 42))
        if len(part) == _STEP:
            total, n, part = total + _bit_sums(part), n + len(part), []
    if part:
        total, n = total + _bit_sums(part), n + len(part)
    bits = (2 * total > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bit_sums(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"],
             pa.array([_signed(fingerprint(t.as_py())) for t in text], pa.int64())], [*[c for c in batch.schema.names if c != "text"], "fp"])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (signed long) of every whole text, and the kept columns; null and wordless texts have 0."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_of().alias("text"))
    kinds = "".join(f"`{c}` {x.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep))
    return x.mapInArrow(_fingerprints, f"{kinds}fp long")


def links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges ``a, b`` over distinct fingerprints ``fp`` that connect exactly what lies within two bits.

    A bucket of one table is compared pair by pair while it is small. In a larger one every fingerprint is
    keyed by each pair of free bits blanked out: two members are within two bits just when they share such a
    key, at most four distinct ones do, and an edge to the smallest of them keeps them connected. So no
    bucket grows quadratically and none is capped.
    """
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks())])).alias("x"))
    keyed = keyed.select("fp", "x.t", "x.k")
    counts = saved(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "sim-buckets")
    held = saved(join_spread(keyed, counts.withColumn("rows", F.col("n")), ["t", "k"], "rows", len(masks()) * prints.count()), "sim-keyed")
    few = held.where(F.col("n") <= pairwise).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    few = few.select(F.explode("m").alias("a"), "m").select("a", F.explode(F.filter("m", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= RADIUS))).alias("b"))
    free = []
    for m in masks():
        bits = [i for i in range(BITS) if not m >> i & 1]
        free.append([_signed(((1 << 64) - 1) ^ (1 << i) ^ (1 << j)) for i in bits for j in bits if i < j])
    wide = held.where(F.col("n") > pairwise)
    stars = None
    for t, blanks in enumerate(free):
        x = wide.where(F.col("t") == t).select("fp", F.posexplode(F.lit(np.array(blanks, np.int64))).alias("w", "blank"))
        x = x.select("fp", F.lit(t).alias("t"), "w", F.col("fp").bitwiseAND(F.col("blank")).alias("k"))
        stars = x if stars is None else stars.unionByName(x)
    # the members of a key are at most four, so the list is bounded
    stars = stars.groupBy("t", "w", "k").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    stars = stars.select("a", F.explode("m").alias("b")).where("a <> b")
    return few.select("a", "b").unionByName(stars).distinct()


def grouped(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp, component_id, part`` and the kept columns per document row.

    ``part`` is the smallest fingerprint of a row's group; it names the group whatever the ids are. The rest is
    as in ``near_duplicates``.
    """
    prints = saved(fingerprints(docs, keep), "sim-prints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "sim-distinct")
    parts = components(links(distinct))
    parts = parts.withColumnRenamed("node", "fp")
    of = distinct.join(parts, "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    low = of.groupBy("part").agg(F.min("first").alias("component_id"))
    of = saved(of.join(low, "part").select("fp", "copies", "component_id", "part"), "sim-components")
    total = of.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return join_spread(prints, of, ["fp"], "copies", total).select("doc_id", *keep, "fp", "component_id", "part")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document row; works on whole texts.

    Documents link when their fingerprints differ in at most two bits, wordless ones (fingerprint 0) like any
    other; ``component_id`` is the smallest doc_id reachable. Copies collapse to their fingerprint before any
    search, so a group of equal texts costs one row, and a fingerprint of many rows meets its group by a
    broadcast. Null doc_ids take part but never name a component unless all of it is null; rows that repeat an
    id are rows of their own. Empty tables give empty results; extra columns are ignored.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
