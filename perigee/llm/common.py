"""Helpers shared by the corpus operators: the shared folder, lineage cuts and components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, one machine) gets a temporary one; on a cluster, whose executors
    couldn't read it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Tables stand in one folder a Spark application. ``discard`` removes one of them, ``discard_all`` the folder,
    once nothing that was made from them will be read again.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``saved`` returned and that a later one has replaced."""
    _remove(df.sparkSession, df.saved_at)


def discard_all(spark: SparkSession) -> None:
    """Remove everything that ``saved`` wrote in this application; results that still need it must be read before."""
    _remove(spark, _run_dir(spark))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: A key with more than one in so many of all rows is joined by broadcast; there are at most as many such keys.
HEAVY = 1000


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, keep: str | None = None) -> DataFrame:
    """``rows`` inner-joined with ``facts``, which has one row a key and in ``weight`` how many ``rows`` share it.

    The weight itself is dropped unless ``keep`` names it.

    ``total`` is at least the sum of all weights. Keys that hold a thousandth of it or more are a thousand at
    most: those facts are broadcast, so no task gets all rows of a key. All others are joined by a shuffle.
    Keys aren't null.
    """
    heavy = facts.where(F.col(weight) * HEAVY >= total)
    light = facts.where(F.col(weight) * HEAVY < total)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    if keep != weight:
        heavy, light = heavy.drop(weight), light.drop(weight)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: ``(node, component)``, smallest node of each.

    Alternating large-star and small-star steps. A node first learns its smallest neighbour from a partial
    ``min`` (no neighbour list is ever gathered), then the edges are rewired towards it; a hub's edges stay
    where they are and its minimum is broadcast, so a hub with millions of edges is not one task's work. Ends
    when a round changes no edge; each round is written to the shared folder, which cuts lineage. No edges: an
    empty result. Self-loops and repeated edges are harmless.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur = saved(cur, "cc")
    same = mark(cur)
    for _ in range(rounds):
        if not same[0]:
            break
        # large-star: every neighbour larger than u links to the smallest of u's neighbourhood
        both = cur.select("u", F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_spread(both.where("v > u"), low, ["u"], "n", 2 * same[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "cc")
        # small-star: smaller neighbours and u itself link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_spread(large, least, ["u"], "n", 2 * same[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        cur, before = saved(small, "cc"), same
        if (same := mark(cur)) == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots)
