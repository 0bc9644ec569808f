"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every copy of a document gets a virtual finish time: the words its source has handed out so far, itself
included, divided by the source's target. The mix is the prefix of all copies in finish order whose words
fit the budget. Prefix sums are taken in two levels, hash buckets inside a source and virtual-time ranges
over all, so that neither a source with a third of the rows nor the global order meets in one task; only
the one range that the budget cuts is sorted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.llm.common import WORD, join_spread, saved, table, text_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of a source that agree in id and text are summed as one, and numbered in parts, where there are more than so many.
EQUAL = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row a source: ``source, idx, source_size, weight, target``.

    Sources in code point order, null last, take the weights in turn. Targets share the total of all sizes
    by weight and stop at ``repeats`` times the source's size; what is cut off is shared again by weight.
    That is a water level: ``target = min(cap, level * weight)``, with the level found from the sources in
    order of ``cap / weight``. An empty table gives no rows; a total of 0 gives targets of 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("idx"), F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("idx", F.row_number().over(order) - 1).withColumn("weight", pick)
    by = by.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "idx")
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("left_weight", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.sum("source_size").over(every) - F.col("capped")) / F.col("left_weight"))
    # the first source, by ratio, that the level does not overfill fixes the level of all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "idx", "level"))).over(every)["level"]
    by = by.withColumn("water", level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight"))
    return by.select("source", "idx", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, keep=("doc_id",)) -> DataFrame:
    """How many words of each document the mix takes: ``keep`` columns, ``size, source_size, target, taken``.

    ``docs`` has ``doc_id, text, source``; other columns are ignored. Null text counts 0 words, a null
    source is a source of its own. Documents are shuffled within a source by the md5 of their id and text, so
    that rows without an id or of one id spread as well; rows that agree in both are interchangeable, so reruns
    agree; further ``keep`` columns put up to ``EQUAL`` of them in order. More than that are one row with a count
    until each gets its number, in parts, so that no task meets all rows of one boilerplate text. A copy is queued while its middle lies before its
    source's target, so a source comes within half a document of it; the budget is the number of words of all
    documents and is never exceeded, which may cost the copies that finish last. Empty tables give empty results.
    """
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of().cast("binary"))).cast("binary"))
    more = [c for c in keep if c != "doc_id"]
    sizes = docs.select("doc_id", "source", *more, F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("rid"))
    sizes = saved(sizes, "mix-sizes")
    equal = sizes.groupBy("source", "h").agg(F.count("*").alias("c"), F.first("doc_id").alias("doc_id"), F.first("size").alias("size")).where(F.col("c") > EQUAL)
    equal = saved(equal, "mix-equal")
    alike = equal.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    stats = saved(source_targets(sizes, weights, repeats), "mix-sources")
    total, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # buckets of about 256 rows, up to 268 million rows a source; from there on they grow with the rows
    digits = min(5, max(1, math.ceil(math.log(max(rows, 16) / 256 + 1, 16))))
    ranges = 16**digits

    s = stats.withColumnRenamed("source", "stat_source")
    single = sizes.withColumn("c", F.lit(1).cast("long"))
    if alike:
        # one row for all that are alike; with a key of their own, as a source may be null
        key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("s"), F.col("h").alias("h")).alias("key")
        of = sizes.select("*", key)
        few = join_spread(of, equal.select(key, "c"), ["key"], "c", rows, keep="c")
        single = of.join(equal.select(key), "key", "left_anti").drop("key").withColumn("c", F.lit(1).cast("long")).unionByName(equal, allowMissingColumns=True)
    x = single.join(s, single["source"].eqNullSafe(s["stat_source"])).drop("stat_source", "weight")
    x = x.withColumn("bucket", F.substring("h", 1, digits))
    own = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size", *more)
    x = x.withColumn("in_bucket", F.sum(F.col("size") * F.col("c")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sizes.join(s, sizes["source"].eqNullSafe(s["stat_source"])).withColumn("bucket", F.substring("h", 1, digits))
    sums = sums.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("idx", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    x = x.join(sums, ["idx", "bucket"]).withColumn("handed", F.col("offset") + F.col("in_bucket"))
    if alike:
        # rows that are alike stand one after the other: numbered inside parts, behind the parts before
        few = few.withColumn("part", F.pmod(F.xxhash64("rid"), F.ceil(F.col("c") / EQUAL)))
        inside = Window.partitionBy("key", "part").orderBy(*more, "rid")
        few = few.withColumn("at", F.row_number().over(inside))
        before = few.groupBy("key", "part").agg(F.count("*").alias("n"))
        before = before.withColumn("first", F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n"))
        facts = x.where("c > 1").select(key, "c", "source_size", "target", "idx", "handed")
        few = few.drop("c").join(before.drop("n"), ["key", "part"])
        few = join_spread(few, saved(facts, "mix-alike"), ["key"], "c", rows, keep="c")
        x = x.where("c = 1").drop("c").unionByName(few.withColumn("handed", F.col("handed") - (F.col("c") - F.col("first") - F.col("at")) * F.col("size")).drop("c", "key", "part", "at", "first"), allowMissingColumns=True)
    x = saved(x.select("doc_id", "source", *more, "size", "source_size", "target", "idx", "h", "handed"), "mix-order")

    # a copy is queued when its middle lies before its source's target
    copies = F.array(*[F.struct(
        ((F.col("handed") + F.col("source_size") * e) / F.col("target")).alias("finish"),
        ((F.col("handed") * 2 - F.col("size") + F.col("source_size") * (2 * e)) < F.col("target") * 2).alias("queued"),
        F.lit(e).alias("copy")) for e in range(repeats)])
    queued = x.where("size > 0 and target > 0").select("idx", "h", "doc_id", "size", F.explode(F.filter(copies, lambda c: c["queued"])).alias("c"))
    queued = queued.select("c.finish", "idx", "h", "doc_id", "size", "c.copy")
    queued = queued.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges)).cast("long"))
    spans = queued.groupBy("range").agg(F.sum("size").alias("n"))
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    at = spans.where(F.col("before") <= total).orderBy(F.desc("range")).first()
    columns = ["finish", "idx", "h", "doc_id", "size", "copy"]
    cut = None
    if at is not None:
        inside = Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
        edge = queued.where(F.col("range") == at["range"]).withColumn("sum", F.sum("size").over(inside) + at["before"])
        cut = edge.where(F.col("sum") <= total).orderBy(*[F.desc(c) for c in columns]).first()
    if cut is None:
        first = at["range"] / ranges if at is not None else -1.0
        fits = lambda c: c["finish"] < F.lit(first)  # noqa: E731  nothing of the cut range fits
    else:
        last = F.struct(*[F.lit(cut[c]).cast(queued.schema[c].dataType).alias(c) for c in columns])
        fits = lambda c: F.struct(c["finish"].alias("finish"), F.col("idx"), F.col("h"), F.col("doc_id"), F.col("size"), c["copy"].alias("copy")) <= last
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.size(F.filter(copies, lambda c: c["queued"] & fits(c)))).otherwise(0)
    return x.select(*keep, "size", "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h, row_number() OVER () AS r
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM by_source),
weighted AS (
  SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM numbered),
ratios AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio FROM weighted),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY ratio, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ratios),
water AS (SELECT level AS w FROM levels WHERE level <= ratio ORDER BY ratio, idx LIMIT 1),
targets AS (
  SELECT source, idx, source_size, least(cap::DOUBLE, coalesce((SELECT w FROM water), 0.0) * weight) AS target
  FROM levels),
queue AS (
  SELECT s.doc_id, s.size, s.h, s.r, t.idx, t.source_size, t.target,
         (sum(s.size) OVER (PARTITION BY t.idx ORDER BY s.h, s.doc_id, s.size, s.r
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS handed
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e.e, (handed + source_size * e.e)::DOUBLE / target AS finish
  FROM queue q, (VALUES (0), (1), (2)) e(e)
  WHERE size > 0 AND target > 0 AND (handed * 2 - size + source_size * 2 * e.e) < target * 2),
fitted AS (
  SELECT *, sum(size) OVER (ORDER BY finish, idx, h, doc_id, size, e, r
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM copies),
took AS (
  SELECT r, sum(size)::BIGINT AS taken FROM fitted
  WHERE total <= (SELECT sum(size) FROM sizes) GROUP BY r)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN took k ON q.r = k.r
"""
