"""Algebra of closed integer intervals ``start_ns, end_ns``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.clock import DAY, HOUR
from perigee.operators.ordered import SPAN, meet, neighbours, running_sum, running_sums, spanned

#: Lengths of buckets of the interval join grow by this factor from level to level.
STEP = 16
#: Rows that one side of an interval join may have, after it is dealt to buckets, to be broadcast.
SMALL = 200_000


def union(df: DataFrame, keys: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Union per key; intervals that overlap or touch by one become one. Invalid and null ones are left out.

    Runs are found inside spans of time, given how far all spans before reach, which is one row a span. At most
    one run of a span carries on from before; it belongs to the last run that began there.
    """
    x = df.select(*keys, "start_ns", "end_ns").where("start_ns is not null and end_ns >= start_ns")
    x, by = spanned(x, "start_ns", width), [*keys, SPAN]
    across = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    reach = x.groupBy(*by).agg(F.max("end_ns").alias("__reach")).select(*by, F.max("__reach").over(across).alias("__carried"))
    own = Window.partitionBy(*by).orderBy("start_ns", "end_ns")
    before = F.greatest(F.max("end_ns").over(own.rowsBetween(Window.unboundedPreceding, -1)), "__carried")
    x = meet(x, reach, by).withColumn("__new", (before.isNull() | (F.col("start_ns") > before + 1)).cast("long"))
    x = x.withColumn("__g", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*by, "__g").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    last = runs.groupBy(*by).agg(F.max(F.when(F.col("__g") > 0, F.col("start_ns"))).alias("__last"))
    last = last.select(*by, F.last("__last", ignorenulls=True).over(across).alias("__home"))
    runs = meet(runs, last, by).withColumn("__start", F.when(F.col("__g") > 0, F.col("start_ns")).otherwise(F.col("__home")))
    return runs.groupBy(*keys, "__start").agg(F.max("end_ns").alias("end_ns")).select(*keys, F.col("__start").alias("start_ns"), "end_ns")


def clip(df: DataFrame, low: int, high: int, keys: Sequence[str] = ()) -> DataFrame:
    """Union, cut to ``[low, high]``."""
    x = union(df, keys)
    x = x.withColumn("start_ns", F.greatest("start_ns", F.lit(low))).withColumn("end_ns", F.least("end_ns", F.lit(high)))
    return x.where("start_ns <= end_ns")


def duration(df: DataFrame, name: str = "duration_ns") -> DataFrame:
    """One row: the summed ``end - start`` of disjoint intervals."""
    return df.agg(F.coalesce(F.sum(F.col("end_ns") - F.col("start_ns")), F.lit(0)).alias(name))


def _level(width: int, top: int) -> Column:
    span = F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(1)) / F.lit(float(width))
    return F.least(F.greatest(F.ceil(F.log(float(STEP), span)), F.lit(0)), F.lit(top)).cast("int")


def interval_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), width: int = HOUR, top: int = 2) -> DataFrame:
    """Pairs of overlapping intervals of ``a`` and ``b``: all columns, those of ``b`` under ``b_``.

    Points are intervals of equal ends. Both sides are dealt to time buckets whose length grows with that of
    the interval, so neither short nor long ones touch more than a few; a pair is kept in one bucket only.
    ``top`` is the last level, at the default ten days a bucket. ``b`` is looked at first: how many rows it takes and
    how long its longest interval is. Rows of ``a`` are dealt to no higher level than these need, and where ``b``
    is ``SMALL`` it is broadcast, so ``a`` stays where it is, however many of its rows lie in one bucket; a larger
    ``b`` meets ``a`` in a shuffle by bucket.
    """
    size = lambda lv: F.lit(float(width)) * F.pow(F.lit(float(STEP)), lv)
    level = _level(width, top)
    copies = F.floor(F.col("end_ns") / size(level)) - F.floor(F.col("start_ns") / size(level)) + 1 + 2 * (F.lit(top) - level)
    rows, highest = b.where("end_ns >= start_ns").agg(F.coalesce(F.sum(copies), F.lit(0)), F.coalesce(F.max(level), F.lit(0))).first()

    def dealt(df: DataFrame, name: str, last: Column) -> DataFrame:
        df = df.withColumn(f"{name}_level", level)
        df = df.withColumn("__lv", F.explode(F.sequence(F.col(f"{name}_level"), last)))
        ends = [F.floor(F.col(c) / size(F.col("__lv"))).cast("long") for c in ("start_ns", "end_ns")]
        return df.withColumn("__bucket", F.explode(F.sequence(*ends)))

    # a pair meets at the level of the longer one
    left = dealt(a, "__a", F.greatest("__a_level", F.lit(highest)))
    right = dealt(b.where("end_ns >= start_ns"), "__b", F.lit(top)).select(*keys, "__lv", "__bucket", "__b_level", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    x = left.join(F.broadcast(right) if rows <= SMALL else right, [*keys, "__lv", "__bucket"])
    x = x.where((F.col("start_ns") <= F.col("b_end_ns")) & (F.col("b_start_ns") <= F.col("end_ns")))
    x = x.where(F.col("__lv") == F.greatest("__a_level", "__b_level"))
    x = x.where(F.col("__bucket") == F.floor(F.greatest("start_ns", "b_start_ns") / size(F.col("__lv"))).cast("long"))
    return x.drop("__lv", "__bucket", "__a_level", "__b_level")


def subtract(df: DataFrame, masks: DataFrame, keys: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """What of the union of ``df`` lies outside the union of ``masks``; cut edges move by one.

    One sweep over the ends of both: running counts of open intervals and open masks, two-level like every
    running sum here, so that one interval under many masks is not one task's work.
    """
    def ends(x: DataFrame, of: str) -> DataFrame:
        x = x.where("start_ns is not null and end_ns >= start_ns")
        both = F.explode(F.array(F.struct(F.col("start_ns").alias("t"), F.lit(1).alias("d")), F.struct((F.col("end_ns") + 1).alias("t"), F.lit(-1).alias("d")))).alias("p")
        zero = F.lit(0)
        return x.select(*keys, both).select(*keys, F.col("p.t").alias("__t"), (F.col("p.d") if of == "x" else zero).alias("__dx"), (F.col("p.d") if of == "m" else zero).alias("__dm"))

    points = ends(df, "x").unionByName(ends(masks, "m")).groupBy(*keys, "__t").agg(F.sum("__dx").alias("__dx"), F.sum("__dm").alias("__dm"))
    points = spanned(points, "__t", width)
    own = Window.partitionBy(*keys, SPAN).orderBy("__t")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    spans = points.groupBy(*keys, SPAN).agg(F.sum("__dx").alias("__sx"), F.sum("__dm").alias("__sm"), F.min("__t").alias("__first"))
    across = Window.partitionBy(*keys).orderBy(SPAN)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, SPAN, F.coalesce(F.sum("__sx").over(before), F.lit(0)).alias("__ox"), F.coalesce(F.sum("__sm").over(before), F.lit(0)).alias("__om"), F.lead("__first").over(across).alias("__after"))
    points = points.withColumns({"__cx": F.sum("__dx").over(upto), "__cm": F.sum("__dm").over(upto), "__next": F.lead("__t").over(own)})
    points = meet(points, spans, [*keys, SPAN])
    inside = (F.col("__cx") + F.col("__ox") > 0) & (F.col("__cm") + F.col("__om") == 0)
    return union(points.where(inside).select(*keys, F.col("__t").alias("start_ns"), (F.coalesce("__next", "__after") - 1).alias("end_ns")), keys, width)


def sweep(parts: dict[str, DataFrame], width: int = DAY) -> DataFrame:
    """One row a moment at which any interval of any part begins or has ended: ``t_ns``, and how many of each part
    are open from then on (``name``) and were just before (``name_before``).

    All parts are merged into one ordered pass.
    """
    points = None
    for name, df in parts.items():
        both = F.explode(F.array(F.struct(F.col("start_ns").alias("t"), F.lit(1).alias("d")), F.struct((F.col("end_ns") + 1).alias("t"), F.lit(-1).alias("d")))).alias("p")
        x = df.where("start_ns is not null and end_ns >= start_ns").select(both).select(F.col("p.t").alias("t_ns"), *[(F.col("p.d") if n == name else F.lit(0)).alias(f"__{n}") for n in parts])
        points = x if points is None else points.unionByName(x)
    points = points.groupBy("t_ns").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in parts])
    out = running_sums(points, (), ["t_ns"], {n: F.col(f"__{n}") for n in parts}, width)
    return out.select("t_ns", *parts, *[(F.col(n) - F.col(f"__{n}")).alias(f"{n}_before") for n in parts])


def overlap_flags(df: DataFrame, others: DataFrame, keys: Sequence[str] = (), name: str = "overlaps") -> DataFrame:
    """Adds whether each interval overlaps any of ``others``."""
    own = [*keys, "start_ns", "end_ns"]
    hit = interval_join(df.select(*own).distinct(), union(others, keys), keys).select(*own).distinct().withColumn(name, F.lit(True))
    return df.join(hit, own, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def detected_ids(predictions: DataFrame, events: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Distinct ids of events of which any interval overlaps any prediction."""
    return interval_join(events.select(id_column, "start_ns", "end_ns"), union(predictions)).select(id_column).distinct()


def islands(samples: DataFrame, keys: Sequence[str], max_gap_ns: int, width: int = DAY) -> DataFrame:
    """Intervals of runs of positive samples of ``ts_ns, positive`` per key.

    A run breaks at a negative sample and at a gap above ``max_gap_ns``. It ends just before the sample after
    its last, whatever that is, at its own last sample if none follows, and never later than the gap allows.
    """
    x = neighbours(samples.select(*keys, "ts_ns", F.coalesce("positive", F.lit(False)).alias("positive")), keys, ["ts_ns"], ["ts_ns", "positive"], width)
    x = x.where("positive")
    begins = ~F.coalesce(F.col("prev.positive") & (F.col("ts_ns") - F.col("prev.ts_ns") <= max_gap_ns), F.lit(False))
    x = running_sum(x.withColumn("after", F.col("next.ts_ns")), keys, ["ts_ns"], begins.cast("long"), "__g", width)
    last = F.max_by(F.struct("ts_ns", "after"), "ts_ns")
    x = x.groupBy(*keys, "__g").agg(F.min("ts_ns").alias("start_ns"), last.alias("z"))
    end = F.least(F.coalesce(F.col("z.after") - 1, F.col("z.ts_ns")), F.col("z.ts_ns") + max_gap_ns)
    return x.select(*keys, "start_ns", F.greatest("start_ns", end).alias("end_ns"))


def run_counts(samples: DataFrame, flags: dict[str, Column], max_gap_ns: int, width: int = DAY) -> DataFrame:
    """One row with, for each flag, the number of its runs, as ``islands`` finds them, over samples of distinct ``ts_ns``.

    A run begins where the sample before isn't flagged or lies further back than the gap, so one ordered pass
    over the samples counts the runs of all flags.
    """
    x = neighbours(samples.select("ts_ns", *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()]), (), ["ts_ns"], ["ts_ns", *flags], width)
    near = F.col("ts_ns") - F.col("prev.ts_ns") <= max_gap_ns
    return x.agg(*[F.count_if(F.col(n) & ~F.coalesce(F.col(f"prev.{n}") & near, F.lit(False))).alias(n) for n in flags])
