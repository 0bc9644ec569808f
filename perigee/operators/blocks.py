"""Statistics of samples inside many windows, from blocks of samples that are joined instead of the samples themselves.

Windows that overlap hold the same samples again and again, and more of them with every sample that is added: their
pairs grow with the product of both. Here samples are numbered in order of time, a window is a range of numbers, and
a range is a few blocks of 1, ``BASE``, ``BASE``², ... samples: fewer than twice ``BASE`` of each size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions.clock import DAY
from perigee.operators.ordered import running_sums

#: Blocks of one size that make one of the next.
BASE = 8
#: Ranges of up to so many samples are made of single ones, in order of time.
SINGLE = 256
_KIND = "struct<n:bigint,total:double,m2:double,min:double,max:double,first:struct<at:bigint,v:double>,last:struct<at:bigint,v:double>>"


def numbered(samples: DataFrame, windows: DataFrame, keys: Sequence[str], flags: dict[str, Column] | None = None, width: int = DAY) -> tuple[DataFrame, DataFrame]:
    """Samples with their number ``at`` from 0 in their key by ``ts_ns``, and the ranges of all distinct windows.

    Ranges are ``start_ns, end_ns``, the keys, ``low`` and ``high``: of every key the numbers from ``low`` to below
    ``high`` lie inside. For each of ``flags`` they have the number of such samples inside as well. One ordered
    pass over samples and the ends of windows, which is written. Keys of samples are few: every window asks each.
    """
    from perigee.sources.tables import written

    flags = flags or {}
    rest = [c for c in samples.columns if c not in (*keys, "ts_ns")]
    s = samples.where("ts_ns is not null").select(*keys, F.col("ts_ns").alias("__t"), F.lit(1).alias("__side"), *rest, *[f.cast("long").alias(f"__f_{n}") for n, f in flags.items()])
    w = windows.where("start_ns is not null").select("start_ns", F.coalesce("end_ns", F.col("start_ns") - 1).alias("end_ns")).distinct()
    ends = F.explode(F.array(F.struct(F.col("start_ns").alias("t"), F.lit(0).alias("side")), F.struct(F.col("end_ns").alias("t"), F.lit(2).alias("side")))).alias("e")
    p = w.select("*", ends).crossJoin(F.broadcast(samples.select(*keys).distinct()))
    p = p.select(*keys, F.col("e.t").alias("__t"), F.col("e.side").alias("__side"), "start_ns", "end_ns")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = {"__n": (F.col("__side") == 1).cast("long")} | {f"__s_{n}": zero(F.col(f"__f_{n}")) for n in flags}
    both = written(running_sums(s.unionByName(p, allowMissingColumns=True), keys, ["__t", "__side", *rest], sums, width))
    end = lambda c, side: F.max(F.when(F.col("__side") == side, F.col(c)))
    ranges = both.where("__side <> 1").groupBy(*keys, "start_ns", "end_ns").agg(
        end("__n", 0).alias("low"), end("__n", 2).alias("high"), *[(end(f"__s_{n}", 2) - end(f"__s_{n}", 0)).alias(n) for n in flags])
    return both.where("__side = 1").select(*keys, F.col("__t").alias("ts_ns"), *rest, (F.col("__n") - 1).alias("at")), ranges


def extents(samples: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per window and key that has any: the number of ``samples``, the first and the last time of one, and the window's columns."""
    numbers, held = numbered(samples.select(*keys, "ts_ns"), windows, keys)
    held = held.where("high > low")
    ends = held.select("start_ns", "end_ns", *keys, (F.col("high") - F.col("low")).alias("samples"), F.explode(F.array(F.col("low"), F.col("high") - 1)).alias("at"))
    x = ends.join(numbers, [*keys, "at"]).groupBy("start_ns", "end_ns", *keys).agg(F.first("samples").alias("samples"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    return windows.join(x, ["start_ns", "end_ns"])


def _of(name: str) -> Column:
    """A block of one sample."""
    v = F.col(name).cast("double")
    place = F.when(v.isNotNull(), F.struct(F.col("at"), v.alias("v")))
    return F.struct(v.isNotNull().cast("long").alias("n"), F.coalesce(v, F.lit(0.0)).alias("total"), F.lit(0.0).alias("m2"), v.alias("min"), v.alias("max"), place.alias("first"), place.alias("last")).cast(_KIND).alias(name)


def _first(name: str) -> Column:
    """A block of samples, aggregated."""
    v = F.col(name).cast("double")
    place, n = F.when(v.isNotNull(), F.struct(F.col("at"), v.alias("v"))), F.count(v)
    return F.struct(n.alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"), F.min(place).alias("first"), F.max(place).alias("last")).cast(_KIND).alias(name)


def _joined(parts: Column, name: str) -> Column:
    """One block of all in a list, by the exact rule for moments of two parts."""
    def step(s: Column, part: Column) -> Column:
        p = part[name]
        mean = lambda x: x["total"] / F.greatest(x["n"], F.lit(1))
        n, apart = s["n"] + p["n"], mean(p) - mean(s)
        apart = apart * apart * s["n"] * p["n"] / F.greatest(n, F.lit(1))
        new = F.struct(n.alias("n"), (s["total"] + p["total"]).alias("total"), (s["m2"] + p["m2"] + apart).alias("m2"), F.least(s["min"], p["min"]).alias("min"),
                       F.greatest(s["max"], p["max"]).alias("max"), F.least(s["first"], p["first"]).alias("first"), F.greatest(s["last"], p["last"]).alias("last"))
        return new.cast(_KIND)

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("m2"), *[F.lit(None).alias(c) for c in ("min", "max", "first", "last")]).cast(_KIND)
    return F.aggregate(parts, none, step).alias(name)


def _cover(levels: int) -> Column:
    """The blocks, as ``size`` (a power of ``BASE``) and ``block``, that the numbers from ``low`` to below ``high`` are made of."""
    def run(a: Column, b: Column, size: int) -> Column:
        none = F.array().cast("array<struct<size:int,block:bigint>>")
        return F.when(a < b, F.transform(F.sequence(a, F.greatest(b - 1, a)), lambda k: F.struct(F.lit(size).alias("size"), k.alias("block")))).otherwise(none)

    ends = [(F.ceil(F.col("low") / float(BASE**i)).cast("long"), F.floor(F.col("high") / float(BASE**i)).cast("long")) for i in range(levels)]
    parts = []
    for i, (a, b) in enumerate(ends):
        if i + 1 == levels:
            parts.append(run(a, b, i))
        else:
            inner, outer = ends[i + 1]
            more = inner < outer  # the middle is left to larger blocks
            parts += [run(a, F.when(more, inner * BASE).otherwise(b), i), run(F.when(more, outer * BASE).otherwise(b), b, i)]
    return F.when(F.col("high") - F.col("low") <= SINGLE, run(F.col("low"), F.col("high"), 0)).otherwise(F.flatten(F.array(*parts)))


def statistics(samples: DataFrame, ranges: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per range, of each column a struct of ``n, total, m2`` (squared distances from the mean), ``min, max, first, last``.

    Samples and ranges are those of ``numbered``; nulls don't count. Ranges without a sample have no row.
    """
    from perigee.sources.tables import written

    longest = ranges.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    levels = 1
    while longest > SINGLE and BASE**levels <= longest:
        levels += 1
    one = samples.select(*keys, F.lit(0).alias("size"), F.col("at").alias("block"), *map(_of, columns))
    blocks, last = one, None
    up = F.floor(F.col("block") / BASE).cast("long")
    for i in range(1, levels):
        if last is None:
            last = samples.groupBy(*keys, F.floor(F.col("at") / BASE).cast("long").alias("block")).agg(*map(_first, columns))
            last = written(last.select(*keys, F.lit(i).alias("size"), "block", *columns))
        else:
            parts = F.array_sort(F.collect_list(F.struct("block", *columns)))
            last = last.groupBy(*keys, up.alias("__up")).agg(parts.alias("__parts")).select(*keys, F.lit(i).alias("size"), F.col("__up").alias("block"), *[_joined(F.col("__parts"), c) for c in columns])
        blocks = blocks.unionByName(last)
    asked = ranges.select("start_ns", "end_ns", *keys, F.explode(_cover(levels)).alias("__b")).select("start_ns", "end_ns", *keys, "__b.size", "__b.block")
    start = F.col("block") * F.pow(F.lit(float(BASE)), F.col("size")).cast("long")
    x = asked.join(blocks, [*keys, "size", "block"])
    parts = F.array_sort(F.collect_list(F.struct(start.alias("start"), *columns)))
    x = x.groupBy("start_ns", "end_ns", *keys).agg(parts.alias("__parts"))
    return x.select("start_ns", "end_ns", *keys, *[_joined(F.col("__parts"), c) for c in columns])
