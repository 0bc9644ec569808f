"""Ordered operators that don't gather a key in one task.

A window over a whole channel, or over no key at all, would put its rows in one task. Here time is cut into
spans: windows run inside (keys, span), and the few rows that spans hand to one another are found on one row
per span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.clock import DAY

SPAN = "__span"


def spanned(df: DataFrame, time: str, width: int = DAY) -> DataFrame:
    return df.withColumn(SPAN, F.floor(F.col(time) / F.lit(width)).cast("long"))


def meet(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``; nulls are equal to each other, as they are in windows and groups."""
    right = facts.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        same = df[k].eqNullSafe(right[f"__r_{k}"])
        on = same if on is None else on & same
    return df.join(right, on).drop(*[f"__r_{k}" for k in keys])


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int = DAY) -> DataFrame:
    """Adds structs ``prev`` and ``next`` of ``columns`` of the row before and after in ``order`` (time first)."""
    df = spanned(df, order[0], width)
    own = Window.partitionBy(*keys, SPAN).orderBy(*order)
    row, at = F.struct(*columns), F.struct(*order)
    ends = df.groupBy(*keys, SPAN).agg(F.min_by(row, at).alias("__first"), F.max_by(row, at).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(SPAN)
    ends = ends.select(*keys, SPAN, F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after"))
    df = df.withColumn("__p", F.lag(row).over(own)).withColumn("__n", F.lead(row).over(own))
    df = meet(df, ends, [*keys, SPAN])
    return df.withColumn("prev", F.coalesce("__p", "__before")).withColumn("next", F.coalesce("__n", "__after")).drop("__p", "__n", "__before", "__after", SPAN)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int = DAY) -> DataFrame:
    """Adds, for each name, the sum of its value up to and with each row in ``order`` (time first)."""
    names = list(values)
    df = spanned(df.withColumns({f"__v{i}": values[n] for i, n in enumerate(names)}), order[0], width)
    own = Window.partitionBy(*keys, SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, SPAN).agg(*[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(names))])
    across = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, SPAN, *[F.coalesce(F.sum(f"__s{i}").over(across), F.lit(0)).alias(f"__o{i}") for i in range(len(names))])
    df = meet(df.withColumns({f"__c{i}": F.sum(f"__v{i}").over(own) for i in range(len(names))}), sums, [*keys, SPAN])
    df = df.withColumns({n: F.col(f"__c{i}") + F.col(f"__o{i}") for i, n in enumerate(names)})
    return df.drop(SPAN, *[f"__{k}{i}" for k in "vco" for i in range(len(names))])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = DAY) -> DataFrame:
    return running_sums(df, keys, order, {name: value}, width)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: Sequence[str] = (), ties: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Every left row with struct ``match``: the last right row at or before it, null if there is none.

    Right rows at one time are taken in the order of ``ties``, the last wins.
    """
    payload = F.struct(*[F.col(c) for c in right.columns])
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*ties).alias("__k") if ties else F.struct(F.lit(0).alias("t")).alias("__k"), payload.alias("__r"))
    whole = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__k"].dataType).alias("__k"), whole.alias("__l"))
    both = spanned(r.unionByName(l, allowMissingColumns=True), "__t", width)
    own = Window.partitionBy(*keys, SPAN).orderBy("__t", "__side", "__k").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*keys, SPAN).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__k"))).alias("__e"))
    across = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, SPAN, F.last("__e", ignorenulls=True).over(across).alias("__carried"))
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(own)).where("__side = 1")
    found = meet(found, ends, [*keys, SPAN])
    return found.select("__l.*", F.coalesce("__m", "__carried").alias("match"))


def trailing_counts(left: DataFrame, right: DataFrame, left_time: str, right_time: str, windows: dict[str, int | tuple[int, Column]], keys: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Adds, per entry of ``windows``, how many right rows lie in ``[time - window, time]``, both ends included.

    A window is a length, or a length and a condition on right rows. One pass: right rows and the two ends of
    every window are merged in time order, and a count is the difference of two running sums.
    """
    names = list(windows)
    length = {n: w if isinstance(w, int) else w[0] for n, w in windows.items()}
    some = {n: F.lit(1) if isinstance(w, int) else F.coalesce(w[1].cast("int"), F.lit(0)) for n, w in windows.items()}
    ends = sorted(set(length.values()))
    probes = F.array(F.struct(F.col(left_time).alias("at"), F.lit(2).alias("side"), F.lit(-1).alias("end")),
                     *[F.struct((F.col(left_time) - w).alias("at"), F.lit(0).alias("side"), F.lit(i).alias("end")) for i, w in enumerate(ends)])
    row = F.struct(*[F.col(c) for c in left.columns])
    p = left.select(*keys, row.alias("__row"), F.explode(probes).alias("p")).select(*keys, "__row", F.col("p.at").alias("__t"), F.col("p.side").alias("__side"), F.col("p.end").alias("__end"))
    # a lower end comes before the right rows at its time, the upper end after them
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1).alias("__side"), *[some[n].alias(f"__w{i}") for i, n in enumerate(names)])
    both = p.unionByName(r, allowMissingColumns=True)
    sums = {f"__n{i}": F.coalesce(F.col(f"__w{i}"), F.lit(0)).cast("long") for i in range(len(names))}
    both = running_sums(both, keys, ["__t", "__side"], sums, width).where("__side <> 1")
    at = lambda i, end: F.max(F.when(F.col("__end") == end, F.col(f"__n{i}")))
    wide = both.groupBy("__row").agg(F.count_if(F.col("__end") == -1).cast("int").alias("__copies"), *[(at(i, -1) - at(i, ends.index(length[n]))).alias(f"__d{i}") for i, n in enumerate(names)])
    wide = wide.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))  # repeated rows stay repeated
    return wide.select("__row.*", *[F.col(f"__d{i}").alias(n) for i, n in enumerate(names)])


#: Leading bits of a value's size that one scan counts by, and further ones that the next scan counts by.
LEADING, FURTHER = 12, 20
#: Smallest exponent of a double, and a number above all codes.
_LEAST, _BEYOND = -1074, 1 << 40


def _digits(v: Column) -> tuple[Column, Column]:
    """Two whole numbers that order doubles as their bits do: exponent and leading bits, and the bits after those.

    Only their order matters: they never fall where ``v`` rises. Zero is 0, infinities and not-a-numbers are beyond.
    """
    size = F.abs(v)
    e = F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LEAST)), F.lit(1023))
    part = size / F.pow(F.lit(2.0), e)  # from about 1 to 2
    whole = (v != 0) & (size < float("inf"))
    sign = F.when(v < 0, -1).otherwise(1)
    high = F.when(whole, (e - _LEAST + 1) * (2 << LEADING) + F.floor(part * (1 << LEADING))).when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(2 * _BEYOND)).otherwise(F.lit(_BEYOND))
    low = F.when(whole, F.floor(part * float(1 << LEADING + FURTHER))).otherwise(F.lit(0))
    return (sign * high).cast("long"), (sign * low).cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """``keys, point, quantile_value, n``: quantiles of ``n`` non-null values with linear interpolation, exact.

    Selection by digits, in two scans: the first counts values by exponent and leading bits, which tells in which of
    these classes a quantile's ranks lie; the second counts the values of those classes alone, by their further
    bits. Windows run over counts of classes, whose number the format of doubles bounds, whatever the number of
    values: no key's values meet in one task. What the second scan counted is written. Keys without a value have
    no rows.
    """
    from perigee.sources.tables import written

    by = [*keys, "__one"]
    x = df.select(*keys, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__one")).where("__v is not null")
    high, low = _digits(F.col("__v"))
    x = x.withColumn("__h", high)
    up = lambda *of: Window.partitionBy(*of[0]).orderBy(*of[1:]).rowsBetween(Window.unboundedPreceding, 0)
    classes = x.groupBy(*by, "__h").agg(F.count("*").alias("__n"))
    classes = classes.withColumns({"__to": F.sum("__n").over(up(by, "__h")), "__all": F.sum("__n").over(Window.partitionBy(*by))})
    # the ranks from 0 that a point lies between
    ask = F.array(*[F.struct(F.lit(float(p)).alias("point"), ((F.col("__all") - 1) * F.lit(float(p))).alias("at")) for p in points])
    inside = lambda rank, start, end: (rank >= F.col(start)) & (rank < F.col(end))
    hit = lambda start, end: F.filter(ask, lambda a: inside(F.floor(a["at"]), start, end) | inside(F.ceil(a["at"]), start, end))
    classes = classes.withColumn("__from", F.col("__to") - F.col("__n")).where(F.size(hit("__from", "__to")) > 0)
    n = meet(x, classes.select(*by, "__h", "__from", "__all"), [*by, "__h"]).withColumn("__l", low)
    n = n.groupBy(*by, "__h", "__l", "__v").agg(F.count("*").alias("__n"), F.first("__from").alias("__from"), F.first("__all").alias("__all"))
    n = written(n)
    by = [*by, "__h"]
    sums = n.groupBy(*by, "__l").agg(F.sum("__n").alias("__s"))
    sums = sums.select(*by, "__l", (F.sum("__s").over(up(by, "__l")) - F.col("__s")).alias("__o"))
    n = meet(n.withColumn("__sum", F.sum("__n").over(up([*by, "__l"], "__v"))), sums, [*by, "__l"])
    n = n.withColumn("__to", F.col("__from") + F.col("__o") + F.col("__sum")).withColumn("__start", F.col("__to") - F.col("__n"))
    hits = n.select(*keys, "__one", "__v", "__start", "__to", "__all", F.explode(hit("__start", "__to")).alias("a")).select("*", "a.*")
    lower = F.max(F.when(inside(F.floor("at"), "__start", "__to"), F.col("__v")))
    upper = F.max(F.when(inside(F.ceil("at"), "__start", "__to"), F.col("__v")))
    out = hits.groupBy(*keys, "__one", "point").agg(lower.alias("low"), upper.alias("high"), F.first("at").alias("at"), F.first("__all").alias("n"))
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return out.select(*keys, "point", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("quantile_value"), "n")


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """``keys``, the exact median under ``name``, and the number ``n`` of values it is of."""
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile_value").alias(name), "n")
