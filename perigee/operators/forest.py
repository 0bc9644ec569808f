"""Isolation forests per channel, grown on bounded subsamples and scored in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perigee.functions.clock import is_finite
from perigee.operators.ordered import exact_quantiles, meet

TREES, SUBSAMPLE, CONTAMINATION, SEED = 100, 256, 0.01, 42
#: Training values of a channel that the trees' subsamples are drawn from, at most in expectation.
BOUND = 20_000
#: Forests, of at most 400 KB each, that are broadcast, and samples of a channel that meet its forest in one task.
BROADCAST, ROWS = 128, 1 << 20


def _c(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(values: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trees on single values as (cut points, depth of each interval between them)."""
    out = []
    for _ in range(TREES):
        sample = rng.choice(values, min(SUBSAMPLE, len(values)), replace=False)
        limit, cuts, depths = int(np.ceil(np.log2(max(2, len(sample))))), [], []

        def split(x: np.ndarray, depth: int) -> None:
            if depth >= limit or len(x) < 2 or x.min() == x.max():
                depths.append(depth + _c(len(x)))
                return
            cut = rng.uniform(x.min(), x.max())
            split(x[x < cut], depth + 1)
            cuts.append(cut)
            split(x[x >= cut], depth + 1)

        split(sample, 0)
        out.append((np.array(cuts), np.array(depths)))
    return out


def flattened(trees: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The mean depth of all trees as one step function of the value: its edges, and a depth for each interval."""
    edges = np.unique(np.concatenate([c for c, _ in trees])) if trees else np.zeros(0)
    at = np.concatenate([[-np.inf], edges])
    return edges, sum(d[np.searchsorted(c, at, "right")] for c, d in trees) / len(trees)


def anomaly(edges: np.ndarray, depths: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return 2 ** (-depths[np.searchsorted(edges, x, "right")] / max(_c(min(SUBSAMPLE, n)), 1e-9))


def fit(df: DataFrame, boundary: int, seed: int = SEED) -> DataFrame:
    """``channel, size, edges, depths, cut``: forest and cut-off per channel of finite training values, written.

    Each channel's trees grow in a task of their own on subsamples of a bounded sample and are kept as one step
    function of the value. The cut-off is the exact quantile of the scores of all training rows. Nothing reaches
    the driver.
    """
    from perigee.sources.tables import written

    x = df.where(is_finite("value") & (F.col("ts_ns") <= boundary) & F.col("channel").isNotNull()).select("channel", F.col("value").cast("double").alias("value"), "ts_ns")
    n = x.groupBy("channel").agg(F.count("*").alias("n"))
    part = F.shiftrightunsigned(F.xxhash64("channel", "ts_ns"), 11) / F.lit(float(1 << 53))

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("ts_ns")["value"].to_numpy()
        edges, depths = flattened(grow(values, np.random.default_rng(seed)))
        return pd.DataFrame({"channel": rows["channel"].iloc[:1], "size": [len(values)], "edges": [edges], "depths": [depths]})

    some = x.join(n, "channel").where(part < F.lit(float(BOUND)) / F.col("n")).drop("n")
    grown = written(some.groupBy("channel").applyInPandas(forest, "channel string, size long, edges array<double>, depths array<double>"))
    cuts = exact_quantiles(score(x, grown.withColumn("cut", F.lit(float("inf")))), ["channel"], "score", [1 - CONTAMINATION])
    return written(grown.join(cuts.select("channel", F.col("quantile_value").alias("cut")), "channel"))


def _scored(forest: tuple | None, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(value))
    if forest is None:
        return out, np.zeros(len(value), bool)
    edges, depths, n, cut = forest
    i = np.flatnonzero(np.isfinite(value))
    out[i] = anomaly(edges, depths, value[i], n)
    return out, (out > cut) & np.isfinite(value)


def score(df: DataFrame, forests: DataFrame) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``alarm``; values that aren't finite and channels without a forest score 0.

    Up to ``BROADCAST`` forests are broadcast and samples stay where they are. More of them meet the samples of
    their channel in parts of about ``ROWS`` rows, so neither all forests nor all samples of a channel are in one place.
    """
    if forests.count() <= BROADCAST:
        rows = forests.collect()
        held = df.sparkSession.sparkContext.broadcast({r["channel"]: (np.array(r["edges"]), np.array(r["depths"]), r["size"], r["cut"]) for r in rows})

        @F.pandas_udf("score double, alarm boolean")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for channel, value in batches:
                out, alarm, x = np.zeros(len(value)), np.zeros(len(value), bool), value.to_numpy(float)
                for c in channel.dropna().unique():
                    i = np.flatnonzero((channel == c).to_numpy())
                    out[i], alarm[i] = _scored(held.value.get(c), x[i])
                yield pd.DataFrame({"score": out, "alarm": alarm})

        return df.withColumn("__s", run("channel", F.col("value").cast("double"))).select(*df.columns, "__s.score", "__s.alarm")

    names = df.columns
    parts = df.groupBy("channel").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("__parts"))
    dealt = meet(df, parts, ["channel"]).withColumn("__part", F.pmod(F.xxhash64("ts_ns"), F.col("__parts")).cast("int")).drop("__parts")
    each = forests.join(parts, "channel").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")

    def both(samples: pa.Table, forest: pa.Table) -> pa.Table:
        r = forest.to_pylist()[0] if len(forest) else None
        value = samples.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False) if len(samples) else np.zeros(0)
        out, alarm = _scored(None if r is None else (np.array(r["edges"]), np.array(r["depths"]), r["size"], r["cut"]), value)
        return samples.select(names).append_column("score", pa.array(out, pa.float64())).append_column("alarm", pa.array(alarm, pa.bool_()))

    schema = StructType([*df.schema.fields, *StructType.fromDDL("score double, alarm boolean").fields])
    return dealt.groupBy("channel", "__part").cogroup(each.groupBy("channel", "__part")).applyInArrow(both, schema)
