"""Manifests: split boundaries, event counts, digests of tables and versions, as canonical JSON."""

from __future__ import annotations

import platform
import subprocess
import time
import uuid
from typing import Any

import pyspark
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions.clock import SECOND, split_of
from perigee.operators import labels
from perigee.sources.tables import content_digest, identity

#: The published calendar split: 2006-10-01 and 2007-01-01 UTC. Fixed values.
VALIDATION, TEST = 1_159_660_800 * SECOND, 1_167_609_600 * SECOND
#: Ids that a manifest lists; more of them are an error, as a manifest is read by people.
LISTED = 10_000


def iso(ts_ns: int) -> str:
    import datetime

    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=ts_ns // 1000)
    return at.isoformat() + "Z"


def boundaries(first: int, validation: int, test: int, last: int) -> dict[str, Any]:
    """The parts of a split, upper ends included, lower ends only for the first."""
    if not first <= validation < test <= last:
        raise ValueError("split boundaries must be ordered inside the extent")
    part = lambda a, b, low: {"start" if low else "start_after": iso(a), "end": iso(b), "start_inclusive": low, "end_inclusive": True}
    return {"start": iso(first), "end": iso(last), "train": part(first, validation, True), "validation": part(validation, test, False), "test": part(test, last, False)}


def _nested(counts: DataFrame, depth: int) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for r in counts.where(F.col("depth") == depth).collect():  # one row a part, category and class
        at = out
        for name in [r["split"], r["category"], r["class"]][: 2 if depth == 1 else 3][:-1]:
            at = at.setdefault(str(name), {})
        at[str(r["category"] if depth == 1 else r["class"])] = r["event_count"]
    return out


def split_manifest(ev: DataFrame, first: int, last: int, validation: int = VALIDATION, test: int = TEST, telemetry: DataFrame | None = None, dataset: str | None = None) -> dict[str, Any]:
    """What a split makes of events ``event_id, category, class, start_ns, end_ns`` and of telemetry rows.

    A time outside the extent is an error. Only counts and the ids that cross a boundary reach the driver.
    """
    x = labels.assigned(ev, validation, test, first, last)
    counts = labels.nested_counts(x)
    crossing = {}
    for name in ("validation", "test"):
        ids = [r[0] for r in x.where(F.col(f"crosses_{name}")).select("event_id").orderBy("event_id").limit(LISTED + 1).collect()]
        if len(ids) > LISTED:
            raise ValueError(f"more than {LISTED} events cross the {name} boundary")
        crossing[name] = ids
    out = {"manifest_version": 1, "dataset": dataset, "boundaries": boundaries(first, validation, test, last), "events": ev.count(), "events_by_category": _nested(counts, 1), "events_by_class": _nested(counts, 0), "crossing": crossing}
    if telemetry is not None:
        parts = telemetry.groupBy(split_of("ts_ns", validation, test, first, last).alias("split")).agg(F.count("*").alias("n"))
        out["telemetry_rows"] = {r["split"]: r["n"] for r in parts.collect()}
    return out


def subset_manifest(tables: dict[str, DataFrame], config: dict[str, Any]) -> dict[str, Any]:
    """Rows and content digests of written tables, the configuration and its digest, and versions."""
    return {"manifest_version": 1, "config": config, "identity": identity(config), "tables": {k: content_digest(v) for k, v in sorted(tables.items())}, "versions": {"python": platform.python_version(), "spark": pyspark.__version__}}


def git_state(folder: str = ".") -> dict[str, Any] | None:
    """Commit, branch and whether tracked files differ from it; None outside a repository or without git."""
    def said(*words: str) -> str:
        return subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=True, timeout=30).stdout.strip()

    try:
        return {"commit": said("rev-parse", "HEAD"), "branch": said("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(said("status", "--porcelain", "--untracked-files=no"))}
    except (OSError, subprocess.SubprocessError):
        return None


#: Figures of finished stages that are summed, by the name they get; memory is the most of any.
_SUMMED = {"tasks": "numTasks", "failed_tasks": "numFailedTasks", "run_ms": "executorRunTime", "cpu_ms": "executorCpuTime", "gc_ms": "jvmGcTime", "input_bytes": "inputBytes", "input_rows": "inputRecords", "output_bytes": "outputBytes",
           "output_rows": "outputRecords", "shuffle_read_bytes": "shuffleReadBytes", "shuffle_write_bytes": "shuffleWriteBytes", "memory_spilled_bytes": "memoryBytesSpilled", "disk_spilled_bytes": "diskBytesSpilled"}


class Run:
    """Resource figures of what a session runs inside ``with Run(spark, name) as r``: ``r.record`` afterwards.

    Jobs are marked by a job group; stages of theirs are looked up in Spark's status store, executors' peak memory too.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str = "."):
        self.spark, self.name, self.folder = spark, name, folder
        self.group = f"{name}-{uuid.uuid4().hex}"
        self.record: dict[str, Any] = {}

    def __enter__(self) -> Run:
        self.began = time.time()
        self.spark.sparkContext.setJobGroup(self.group, self.name)
        return self

    def __exit__(self, kind, error, trace) -> None:
        sc = self.spark.sparkContext
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = sorted(sc.statusTracker().getJobIdsForGroup(self.group))
        stages = sorted({s for j in jobs if (info := sc.statusTracker().getJobInfo(j)) for s in info.stageIds})
        self.record = {"name": self.name, "seconds": round(time.time() - self.began, 3), "failed": kind is not None, "jobs": len(jobs), "stages": stage_figures(sc, stages), "executors": executor_figures(sc),
                       "git": git_state(self.folder), "versions": {"python": platform.python_version(), "spark": pyspark.__version__}}


def stage_figures(sc: SparkContext, stages: list[int]) -> dict[str, int]:
    """Sums over stages and the largest execution memory of any; stages that didn't run count as skipped."""
    store = sc._jsc.sc().statusStore()
    out = dict.fromkeys(["stages", "skipped", *_SUMMED, "peak_execution_memory_bytes"], 0)
    for s in stages:
        try:
            data = store.lastStageAttempt(s)
        except Py4JError:  # dropped from the store, or never begun
            out["skipped"] += 1
            continue
        if data.status().toString() == "SKIPPED":
            out["skipped"] += 1
            continue
        out["stages"] += 1
        for name, of in _SUMMED.items():
            out[name] += getattr(data, of)() // (1_000_000 if name == "cpu_ms" else 1)
        out["peak_execution_memory_bytes"] = max(out["peak_execution_memory_bytes"], data.peakExecutionMemory())
    return out


def executor_figures(sc: SparkContext) -> list[dict[str, Any]]:
    """Peak memory of each executor, the driver's among them, where Spark has measured it."""
    store, out = sc._jsc.sc().statusStore(), []
    every = store.executorList(False)
    for i in range(every.size()):
        e = every.apply(i)
        peak = e.peakMemoryMetrics()
        kinds = ("JVMHeapMemory", "JVMOffHeapMemory", "OnHeapExecutionMemory", "ProcessTreePythonRSSMemory")
        out.append({"id": e.id(), "cores": e.totalCores(), "max_memory_bytes": e.maxMemory(), "peak": {k: peak.get().getMetricValue(k) for k in kinds} if peak.isDefined() else None})
    return sorted(out, key=lambda e: e["id"])
