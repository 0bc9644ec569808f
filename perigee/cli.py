"""Command line over the library: profile files, list archives, digests, splits, recurrence, command context, queries."""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def new_run(folder: str, config: dict) -> Path:
    """A run folder of its own, named by the configuration's digest; never one that exists."""
    from perigee.sources.tables import identity, write_json

    path = Path(folder) / f"{identity(config)[:12]}-{uuid.uuid4().hex[:8]}"
    path.mkdir(parents=True, exist_ok=False)
    write_json(config, str(path / "config.json"))
    return path


def report(spark: SparkSession, args: argparse.Namespace) -> str:
    """The manifest or report that a command asks for."""
    from pyspark.sql import functions as F

    from perigee.operators import context, labels
    from perigee.sources import manifests, tables

    ev = tables.read_parquet(spark, args.events)
    validation, test = args.validation or manifests.VALIDATION, args.test or manifests.TEST
    if args.command == "split":
        first, last = ev.agg(F.min("start_ns"), F.max("end_ns")).first()
        return tables.canonical_json(manifests.split_manifest(ev, min(first, validation), max(last, test), validation, test))
    x = labels.assigned(ev, validation, test)
    if args.command == "recurrence":
        return tables.markdown(labels.recurrence(x).orderBy("category", "class"), "Recurrence of event classes")
    return tables.markdown(context.proximity(x, tables.read_parquet(spark, args.commands)).orderBy("category", "window"), "Commands before events")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="perigee")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("profile", "profile a delimited text file"), ("members", "list ZIP members"), ("digests", "digest files")):
        sub.add_parser(name, help=what).add_argument("path")
    for name, what in (("split", "manifest of the calendar split of an event table"), ("recurrence", "recurrence of event classes"), ("context", "commands before events")):
        c = sub.add_parser(name, help=what)
        c.add_argument("events", help="Parquet of event_id, category, class, start_ns, end_ns")
        c.add_argument("--validation", type=int, help="last nanosecond of the training part")
        c.add_argument("--test", type=int, help="last nanosecond of the validation part")
        c.add_argument("--out", help="file of the report; else it is printed")
        if name == "context":
            c.add_argument("commands", help="Parquet of telecommand, ts_ns, priority")
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("name")
    q.add_argument("tables", help="folder of Parquet tables")
    q.add_argument("--out", help="Parquet folder; else the first rows are printed")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("perigee").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("split", "recurrence", "context"):
        text = report(spark, args)
        if args.out:
            Path(args.out).write_text(text, encoding="utf-8")
        else:
            print(text)
        return 0
    if args.command == "profile":
        from perigee.operators.profile import delimited

        got = delimited(spark, args.path)
        got["summary"].show(truncate=False)
        df = got["columns"]
    elif args.command == "members":
        from perigee.sources.archives import members

        df = members(spark, args.path)
    elif args.command == "digests":
        from perigee.sources.tables import file_digests

        df = file_digests(spark, args.path)
    else:
        from perigee.plans import queries

        if args.name not in queries():
            print("unknown query; known: " + " ".join(sorted(queries())), file=sys.stderr)
            return 2
        df = queries()[args.name](spark, args.tables)
        if args.out:
            df.write.mode("errorifexists").parquet(args.out)
            return 0
    df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
