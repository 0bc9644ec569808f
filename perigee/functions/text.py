"""Types, tokens and roles read off text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Header tokens by the role that a column may have. Fixed values.
ROLES = {
    "id": ("event", "eventid", "id", "identifier"),
    "start": ("begin", "start", "starttime"),
    "end": ("end", "endtime", "finish", "stop"),
    "channel": ("channel", "channels"),
    "category": ("category", "class", "subclass", "type"),
}
#: Header tokens of times and of measured values. Fixed values.
TIMES = ("date", "datetime", "epoch", "time", "timestamp")
VALUES = ("measurement", "reading", "value", "values")
#: Path tokens by the kind of a source, and suffixes of text tables and of telemetry. Fixed values.
LABELS = ("anomalies", "anomaly", "event", "events", "label", "labels")
COMMANDS = ("command", "commands", "telecommand", "telecommands")
TELEMETRY = ("channel", "channels", "telemetries", "telemetry")
TABLES = (".csv", ".tsv", ".txt")
ARRAYS = (".npy", ".npz", ".parquet")
#: Dates, and dates with a time and a zone, as ISO 8601 has them.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
#: First bytes by format.
MAGIC = (("93 4E 55 4D 50 59", "npy"), ("50 41 52 31", "parquet"), ("50 4B 03 04", "zip"), ("1F 8B", "gzip"), ("80 04", "pickle"), ("80 05", "pickle"))


def value_type(text: Column | str) -> Column:
    """``null`` (empty), ``boolean``, ``integer``, ``float`` (finite) or ``string`` of a trimmed value."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    number = t.try_cast("double")
    return (F.when(t.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false"), "boolean").when(t.rlike(INTEGER), "integer")
            .when(t.rlike(FLOAT) & number.isNotNull() & (F.abs(number) < float("inf")), "float").otherwise("string"))


def merged_type(types: Column) -> Column:
    """The type of a column from the set of its values' types: integers are floats, other mixtures strings."""
    t = F.array_sort(F.array_remove(F.array_distinct(types), "null"))
    return F.when(F.size(t) == 0, "null").when(F.size(t) == 1, t[0]).when(t == F.array(F.lit("float"), F.lit("integer")), "float").otherwise("string")


def tokens(text: Column | str) -> Column:
    """Distinct lower-case runs of letters and digits, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def _among(have: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(have, F.array(*map(F.lit, words)))


def source_kind(path: Column | str) -> Column:
    """What a file holds, by its path; a member of an archive stands behind ``!``.

    Label words anywhere come before command words anywhere, then telemetry words above the file's own name;
    then a text table is metadata, and another file with a telemetry word in its name and a suffix for numbers
    is telemetry.
    """
    path = F.col(path) if isinstance(path, str) else path
    member = F.regexp_replace(F.element_at(F.split(path, "!"), -1), r"\\", "/")
    name = F.element_at(F.split(member, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    stem = F.regexp_replace(name, r"(.)\.[^.]+$", "$1")
    above = tokens(F.regexp_replace(member, "/?[^/]*$", ""))
    every, own = tokens(path), tokens(stem)
    return (F.when(_among(every, LABELS), "labels").when(_among(every, COMMANDS), "telecommands")
            .when(_among(above, TELEMETRY) | _among(F.array_except(every, own), TELEMETRY), "telemetry").when(suffix.isin(*TABLES), "metadata")
            .when(_among(every, TELEMETRY) & suffix.isin(*ARRAYS), "telemetry").otherwise("unclassified"))


def roles(header: Column | str) -> Column:
    """All roles that a header's tokens suggest, in order."""
    t = tokens(header)
    return F.array_compact(F.array(*[F.when(_among(t, words), kind) for kind, words in ROLES.items()]))


def role(header: Column | str) -> Column:
    """The first role a header's tokens suggest, null if none."""
    return F.get(roles(header), 0)


def looks_iso(text: Column | str) -> Column:
    """Whether a value is a date or time in ISO 8601, of a day that exists."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(t.rlike(ISO) & F.substring(t, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def names_time(header: Column | str) -> Column:
    return _among(tokens(header), TIMES)


def names_value(header: Column | str) -> Column:
    return _among(tokens(header), VALUES)


def identifier_key(text: Column | str) -> Column:
    """Sort key of names such as ``channel_12``: what they name, their number, the text; others by their text, last of it."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.regexp_extract(text, r"^(.+?)_?(\d+)$", 2).try_cast("long")
    return F.struct(F.when(number.isNotNull(), F.regexp_extract(text, r"^(.+?)_?(\d+)$", 1)).otherwise(text).alias("kind"), F.coalesce(number, F.lit(2**63 - 1)).alias("number"), text.alias("text"))


def trailing_number(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("long")


def content_kind(content: Column) -> Column:
    """Format by first bytes, else text where at least 95 % of the first 4096 bytes are printable, else binary."""
    head = F.hex(F.substring(content, 1, 6))
    out = None
    for magic, kind in MAGIC:
        hit = head.startswith(magic.replace(" ", ""))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    first = F.hex(F.substring(content, 1, 4096))
    total = F.length(first) / 2
    odd = F.regexp_count(first, F.lit("(?:0[0-8BCEF]|1[0-9A-F]|7F)(?=(?:[0-9A-F]{2})*$)"))
    return out.when(total == 0, "empty").when(1 - odd / F.nullif(total, F.lit(0)) >= 0.95, "text").otherwise("binary")


def digests(content: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(content, 256), "md5": F.md5(content), "crc32": F.crc32(content)}


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))
