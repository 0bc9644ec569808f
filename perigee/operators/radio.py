"""Public radio observations: normalisation, status and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions.clock import lenient, recent

STATES = ("AVAILABLE", "NO RECENT DATA", "NO TRANSMITTER", "NO DECODER", "UNAVAILABLE")


def first_of(json: str, *keys: str) -> Column:
    """The first of the keys that holds something; empty text and 0 count as nothing."""
    got = [F.get_json_object(json, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when((g != "") & (g != "0") & (F.lower(g) != "false"), g) for g in got])


def station(name: Column, number: Column) -> Column:
    """Name and number of a station in the forms that they allow."""
    name, number = F.nullif(name, F.lit("")), F.nullif(number.cast("string"), F.lit(""))
    return (F.when(name.isNotNull() & number.isNotNull(), F.concat(name, F.lit(" (#"), number, F.lit(")"))).when(name.isNotNull(), name)
            .when(number.isNotNull(), F.concat(F.lit("Station #"), number)).otherwise("Unknown station"))


def observations(raw: DataFrame) -> DataFrame:
    """``object_id, ordinal, observation_id, at, station, status`` of JSON text in ``payload``."""
    at = lenient(first_of("payload", "start", "end", "timestamp"))
    return raw.select("object_id", "ordinal", F.get_json_object("payload", "$.id").alias("observation_id"), at.alias("at"),
                      station(F.get_json_object("payload", "$.station_name"), F.get_json_object("payload", "$.station")).alias("station"), F.get_json_object("payload", "$.status").alias("status"))


def frames(raw: DataFrame) -> DataFrame:
    """``object_id, ordinal, at, frame, decoded`` of JSON text; decoded fields as a map of text."""
    decoded = F.from_json(F.coalesce(F.get_json_object("payload", "$.decoded_data"), F.lit("{}")), "map<string,string>")
    return raw.select("object_id", "ordinal", lenient(first_of("payload", "timestamp", "time")).alias("at"), first_of("payload", "frame", "raw", "payload").alias("frame"), decoded.alias("decoded"))


def status(objects: DataFrame) -> DataFrame:
    """Adds ``rf_status`` from ``known, transmitters, recent_observations, decoders``: the first lack decides."""
    s = (F.when(~F.col("known"), "NO RECENT DATA").when(F.col("transmitters") == 0, "NO TRANSMITTER").when(F.col("recent_observations") == 0, "NO RECENT DATA")
         .when(F.col("decoders") == 0, "NO DECODER").otherwise("AVAILABLE"))
    return objects.withColumn("rf_status", s)


def recent_ids(obs: DataFrame, now: Column, hours: float) -> DataFrame:
    """Distinct ids with an observation in the last hours; what lies ahead or can't be read doesn't count."""
    return obs.where(recent(F.col("at"), now, hours)).select("object_id").distinct()


def availability(obs: DataFrame, transmitters: DataFrame, now: Column, hours: float) -> DataFrame:
    """Per object: counts, first observation in feed order, status."""
    o = obs.groupBy("object_id").agg(F.count("*").alias("observations"), F.count_if(recent(F.col("at"), now, hours)).alias("recent_observations"), F.min_by("at", "ordinal").alias("latest"))
    t = transmitters.groupBy("object_id").agg(F.count("*").alias("transmitters"), F.count_if("decoder").alias("decoders"))
    x = o.join(t, "object_id", "full").fillna(0, ["observations", "recent_observations", "transmitters", "decoders"])
    return status(x.withColumn("known", (F.col("observations") > 0) | (F.col("transmitters") > 0)))
