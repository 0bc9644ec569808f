"""The corpus pipeline: language, toxicity, near-duplicates, mixing and encoding, one stage after the other.

Rows are told apart by themselves, never by ``doc_id`` alone: null ids and ids that repeat take part in every
stage, and each row goes or stays by its own text. Columns beyond those of ``documents`` are dropped at the
first stage, whatever their names. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import langid, mixing, sentencepieces, simhash, toxicity
from perigee.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; a missing ``lang`` gets the prediction.

    Null, empty and letterless texts have none. Rows that repeat, with or without an id, all stay. Texts of any
    length are read whole. Without a row to learn from nothing has a language, and all go.
    """
    model = langid.train(docs.where(~langid.held_out(3, 1)))
    known = langid.predict(docs, model, COLUMNS).where(F.col("lang_pred") != langid.UND)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic, at a calibrated score of 0.5 or more.

    Equal texts share their fate, whatever their ids. Without labels of both kinds none is toxic, and all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~langid.held_out(5, 0)))
    return toxicity.predict(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``row`` for each row, written, so that every reader sees the same keys."""
    return saved(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipe-keyed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the row with the smallest id, once.

    Null ids come after all others. Of rows with that id in a group, repeated ones or other texts, one stays;
    equal ids in different groups don't touch each other.
    """
    docs = keyed(docs)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row")
    kept = simhash.grouped(docs, ("row",)).groupBy("part").agg(F.min_by("row", first).alias("row")).select("row")
    # texts meet decisions in a merge join at every size; what goes may be a third of all
    return docs.join(saved(kept, "pipe-kept").hint("merge"), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the mix takes; a row that it takes several times stands as many times.

    Rows with null or equal ids are rows of their own: each stands as often as it was taken itself, at most
    three times. A null source is a source. Texts without a word aren't taken.
    """
    docs = keyed(docs)
    taken = mixing.mix(docs, keep=("row",)).where("taken > 0").select("row", F.expr("cast(taken div size as int)").alias("copies"))
    out = docs.join(saved(taken, "pipe-taken").hint("merge"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_sha256, round_trip, ids`` of every row that is left; a null text is empty."""
    return sentencepieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Learned stages can't be said in SQL; tests hold the pipeline against its stages' own references.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipe-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
