"""The queries of the corpus operators, by name, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perigee.llm import centroids, langid, licenses, lsh, mixing, neardup_vectors, sentencepieces, simhash, token_counts, toxicity, warc, webp, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_webp": webp.op1_webp,
        "op2_licenses": licenses.op2_licenses,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sentencepiece": sentencepieces.op4_sentencepiece,
        "op5_near_vectors": neardup_vectors.op5_near_vectors,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_warc": warc.op7_warc,
        "op8_language_id": langid.op8_language_id,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_simhash": simhash.op10_simhash,
        "op11_neighbours": lsh.op11_neighbours,
        "op12_whitening": whitening.op12_whitening,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.OP2_SQL, "op6_source_mixing": mixing.OP6_SQL, "op7_warc": warc.OP7_SQL}
