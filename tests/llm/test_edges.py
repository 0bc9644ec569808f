"""Null and repeated ids, null, empty and very long texts, clashing columns and empty tables, for every operator on texts."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from perigee.llm import langid, mixing, sentencepieces, simhash, token_counts, toxicity, webp  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")

ROWS = [(1, "a b c d"), (1, "a b c d"), (1, "another text of it"), (None, "a b c d"), (None, None), (None, None), (2, ""), (3, "word " * 60_000), (None, "x" * 200_000), (4, "½ 中文 \U0001f600"), (5, "  "), (-7, "a b c d")]


def tox(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return toxicity.assess(docs, labels)


OPERATORS = {
    "webp": webp.stored_and_read,
    "toxicity": tox,
    "pieces": lambda d: sentencepieces.digest(d, public_tokenizers.path("piece_bpe_32k.model")),
    "mixing": mixing.mix,
    "language": langid.identify,
    "tokens": lambda d: token_counts.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    docs = spark.createDataFrame([(i, t, "en" if i == 1 else None, "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    for clash in ("n_bytes", "score", "fp", "size", "media", "row", "h", "label"):
        docs = docs.withColumn(clash, F.lit("clash"))
    got = OPERATORS[name](docs).collect()
    assert len(got) == len(ROWS)
    count = lambda ids: sorted(ids, key=str)
    assert count(r["doc_id"] for r in got) == count(i for i, _ in ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    if name not in ("mixing", "simhash"):
        # the four rows of one text, whatever their ids, come out alike
        own = [tuple(r[c] for c in r.asDict() if c not in ("doc_id", "held_out")) for r in got if r["doc_id"] in (1, -7)]
        assert max(map(own.count, own)) >= 3
    if name == "simhash":
        parts = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
        assert parts[-7, next(r["fingerprint"] for r in got if r["doc_id"] == -7)] == -7 and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    if name == "mixing":
        assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
