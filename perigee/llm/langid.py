"""Language identification with string kernels.

The kernel counts the character n-grams (one to three, blended) that two texts both hold, presence only, over
the geometric mean of their own numbers. A few landmark texts per language give the Nyström map, and
one-versus-rest ridge regression is fitted in its space on a bounded sample. Since the kernel is linear in
presence vectors, landmarks, map and weights multiply out to one matrix, n-grams by languages, and texts are
scored in batches by one product with it. N-grams are exact numbers, 21 bits a character; nothing is hashed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.llm.common import saved, table, text_of

UND = "und"
#: Bounds of the sample: distinct texts of each language to fit on, and those of them that are landmarks.
PER_LANG, LANDMARKS = 800, 64
#: Bounds over all languages, which share them evenly: texts, landmarks, and n-grams of those texts. Every language
#: has a text of its own as long as there are no more of them than texts.
TEXTS, MARKS, NUMBERS = 25_600, 2048, 1 << 25
#: Texts drawn by hash for each that is wanted, as distinct texts are estimated to a few percent.
DRAW = 1.25
#: N-grams times languages up to which landmarks and weights are multiplied out.
DENSE = 1 << 25
ORDERS = 3
RIDGE = 1e-3
#: Steepness of the score as a probability of the best language against the others, and the most texts of a product.
STEEP, BATCH = 6.0, 64
_PIECE = 1 << 20


#: Stands for every run of other signs; the number of no letter.
GAP = 1


@cache
def _letters() -> np.ndarray:
    """Letters (Unicode category L) and marks as themselves, all else as ``GAP``; letters have a bit above it."""
    out = np.full(0x110000, GAP, np.uint32)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            out[i] = i | (1 << 31 if kind == "L" else 0)
    return out


def _distinct(c: np.ndarray) -> list[np.ndarray]:
    """The distinct n-grams of one to three of a run of characters, as numbers."""
    signs = np.unique(c)
    k = len(signs)
    if k**ORDERS > 16 * len(c) + (1 << 16):  # many signs: by sorting
        out, key = [signs.astype(np.int64)], c.astype(np.int64)
        for n in range(2, ORDERS + 1):
            key = key[:-1] << 21 | c[n - 1:]
            out.append(np.unique(key))
        return out
    d, signs = np.searchsorted(signs, c), signs.astype(np.int64)
    out, key, name = [signs], d, signs
    for n in range(2, ORDERS + 1):
        key = key[:-1] * k + d[n - 1:]
        held = np.zeros(k**n, bool)
        held[key] = True
        found = np.flatnonzero(held)
        value = signs[found % k]
        for m in range(1, n):
            value = value | signs[found // k**m % k] << 21 * m
        out.append(value)
    return out


def grams(text: str) -> np.ndarray | None:
    """The distinct n-grams of a whole text, sorted; None where it has no letter. Long texts are read in pieces."""
    found, tail, held = False, np.full(1, GAP, np.uint32), []
    for at in range(0, len(text), _PIECE):
        code = np.frombuffer(text[at: at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _letters()[code]
        found = found or bool((c >> 31).any())
        c = np.concatenate([tail, c & np.uint32(0x1FFFFF)] + ([] if at + _PIECE < len(text) else [np.full(1, GAP, np.uint32)]))
        c = np.concatenate([c[:1], c[1:][(c[1:] != GAP) | (c[:-1] != GAP)]])  # runs of other signs count as one
        held.append(np.concatenate(_distinct(c)))
        tail = c[-ORDERS + 1:]
    return np.unique(np.concatenate(held)) if found else None


class Landmarks:
    """Landmark texts by n-gram, one list after the other, so that memory grows with what they hold."""

    def __init__(self, texts: list[np.ndarray]):
        self.kept = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int64)
        self.size = np.array([1 / np.sqrt(len(g)) for g in texts])
        places = [_places(self.kept, g) for g in texts]
        held = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(held, kind="stable")
        self.marks = np.repeat(np.arange(len(texts)), [len(p) for p in places])[order].astype(np.int32)
        self.first = np.searchsorted(held[order], np.arange(len(self.kept) + 1))

    def kernel(self, g: np.ndarray) -> np.ndarray:
        """Kernel of a text's n-grams with every landmark."""
        p = _places(self.kept, g)
        wide = self.first[p + 1] - self.first[p]
        at = np.repeat(self.first[p] - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
        return np.bincount(self.marks[at], minlength=len(self.size)) * self.size / np.sqrt(len(g))

    def multiplied(self, by_mark: np.ndarray) -> np.ndarray:
        """Weights of the n-grams: those of the landmarks that hold them, added up."""
        out = np.zeros((len(self.kept), by_mark.shape[1]), np.float32)
        which = np.repeat(np.arange(len(self.kept)), np.diff(self.first))
        for lang, w in enumerate((self.size[:, None] * by_mark).T):
            out[:, lang] = np.bincount(which, w[self.marks], len(self.kept))
        return out


class Model:
    """``langs``, landmarks with a weight by language each, and ``bias`` by language.

    While n-grams times languages are few, both are multiplied out to a weight of each n-gram.
    """

    def __init__(self, langs: list[str], landmarks: Landmarks, by_mark: np.ndarray, bias: np.ndarray):
        self.langs, self.kept, self.bias = langs, landmarks.kept, bias
        dense = len(self.kept) * len(langs) <= DENSE
        self.weights = landmarks.multiplied(by_mark) if dense else None
        self.landmarks, self.by_mark = (None, None) if dense else (landmarks, by_mark)

    def _scores(self, held: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.stack([self.landmarks.kernel(g) for g in held]) @ self.by_mark + self.bias
        x, norm = np.zeros((len(held), len(self.kept)), np.float32), np.array([np.sqrt(len(g)) for g in held], np.float32)
        for i, g in enumerate(held):
            x[i, _places(self.kept, g)] = 1
        return (x @ self.weights) / norm[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        batch = max(1, min(BATCH, (1 << 22) // max(1, len(self.kept), len(self.langs))))
        for at in range(0, len(texts) if self.langs else 0, batch):
            have = [(i, g) for i in range(at, min(at + batch, len(texts))) if (g := grams(texts[i])) is not None]
            if have:
                f = self._scores([g for _, g in have])
                e = np.exp(STEEP * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
                for (i, _), best, score in zip(have, f.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)):
                    names[i], scores[i] = self.langs[best], float(score)
        return names, scores


def _places(kept: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where those n-grams of ``g`` stand in ``kept`` that it has."""
    if not len(kept):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(kept, g), len(kept) - 1)
    return at[kept[at] == g]


def fit_kernel(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on (language, n-grams) pairs; the first ``landmarks`` of each language are the landmarks, ``MARKS`` in all.

    Sums of products are built block by block, so nothing is larger than landmarks squared.
    """
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return Model([], Landmarks([]), np.zeros((0, 0)), np.zeros(0, np.float32))
    code = {lang: i for i, lang in enumerate(langs)}
    chosen, n = [], dict.fromkeys(langs, 0)
    for i, (lang, _) in enumerate(samples):
        if n[lang] < min(landmarks, max(1, MARKS // len(langs))) and len(chosen) < MARKS:
            n[lang] += 1
            chosen.append(i)
    marks = Landmarks([samples[i][1] for i in chosen])
    values, vectors = np.linalg.eigh(np.stack([marks.kernel(samples[i][1]) for i in chosen]))
    good = values > 1e-8 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    y = np.array([code[lang] for lang, _ in samples])
    share = 1 / np.bincount(y, minlength=len(langs))  # every language weighs the same
    gram, right = ridge * np.eye(nystrom.shape[1] + 1), np.zeros((nystrom.shape[1] + 1, len(langs)))
    for at in range(0, len(samples), 1024):
        part = y[at: at + 1024]
        x = np.stack([marks.kernel(g) for _, g in samples[at: at + 1024]]) @ nystrom
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        gram += x.T @ (x * share[part, None])
        np.add.at(right.T, part, x * share[part, None])
    w = np.linalg.solve(gram, right)
    return Model(langs, marks, nystrom @ w[:-1], w[-1].astype(np.float32))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, hash and n-grams of each text with a letter, once a task however often it stands there."""
    seen = set()
    for batch in batches:
        rows = []
        for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, h) not in seen:
                seen.add((lang, h))
                if (g := grams(text)) is not None:
                    rows.append((lang, h, g))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["lang", "h", "grams"])


def uniform(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most ``per_lang`` distinct texts of each language, those of the lowest hashes, and ``TEXTS`` in all.

    Rows without a language or text don't count, nor do texts without a letter. A text of many copies is drawn
    once, whatever its ids, and counts once: the rate of a language is over its distinct texts, so one whose rows
    are few texts over and over is learned from all of these. A few more than wanted are picked by their hash
    alone, without a shuffle; ranks then cut what is too many. Of more than ``TEXTS`` languages the most frequent
    have a text. Texts of very many n-grams leave room for fewer of them a language, one at least. The driver gets the sample's
    n-grams, ``NUMBERS`` and one text a language at most.
    """
    have = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("h"))
    counts = have.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(lettered, 0.02).alias("texts"))
    counts = saved(counts.orderBy(F.desc("n"), "lang").limit(TEXTS), "lang-counts")
    langs = counts.count()
    if not langs:
        return fit_kernel([])
    per_lang = min(per_lang, max(1, TEXTS // langs))
    # a row a language, TEXTS at most
    rates = F.broadcast(counts.select("lang", (F.lit(DRAW * per_lang) / F.greatest("texts", F.lit(1))).alias("rate")))
    drawn = F.shiftrightunsigned(F.xxhash64("text", F.lit(8)), 11) / F.lit(float(1 << 53))
    rows = have.join(rates, "lang").where(drawn < F.col("rate")).select("lang", "h", "text")
    got = rows.mapInArrow(_gram_rows, "lang string, h long, grams array<long>").groupBy("lang", "h").agg(F.first("grams").alias("grams"))
    order = Window.partitionBy("lang").orderBy("h")
    got = saved(got.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_lang), "lang-sample")
    sizes = got.groupBy("at").agg(F.sum(F.size("grams")).alias("n")).orderBy("at").collect()
    held = np.cumsum([r["n"] for r in sizes])
    most = max(1, int(np.searchsorted(held, NUMBERS, side="right")))
    got = got.where(F.col("at") <= most).toPandas().sort_values(["at", "lang"])
    return fit_kernel([(lang, np.asarray(g, np.int64)) for lang, g in zip(got["lang"], got["grams"])], landmarks)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred, score`` for every whole text; ``und`` and 0 for null and letterless texts."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of a bounded number of landmarks
    rest = [k for k in keep if k != "text"]
    x = docs.select("text", *rest)
    fields = "".join(f"`{k}` {x.schema[k].dataType.simpleString()}, " for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.value.predict([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return x.mapInArrow(run, fields + "lang_pred string, score double")


def held_out(n: int, at: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == at


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the other two thirds of the rows.

    Held out are documents whose crc32 of the id has remainder 1 by 3. The language, source and id of a
    document are no input to its prediction; equal texts get equal results. Null texts and those without a
    letter (Unicode category L; numbers such as ``½`` aren't) are ``und`` at 0. A null id counts as an empty
    string, repeated rows and ids are rows of their own, other columns are ignored. Without a row to learn
    from all is ``und``; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, ("doc_id", "held_out"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
