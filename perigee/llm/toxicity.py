"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon, how often its words stand near a second person, capitals, punctuation
and obfuscation. The lexicon is words and word stems that labelled toxic documents hold far more often than
others; lexicon, trees and calibration are fitted on a bounded sample of the labelled rows, of which those
that calibrate the scores are kept from the lexicon and the trees.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import saved, table, text_of
from perigee.llm.langid import held_out, uniform

#: Bounds of what is fitted: labelled rows, lexicon entries; and one in so many rows calibrates.
SAMPLE, LEXICON, CALIBRATE = 20_000, 600, 4
STEMS = (4, 5, 6)
#: A lexicon entry stands in this many sampled toxic documents, as a count and a share, and is this much likelier there (log).
SUPPORT, SUPPORT_SHARE, LOG_ODDS = 3, 0.004, 3.2
#: And the difference of its two shares is this many standard errors, which keeps chance out of small samples.
ERRORS = 6.0
TREES, DEPTH, RATE, LEAST_LEAF, BINS = 60, 4, 0.15, 8, 32
#: Words within this distance of a second person count as aimed at it.
NEAR = 4
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti eres usted ustedes vosotros".split())
PLAIN = str.maketrans("013457@$!|€", "oieastasiie")
WORD, STEM, YOU, VEILED, LOUD, LONG = 1, 2, 4, 8, 16, 32
KEPT = 1 << 18
FEATURES = ("word_density", "stem_density", "log_words", "log_stems", "distinct", "near_second", "second", "capitals", "loud", "punctuation", "exclamations", "veiled", "lengthened", "log_tokens")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = string.punctuation + "¡¿«»…“”„‘’"
CAPITAL, SIGN, BANG = 1, 2, 4


@cache
def _kinds() -> np.ndarray:
    """For every code point, whether it is a capital, punctuation (category P, and ASCII's own), an exclamation mark."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        out[i] = CAPITAL * (kind in ("Lu", "Lt")) | SIGN * (kind[0] == "P")
    out[[ord(c) for c in string.punctuation]] |= SIGN
    out[[ord(c) for c in "!！"]] |= BANG
    return out


def terms(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class Marks(dict):
    """What a white-space token shows, as bits; computed once for each distinct token."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def _hits(self, word: str) -> int:
        known = self.lexicon
        if word in known:
            return WORD
        return STEM if any(word[:k] + "*" in known for k in STEMS if len(word) > k) else 0

    def __missing__(self, token: str) -> int:
        got = 0
        for w in _LETTERS.findall(token):
            low = w.lower()
            got |= self._hits(low) | (YOU if low in SECOND else 0)
            if len(w) > 2 and w.isupper():
                got |= LOUD
            if any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2)):
                got |= LONG
        if not got & (WORD | STEM):
            core = token.strip(_EDGES)
            if core and not core.isalpha() and any(c.isalpha() for c in core):
                for plain in {re.sub(r"[\W_]", "", core.translate(PLAIN)).lower(), re.sub(r"[\W_\d]", "", core).lower()}:
                    if self._hits(plain) & WORD:
                        got |= VEILED | WORD
        if len(self) > KEPT:
            self.clear()
        self[token] = got
        return got


def features(text: str, marks: Marks) -> list[float]:
    """The dense features of one whole text; all 0 for an empty one."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    m = np.fromiter(map(marks.__getitem__, tokens), np.uint8, n)
    words, stems = np.count_nonzero(m & WORD), np.count_nonzero(m & STEM)
    hit = np.flatnonzero(m & (WORD | STEM))
    you = np.flatnonzero(m & YOU)
    near = distinct = 0
    if len(hit):
        distinct = len({tokens[i].lower().strip(_EDGES) for i in hit.tolist()})
        if len(you):
            i = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - hit), np.abs(you[np.maximum(i - 1, 0)] - hit))
            near = np.count_nonzero(gap <= NEAR)
    size = len(text)
    # every kind is one bit, so a count by value has all of them
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8)
    capitals, signs, bangs = (int(kinds[[i for i in range(8) if i & bit]].sum()) for bit in (CAPITAL, SIGN, BANG))
    return [words / n, stems / n, math.log1p(words), math.log1p(stems), math.log1p(distinct), near / n, len(you) / n, capitals / size,
            np.count_nonzero(m & LOUD) / n, signs / size, bangs / size, np.count_nonzero(m & VEILED) / n, np.count_nonzero(m & LONG) / n, math.log1p(n)]


# ---------------------------------------------------------------- trees


class Trees:
    """Boosted regression trees on log-loss over binned features, complete to a fixed depth."""

    def __init__(self):
        self.base, self.feature, self.edge, self.leaf = 0.0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        # quantiles of rare features are all one value; what lies beyond it gets edges of its own
        edges = [np.unique(np.concatenate([e, np.quantile(t, np.linspace(0, 1, 9)[:-1]) - 1e-12])) if len(t := x[x[:, j] > e[-1], j]) else e for j, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        width = max(map(len, edges)) + 1
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        f, made = np.full(len(y), self.base), []
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            node, feature, edge = np.zeros(len(y), np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                n, first = 2**level, 2**level - 1
                best, pick = np.full(n, 1e-6), [(0, np.inf, width)] * n
                for j in range(x.shape[1]):
                    cell = node * width + binned[:, j]
                    sums = [np.bincount(cell, w, n * width).reshape(n, width).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                    (lg, lh, lc), (tg, th, tc) = sums, [s[:, -1:] for s in sums]
                    score = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                    score[(lc < LEAST_LEAF) | (tc - lc < LEAST_LEAF)] = 0
                    score[:, len(edges[j]):] = 0
                    top = score.argmax(axis=1)
                    for k in np.flatnonzero(score[np.arange(n), top] > best):
                        best[k], pick[k] = score[k, top[k]], (j, edges[j][top[k]], top[k])
                for k, (j, e, _) in enumerate(pick):
                    feature[first + k], edge[first + k] = j, e
                js, cuts = np.array([p[0] for p in pick]), np.array([p[2] for p in pick])
                node = node * 2 + (binned[np.arange(len(y)), js[node]] > cuts[node])
            leaf = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            f += leaf[node]
            made.append((feature, edge, leaf))
        self.feature, self.edge, self.leaf = (np.array(v) for v in zip(*made))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, edge, leaf in zip(self.feature, self.edge, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            out += leaf[node - 2**DEPTH + 1]
        return out


class Isotonic:
    """Pool-adjacent-violators: a rising step function from raw scores to shares of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        values, index = np.unique(x, return_inverse=True)
        total, count = np.bincount(index, y), np.bincount(index)
        blocks: list[list[float]] = []
        for v, s, c in zip(values.tolist(), total.tolist(), count.tolist()):
            blocks.append([v, v, s, c])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                _, hi, s, c = blocks.pop()
                blocks[-1][1] = hi
                blocks[-1][2] += s
                blocks[-1][3] += c
        # half a row of prior at the middle keeps pure blocks off 0 and 1
        self.x = np.array([v for b in blocks for v in b[:2]])
        self.y = np.array([v for b in blocks for v in [(b[2] + 0.25) / (b[3] + 0.5)] * 2])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return 1 / (1 + np.exp(-x))
        # inside the steps a trace of the raw score keeps the order
        return np.clip(0.999 * np.interp(x, self.x, self.y) + 0.001 / (1 + np.exp(-x)), 0, 1)


class Model:
    def __init__(self, lexicon: frozenset[str], trees: Trees | None, calibrate: Isotonic | None):
        self.lexicon, self.trees, self.calibrate = lexicon, trees, calibrate

    def score(self, texts: list[str], marks: Marks) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        return self.calibrate(self.trees.raw(np.array([features(t, marks) for t in texts])))


# ---------------------------------------------------------------- fitting and scoring


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def out() -> pa.RecordBatch:
        every = list({**toxic, **clean})
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[t] for t in every], pa.int64()), pa.array([clean[t] for t in every], pa.int64())], ["term", "toxic", "clean"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_LETTERS.findall(text.lower()))
            (toxic if label else clean).update({"", *(t for w in words for t in terms(w))})  # "" counts documents
            if len(toxic) + len(clean) > 400_000:
                yield out()
                toxic.clear()
                clean.clear()
    yield out()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` distinct pairs of id and text with a label, drawn by hashes.

    Labels other than 0 and 1 don't count, nor do those of ids that no document has; several labels of one id
    count as their largest. Ids are drawn first, then, if many rows share them, rows; equal rows count once, so neither an id with a third of all
    rows nor copies exceed the bound. Term counts are summed on the cluster; the driver gets the lexicon and
    one short feature row per sampled document. One id in ``CALIBRATE`` is kept from lexicon and trees and
    fits the isotonic step.
    """
    y = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    y = saved(y.join(docs.select("doc_id"), "doc_id", "left_semi"), "tox-labels")
    n = y.count()
    if not n:
        return Model(frozenset(), None, None)
    y = y.where(uniform(F.col("doc_id")) < sample / n)
    # bounded by the sample
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(y), "doc_id")
    many = rows.count()
    if not many:
        return Model(frozenset(), None, None)
    h = F.xxhash64("doc_id", "text", F.lit(17))
    rows = rows.where(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < sample / many)
    rows = rows.select("label", "text", h.alias("h"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATE)) == 0).alias("held"))
    counts = rows.where(~F.col("held")).select("label", "text").mapInArrow(_term_counts, "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = saved(counts.where((F.col("toxic") >= SUPPORT) | (F.col("term") == "")), "tox-terms")
    every = counts.where("term = ''").first()
    if every is None or not every["toxic"] or not every["clean"]:
        return Model(frozenset(), None, None)
    bad, good = every["toxic"], every["clean"]
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    least = max(SUPPORT, SUPPORT_SHARE * bad)
    mean = (F.col("toxic") + F.col("clean")) / (bad + good)
    errors = (F.col("toxic") / bad - F.col("clean") / good) / F.sqrt(mean * (1 - mean) * (1 / bad + 1 / good))
    found = counts.where((F.col("toxic") >= least) & (F.col("term") != "")).withColumn("odds", odds).where((F.col("odds") >= LOG_ODDS) & (errors >= ERRORS))
    lexicon = frozenset(r["term"] for r in found.orderBy(F.desc("odds"), "term").limit(LEXICON).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = Marks(lexicon), set()
        for batch in batches:
            new = []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if v not in seen:
                    seen.add(v)
                    new.append(i)
            part = batch.take(pa.array(new, pa.int64()))
            x = [features(t, marks) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(x, pa.list_(pa.float64()))], ["label", "h", "held", "x"])

    got = rows.mapInArrow(run, "label int, h long, held boolean, x array<double>")
    got = got.groupBy("h").agg(F.first(F.struct("label", "held", "x")).alias("r")).orderBy("h").limit(sample).select("h", "r.*").toPandas().sort_values("h")
    x, y, part = np.array(got["x"].tolist()), got["label"].to_numpy().astype(float), got["held"].to_numpy().astype(bool)
    if len(y) < 100 or not 0 < y[part].sum() < part.sum() or not 0 < y[~part].sum() < (~part).sum():
        part = np.zeros(len(y), bool)
    trees = Trees().fit(x[~part], y[~part])
    held = x[part] if part.any() else x
    calibrate = Isotonic(trees.raw(held), y[part] if part.any() else y)
    return Model(lexicon, trees, calibrate)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every whole text; null counts as empty."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # a bounded lexicon and a fixed number of trees
    rest = [k for k in keep if k != "text"]
    x = docs.select("text", *rest)
    fields = "".join(f"`{k}` {x.schema[k].dataType.simpleString()}, " for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(model.value.lexicon)
        for batch in batches:
            score = model.value.score([t or "" for t in batch.column(0).to_pylist()], marks)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return x.mapInArrow(run, fields + "score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learned from labels whose crc32 of the id isn't 0 by 5.

    Labels, language, source and id of a document are no input to its score; equal texts get equal scores,
    null and empty texts the score of features that are all 0. Repeated rows and ids are rows of their own, a
    null id is never learned from. Without labels of both kinds all scores are 0. Other columns are ignored.
    Empty tables give empty results.
    """
    learned = labels.where(~held_out(5, 0))
    model = train(docs, learned)
    return predict(docs.select("doc_id", "text").withColumn("held_out", held_out(5, 0)), model, ("doc_id", "held_out"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
