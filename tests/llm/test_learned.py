"""Language ID, toxicity and vectors: held-out accuracy and brute force; the pipeline by its stages' rules."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import DATA  # noqa: E402
from perigee.llm import langid, neardup_vectors, toxicity  # noqa: E402

SYLLABLES = {"en": "the ing th er and tion of to".split(), "de": "der sch ung ich ein keit und ß".split(), "fr": "le la eau des que ç é ment".split()}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([4, 30, 200]))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return rows


def test_language_is_learned_and_edges_hold(spark):
    rows = corpus() + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "123 !? \n", "de", "s", 0), (1003, "der " * 70_000, None, "s", 0), (None, "the and of", None, None, 0)]
    x = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = langid.identify(x).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240))
    held = [r for r in rows[:240] if by[r[0]]["held_out"]]
    assert sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "de" and by[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(x.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(x.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_collapsed_weights_equal_the_kernel():
    rng = np.random.default_rng(1)
    held = [langid.grams(t) for _, t, *_ in corpus(40)]
    samples = [(lang, g) for g, (_, _, lang, *_) in zip(held, corpus(40))]
    model = langid.fit_kernel(samples, 5)
    query = [t for _, t, *_ in corpus(10, 7)]
    names, _ = model.predict(query)
    n, marks = dict.fromkeys(model.langs, 0), []
    for lang, g in samples:
        if n[lang] < 5:
            n[lang] += 1
            marks.append(set(g.tolist()))
    k = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    kmm = np.array([[k(a, b) for b in marks] for a in marks])
    w, v = np.linalg.eigh(kmm)
    nys = v[:, w > 1e-8 * w.max()] / np.sqrt(w[w > 1e-8 * w.max()])
    x = np.c_[np.array([[k(set(g.tolist()), m) for m in marks] for _, g in samples]) @ nys, np.ones(len(samples))]
    y = np.array([[float(lang == c) for c in model.langs] for lang, _ in samples])
    s = 1 / np.sqrt(y.sum(0))[y.argmax(1), None]
    coef = np.linalg.solve((x * s).T @ (x * s) + langid.RIDGE * np.eye(x.shape[1]), (x * s).T @ (y * s))
    q = np.c_[np.array([[k(set(langid.grams(t).tolist()), m) for m in marks] for t in query]) @ nys, np.ones(len(query))]
    assert [model.langs[i] for i in (q @ coef).argmax(1)] == names
    assert rng is not None


def test_letters_are_category_l(spark):
    signs = ["²", "½", "Ⅷ", "①", "٣", "\u0301", "_", "😀", "́1"]
    rows = corpus(60) + [(2000 + i, x, "en", "s", 0) for i, x in enumerate(signs)] + [(3000, "ª", "en", "s", 0), (3001, "½ the and", "en", "s", 0)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[2000 + i]["lang_pred"] for i in range(len(signs))} == {"und"}
    assert got[3000]["lang_pred"] != "und" and got[3001]["lang_pred"] == "en"


def plain_grams(text):
    import unicodedata

    signs = ["\x01", *[c if unicodedata.category(c)[0] in "LM" else "\x01" for c in text.lower()], "\x01"]
    c = [x for i, x in enumerate(signs) if not (i and x == "\x01" == signs[i - 1])]
    return sorted({sum(ord(x) << 21 * (n - 1 - j) for j, x in enumerate(c[i: i + n])) for n in (1, 2, 3) for i in range(len(c) - n + 1)})


def test_grams_equal_plain_loops():
    rng = random.Random(5)
    for k in (3, 30, 400):
        alphabet = [chr(0x41 + i) for i in range(k)] + list(" 1é!\u0301日")
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) + "a"
            assert langid.grams(text).tolist() == plain_grams(text)
    assert langid.grams("") is None and langid.grams("½ 12") is None


def test_language_of_few_texts_many_times_is_learned(spark):
    german = ["der schnelle braune fuchs springt über den faulen hund", "ein haus steht am see und niemand wohnt darin", "die katze schläft heute auf dem alten sofa"]
    english = spark.range(1000).select("id", F.concat_ws(" ", F.lit("the quick brown fox"), "id", F.lit("jumps over the lazy dog and"), F.col("id") * 7, F.lit("words of the house")).alias("text"), F.lit("en").alias("lang"))
    many = spark.range(20_000).select((F.col("id") + 10_000).alias("id"), F.element_at(F.array(*map(F.lit, german)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("de").alias("lang"))
    got = langid.identify(english.unionByName(many).withColumnRenamed("id", "doc_id")).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"en": 1000, "de": 20_000}


def test_every_one_of_many_languages_is_learned(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for lang in range(150):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))) for _ in range(30)]
        rows += [(lang * 100 + j, " ".join(rng.choice(words) for _ in range(20)), f"l{lang:03d}") for j in range(12)]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TEXTS", 900)
    monkeypatch.setattr(langid, "MARKS", 300)
    whole = {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in langid.identify(x).collect()}
    assert sum(whole[i][0] == lang for i, _, lang in rows) > 0.97 * len(rows) and len({lang for lang, _ in whole.values()}) == 150
    monkeypatch.setattr(langid, "DENSE", 0)  # by landmarks instead of weights of n-grams
    split = {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in langid.identify(x).collect()}
    assert all(whole[i][0] == split[i][0] and abs(whole[i][1] - split[i][1]) < 1e-3 for i in whole)


def test_labels_without_documents_do_not_starve_the_sample(spark):
    text = F.when(F.col("id") % 4 == 0, "you are a stupid idiot moron and i hate you damn fool").otherwise("the committee met on monday to discuss the budget of the town")
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", text, "id").alias("text"))
    labels = spark.range(1_200_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.assess(docs, labels).groupBy((F.col("doc_id") % 4 == 0).alias("toxic"), "predicted").count().collect()
    assert {(r["toxic"], r["predicted"]): r["count"] for r in got} == {(True, 1): 300, (False, 0): 900}


def test_language_sample_is_bounded(spark):
    rows = corpus(200) + [(None, "the same text of many copies " * 3, "en", "s", 0)] * 300 + [(None, t, lang, "s", 0) for _, t, lang, *_ in corpus(200, 9)] + [(7, "sch und " * 3, "de", "s", 0)] * 100
    x = spark.createDataFrame(rows, DOCS).repartition(7)
    seen = []
    old, langid.fit_kernel = langid.fit_kernel, lambda samples, *a: seen.append(samples) or old(samples, *a)
    try:
        model = langid.train(x, 20, 5)
        langid.train(x.repartition(3), 20, 5)
    finally:
        langid.fit_kernel = old
    for lang in SYLLABLES:
        g = [s[1].tobytes() for s in seen[0] if s[0] == lang]
        assert 2 < len(g) <= 20 and len(set(g)) == len(g)
    assert all(np.array_equal(a[1], b[1]) and a[0] == b[0] for a, b in zip(*seen)) and model.langs == sorted(SYLLABLES)


def test_grams_of_long_texts_come_from_pieces():
    text = "".join(random.Random(1).choice("abc é1") for _ in range(5000))
    whole = langid.grams(text)
    old, langid._PIECE = langid._PIECE, 700
    try:
        assert np.array_equal(langid.grams(text), whole)
    finally:
        langid._PIECE = old


def toxic_rows(n=700, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet sed do elit magna erat".split()) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Zlurfy", "vexuling", "vexuloid", "vexulant"]) + rng.choice(["", "!", "."]))
        docs.append((i, " ".join(words), "xx", "s", 0))
        if i % 5:
            labels.append((i, 1, int(bad)))
    return docs, labels, {d[0]: any(w in d[1] for w in ("grobnik", "Zlurfy", "vexul")) for d in docs}


def test_toxicity_is_learned_and_edges_hold(spark):
    docs, labels, truth = toxic_rows()
    docs += [(5000, None, None, None, 0), (5001, "", "x", "s", 0), (5002, "lorem " * 50_000 + "grobnik zlurfy vexuling", "x", "s", 0), (None, "lorem", None, None, 0)]
    labels += [(3, 1, None), (None, 1, 1), (9999, 1, 1), (4, 1, 7)]
    x = spark.createDataFrame(docs, DOCS).withColumn("predicted", F.lit("clash"))
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.assess(x, y).collect()}
    assert len(got) == len(docs)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(bool(got[i]["predicted"]) == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] and not got[5000]["predicted"]
    none = toxicity.assess(x, y.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.assess(x.limit(0), y).count() == 0


def test_obfuscated_words_and_stems_are_marked():
    m = toxicity.Marks(frozenset({"idiot", "vexu*"}))
    assert m["1d1ot!"] & toxicity.VEILED and m["i.d.i.o.t"] & toxicity.VEILED and m["(IDIOT)"] & toxicity.WORD and m["vexuling"] & toxicity.STEM
    assert not m["idiom"] & (toxicity.WORD | toxicity.STEM) and not m["3rd"] & toxicity.VEILED and m["You"] & toxicity.YOU and m["sooo"] & toxicity.LONG
    f = dict(zip(toxicity.FEATURES, toxicity.features("you idiot far a b c d e f g h idiot", m)))
    assert abs(f["near_second"] - 1 / 12) < 1e-9 and abs(f["word_density"] - 2 / 12) < 1e-9


def test_isotonic_rises_and_averages():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float)
    iso = toxicity.Isotonic(x, y)
    z = iso(np.sort(x))
    assert (np.diff(z) >= -1e-12).all() and abs(iso(x).mean() - y.mean()) < 0.03


def plain_isotonic(x, y):
    """The min-max formula on distinct x, and blocks of equal values with the operator's prior."""
    xs = sorted(set(x))
    groups = [[b for a, b in zip(x, y) if a == v] for v in xs]
    mean = lambda i, j: sum(map(sum, groups[i: j + 1])) / sum(map(len, groups[i: j + 1]))
    fit = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    out, i = [], 0
    while i < len(xs):
        j = i
        while j + 1 < len(xs) and abs(fit[j + 1] - fit[i]) < 1e-12:
            j += 1
        got = [v for g in groups[i: j + 1] for v in g]
        out.append((xs[i], xs[j], (sum(got) + 0.25) / (len(got) + 0.5)))
        i = j + 1
    return out


def test_isotonic_equals_the_min_max_formula():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randint(1, 25)
        x = [rng.choice([rng.randint(0, 5), rng.random() * 5]) for _ in range(n)]
        y = [float(rng.random() < 0.4) for _ in range(n)]
        iso = toxicity.Isotonic(np.array(x, float), np.array(y))
        got = list(zip(iso.x[::2], iso.x[1::2], iso.y[::2]))
        want = plain_isotonic(x, y)
        assert len(got) == len(want) and np.allclose(got, want)


def plain_boost(x, y, edges, trees, depth):
    """Boosting by loops over every node, feature and edge; the first of the best splits is taken."""
    p = sum(y) / len(y)
    f = [math.log(p / (1 - p))] * len(y)
    for _ in range(trees):
        g = [b - 1 / (1 + math.exp(-a)) for a, b in zip(f, y)]
        h = [(b - c) * (1 - (b - c)) for b, c in zip(y, g)]
        node = [0] * len(y)
        for _ in range(depth):
            split = {}
            for k in set(node):
                rows = [i for i in range(len(y)) if node[i] == k]
                gain = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + 1)  # noqa: B023,E731
                best = 1e-6
                for j in range(len(x[0])):
                    for e in edges[j]:
                        left, right = [i for i in rows if x[i][j] <= e], [i for i in rows if x[i][j] > e]
                        if min(len(left), len(right)) >= toxicity.LEAST_LEAF and gain(left) + gain(right) - gain(rows) > best + 1e-9:
                            best, split[k] = gain(left) + gain(right) - gain(rows), (j, e)
            node = [2 * k + (k in split and x[i][split[k][0]] > split[k][1]) for i, k in enumerate(node)]
        for k in set(node):
            rows = [i for i in range(len(y)) if node[i] == k]
            leaf = toxicity.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
            for i in rows:
                f[i] += leaf
    return f


def test_trees_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    monkeypatch.setattr(toxicity, "DEPTH", 3)
    monkeypatch.setattr(toxicity, "BINS", 6)
    rng = np.random.default_rng(12)
    x = np.round(rng.random((160, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.random(160) > 0.9).astype(float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 7)[1:-1])) for j in range(3)]
    edges = [np.unique(np.concatenate([e, np.quantile(x[x[:, j] > e[-1], j], np.linspace(0, 1, 9)[:-1]) - 1e-12])) for j, e in enumerate(edges)]
    got = toxicity.Trees().fit(x, y).raw(x)
    assert np.allclose(got, plain_boost(x.tolist(), y.tolist(), edges, 4, 3), atol=1e-9)


def plain_features(text, lexicon):
    """All features by plain loops over tokens and characters."""
    import string
    import unicodedata

    tokens, n = text.split(), len(text.split())
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    bits = [toxicity.Marks(lexicon)[t] for t in tokens]
    hit, you = [i for i, b in enumerate(bits) if b & 3], [i for i, b in enumerate(bits) if b & toxicity.YOU]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hit)
    kind = [unicodedata.category(c) for c in text]
    words, stems = sum(b & 1 for b in bits), sum(b >> 1 & 1 for b in bits)
    distinct = len({tokens[i].lower().strip(string.punctuation + "¡¿«»…“”„‘’") for i in hit})
    return [words / n, stems / n, math.log1p(words), math.log1p(stems), math.log1p(distinct), near / n, len(you) / n, sum(k in ("Lu", "Lt") for k in kind) / len(text),
            sum(b >> 4 & 1 for b in bits) / n, sum(k[0] == "P" or c in string.punctuation for k, c in zip(kind, text)) / len(text), sum(c in "!！" for c in text) / len(text),
            sum(b >> 3 & 1 for b in bits) / n, sum(b >> 5 & 1 for b in bits) / n, math.log1p(n)]


def test_features_over_all_of_unicode():
    lexicon = frozenset({"idiot", "дурак", "vexu*"})
    f = dict(zip(toxicity.FEATURES, toxicity.features("Это обычное Предложение, и всё.", toxicity.Marks(lexicon))))
    assert abs(f["punctuation"] - 2 / 31) < 1e-12 and abs(f["capitals"] - 2 / 31) < 1e-12
    assert toxicity.features("ты «Дурак»！ 「日本」", toxicity.Marks(lexicon))[0] == 1 / 3
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choice("aÄbß日!?«»1dЖ.ǅ") for _ in range(rng.randint(1, 6))) if rng.random() < 0.7 else rng.choice(["you", "1d1ot", "IDIOT!", "vexuling", "«дурак»", "dich", "sooo"]) for _ in range(rng.randint(0, 30)))
        assert np.allclose(toxicity.features(text, toxicity.Marks(lexicon)), plain_features(text, lexicon))


def test_query_scores_equal_a_plain_walk(spark):
    docs, labels, _ = toxic_rows(400)
    x, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(x, y.where(~langid.held_out(5, 0)))
    got = {r["doc_id"]: r["score"] for r in toxicity.assess(x, y).collect()}
    for i, text, *_ in docs[:120]:
        v, raw = plain_features(text, model.lexicon), model.trees.base
        for feature, edge, leaf in zip(model.trees.feature.tolist(), model.trees.edge.tolist(), model.trees.leaf.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (v[feature[node]] > edge[node])
            raw += leaf[node - len(feature)]
        xs, ys = model.calibrate.x.tolist(), model.calibrate.y.tolist()
        at = sum(a <= raw for a in xs)
        if at in (0, len(xs)):
            step = ys[0] if at == 0 else ys[-1]
        else:
            step = ys[at - 1] + (ys[at] - ys[at - 1]) * (raw - xs[at - 1]) / (xs[at] - xs[at - 1]) if xs[at] > xs[at - 1] else ys[at]
        assert abs(got[i] - (0.999 * step + 0.001 / (1 + math.exp(-raw)))) < 1e-9


def test_toxicity_sample_is_bounded(spark):
    docs, labels, _ = toxic_rows(300)
    docs += [(11, f"lorem ipsum {i}", "x", "s", 0) for i in range(400)] + [(12, "copies of it", "x", "s", 0)] * 400
    seen = []
    old, toxicity.Trees.fit = toxicity.Trees.fit, lambda self, x, y: seen.append(len(y)) or old(self, x, y)
    try:
        toxicity.train(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 200)
    finally:
        toxicity.Trees.fit = old
    assert len(seen) == 1 and 0 < seen[0] <= 200


def brute_vectors(rows, cosine):
    ok = []
    for i, (vid, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok.append(i)
    n, low = [0] * len(rows), [r[0] for r in rows]
    links = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2]:
                x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    for _ in range(len(rows)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((rows[i][0], n[i], low[i], rows[i][0] == low[i]) for i in range(len(rows)))


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 7)
    monkeypatch.setattr(neardup_vectors, "OCCUPANCY", 8)
    rng = np.random.default_rng(3)
    f = lambda v: [float(np.float32(c)) for c in v]
    rows, centers = [], rng.normal(size=(6, 16))
    for i in range(260):
        v = centers[rng.integers(6)] + 0.09 * rng.normal(size=16) * rng.integers(0, 4) if rng.random() < 0.6 else rng.normal(size=16)
        rows.append((i, f(v), int(rng.integers(0, 2))))
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(9)]  # copies
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] + [1.0] * 15, 1), (403, [float("nan")] + [1.0] * 15, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, rows[5][1], None), (406, [1.0, 2.0], 1), (407, [], 1)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = sorted(map(tuple, neardup_vectors.near_duplicates(x, recall=1.0).select("vec_id", "n_links", "component_id", "kept").collect()))
    want = brute_vectors(rows, 0.93)
    assert got == want
    assert neardup_vectors.near_duplicates(x.limit(0)).count() == 0
    assert neardup_vectors.near_duplicates(x.where("vec_id = 401")).count() == 1


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(6)
    long, short = rng.normal(size=(90, 8)), rng.normal(size=(70, 4))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(long)] + [(200 + i, v.tolist(), 1) for i, v in enumerate(short)] + [(300, short[0].tolist(), 1), (301, (short[1] * 3).tolist(), 1)]
    rows += [(400, [2.0], 1), (401, [5.0], 1), (402, [-1.0], 1), (403, [-7.0], 2), (404, [-3.0], 1), (405, [0.0], 1)]
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.999).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in (200, 300, 201, 301, 400, 401, 402, 403, 404, 405)} == {200: (1, 200), 300: (1, 200), 201: (1, 201), 301: (1, 201), 400: (1, 400), 401: (1, 400), 402: (1, 402), 404: (1, 402), 403: (0, 403), 405: (0, 405)}


def test_vectors_of_extreme_size_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(30, 6))
    rows = [(i, (v * 10.0 ** rng.integers(-300, 300)).tolist(), 1) for i, v in enumerate(a)] + [(100 + i, (v * 1e-305).tolist(), 1) for i, v in enumerate(a)] + [(100, (a[5] * 1e300).tolist(), 1), (None, a[6].tolist(), 1), (None, None, 1), (700, None, 2), (700, None, 2)]
    got = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.99999).collect()
    assert len(got) == len(rows)
    links = {}
    for r in got:
        links.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert links[7] == [(1, 7, True)] and links[107] == [(1, 7, False)]
    assert sorted(links[100]) == [(1, 0, False), (2, 5, False)] and links[6] == [(2, 6, True)]
    assert sorted(links[None], key=str) == [(0, None, True), (2, 6, False)]
    assert links[700] == [(0, 700, True)] * 2


def test_components_with_a_hub(spark, monkeypatch):
    from perigee.llm import common

    monkeypatch.setattr(common, "HEAVY", 3)
    rng = random.Random(3)
    edges = [(5000, i) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7, 7)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(70):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if k != 7 or v != 7}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_multi_sequence_order_is_exact():
    rng = np.random.default_rng(0)
    grid = neardup_vectors.Grid(rng.normal(size=(8, 4)), rng.normal(size=(8, 4)), 20)
    x = rng.normal(size=(30, 8))
    a, b = grid._far(x)
    every = (a[:, :, None] + b[:, None, :]).reshape(30, -1)
    want = np.sort(every, axis=1)[:, :20]
    assert np.allclose(np.take_along_axis(every, grid.nearest(x), axis=1), want)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    names = [n for n, _ in pipe.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "mixing", "pieces"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "123", "en", "src0", 3), (10**6 + 2, "   ", None, "src1", 3)], DOCS)
    docs = docs.unionByName(odd.select(docs.columns)).cache()
    kept = pipe.identify_language(spark, docs, DATA).cache()
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000000").count() == 0 and kept.count() == docs.count() - 3
    clean = pipe.drop_toxic(spark, kept, DATA).cache()
    assert clean.columns == docs.columns and 0 < clean.count() <= kept.count()
    twice = clean.unionByName(clean.limit(5)).cache()
    single = pipe.drop_near_duplicates(spark, twice, DATA).cache()
    ids = [r[0] for r in single.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    from perigee.llm import simhash

    groups = simhash.near_duplicates(clean).toPandas()
    assert sorted(ids) == sorted(groups["component_id"].unique())
    mixed = pipe.mix_sources(spark, single, DATA).cache()
    from perigee.llm import mixing

    taken = mixing.mix(single).where("taken > 0").selectExpr("doc_id", "taken div size as n").toPandas()
    assert mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == dict(zip(taken["doc_id"], taken["n"]))
    out = pipe.encode_pieces(spark, mixed, DATA)
    assert out.count() == mixed.count() and out.where("not round_trip").count() == 0


def test_pipeline_accounts_for_every_row(spark):
    import corpus_pipeline as pipe
    from perigee.llm import mixing, simhash
    from perigee.llm.common import table

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.where("text is not null and n_chars > 200").orderBy("doc_id").limit(6).collect()
    odd = [(None, None, None, None, 0), (None, "", "en", "src0", 0), (10**6, "½ 12", "en", None, 4), (10**6, first[0]["text"], None, None, 9), (None, first[1]["text"], None, None, 9), (None, first[1]["text"], None, None, 9),
           (10**6, "the and of " * 40_000, None, "src1", 0), (None, "x" * 500_000, "en", "src1", 0), (first[2]["doc_id"], first[3]["text"], "en", "src2", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS).select(docs.columns))
    for name in ("row", "score", "fp", "part", "copies", "copy", "size", "taken", "lang_pred", "predicted", "label"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs = docs.cache()
    n = docs.count()

    known = pipe.identify_language(spark, docs, DATA).cache()
    assert known.count() == n - 3 - docs.where("doc_id < 1000000 and (text is null or not text rlike '\\\\p{L}')").count()
    assert known.where("lang is null").count() == 0 and known.columns == list(pipe.COLUMNS)
    model = toxicity.train(known, table(spark, DATA, "labels").where(~langid.held_out(5, 0)))
    bad = toxicity.predict(known, model).where("predicted = 1").count()
    clean = pipe.drop_toxic(spark, known, DATA).cache()
    assert clean.count() == known.count() - bad
    single = pipe.drop_near_duplicates(spark, clean, DATA).cache()
    assert single.count() == simhash.grouped(clean).select("part").distinct().count()
    mixed = pipe.mix_sources(spark, single, DATA).cache()
    taken = mixing.mix(single).agg(F.sum(F.expr("taken div size"))).first()[0]
    assert mixed.count() == taken
    assert pipe.encode_pieces(spark, mixed, DATA).count() == taken
    for name, stage in pipe.STAGES:
        out = stage(spark, docs.limit(0).select(*pipe.COLUMNS), DATA)
        assert out.count() == 0 and (name == "pieces" or out.columns == list(pipe.COLUMNS))


def test_pipeline_keeps_rows_apart(spark):
    import corpus_pipeline as pipe
    from perigee.llm import mixing

    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta omega sigma kappa lamda".split()) + str(rng.randrange(99)) for _ in range(30)) for _ in range(6)]
    make = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS).select(*pipe.COLUMNS)
    x = make([(None, texts[0], "a")] * 3 + [(7, texts[1], "a"), (7, texts[2], "a"), (3, texts[2], "b"), (9, texts[3], "a"), (9, texts[3], "a"), (None, texts[4], "b"), (8, texts[4], "b"), (None, texts[5], "b")])
    got = [(r["doc_id"], texts.index(r["text"])) for r in pipe.drop_near_duplicates(spark, x, "").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(None, 0), (7, 1), (3, 2), (9, 3), (8, 4), (None, 5)]
    y = make([(None, texts[0], "a"), (None, texts[1], "a"), (1, texts[2], "a"), (1, texts[2], "a"), (1, texts[2], "b"), (1, texts[3], "b"), (2, texts[4], "b"), *[(10 + i, texts[i % 6] + f" x{i}", "c") for i in range(40)]])
    mixed = pipe.mix_sources(spark, y, "")
    taken = mixing.mix(y).selectExpr("doc_id", "taken div size as n").groupBy("doc_id").sum("n").where("`sum(n)` > 0").collect()
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == {r[0]: r[1] for r in taken}
    assert mixed.where("doc_id is null").count() > 0 and mixed.where("doc_id = 1").count() <= 12
    assert max(r["count"] for r in mixed.where("doc_id is null").groupBy("text").count().collect()) <= 3


@pytest.mark.parametrize("name", ["op1_webp", "op9_token_counts", "op4_sentencepiece", "op8_language_id", "op3_toxicity", "op5_near_vectors", "op10_simhash"])
def test_registered_queries_run(spark, name):
    import __spark_entry__ as entry

    table = "embeddings" if name.startswith("op5") else "documents"
    assert entry.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op2_licenses", "op6_source_mixing", "op7_warc"])
def test_registered_queries_agree_with_sql(spark, duck, name):
    import __spark_entry__ as entry

    from conftest import rows_of

    assert rows_of(entry.queries()[name](spark, DATA).toPandas()) == rows_of(duck.sql(entry.oracle_sql()[name]).df())
