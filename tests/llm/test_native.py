"""Mixing, licenses and WARC against their SQL on small awkward tables, and SimHash against brute force."""

import gzip
import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import rows_of  # noqa: E402
from perigee.llm import licenses, mixing, simhash, warc  # noqa: E402
from perigee.llm.common import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NOTICE = "Released under the MIT License."


def documents(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))]
        text = rng.choice([" ", "\n", "  "]).join(words)
        if i % 9 == 0:
            text += "\n" + rng.choice([NOTICE, "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0."])
        rows.append((i, None if i % 31 == 5 else text, rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", None]), len(text)))
    return rows


def against(spark, fn, sql, kind, rows, name):
    """Spark's rows and DuckDB's, as comparable lists; the table gets a column with a clashing name."""
    got = fn(spark.createDataFrame(rows, kind).withColumn("size", F.lit("x")).withColumn("path", F.lit("y"))).toPandas()
    c = duckdb.connect()
    columns = [x.split()[0] for x in kind.split(", ")]
    types = {"long": "BIGINT", "string": "VARCHAR"}
    c.sql(f"CREATE TABLE {name} ({', '.join(f'{x.split()[0]} {types[x.split()[1]]}' for x in kind.split(', '))})")
    if rows:
        c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
    want = c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return got


@pytest.mark.parametrize("rows", [documents(), documents(7), [], [(1, None, None, None, 0)], [(1, "a", "en", "s", 1), (2, "", "en", "s", 0)]])
def test_mixing_agrees_with_sql(spark, rows):
    got = against(spark, mixing.mix, mixing.OP6_SQL, DOCS, rows, "documents")
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() <= got["size"].sum()
    if len(rows) > 50:
        both = got.groupby("source_size").agg({"taken": "sum", "target": "first", "size": "max"})
        assert ((both["taken"] - both["target"]).abs() <= both["size"] + 1).all()
        again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).toPandas()
        assert rows_of(again) == rows_of(got)


def test_mixing_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), " ".join(["w%d" % rng.randrange(50)] * rng.randint(0, 30)), "en", rng.choice("aab"), 0) for i in range(150)] + [(4, "x y z", "en", "b", 0)] * 40 + [(None, "v " * 20_000, "en", "c", 0)]
    got = against(spark, mixing.mix, mixing.OP6_SQL, DOCS, rows, "documents")
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()


def test_targets_stop_at_three_times_the_source(spark):
    rows = [("a", 10), ("b", 1000), ("c", 5)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == {"a": 30.0, "b": 970.0, "c": 15.0}


def test_repeated_ids_keep_their_rows(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(2, "c", "en", "t", 1)]
    assert mixing.mix(spark.createDataFrame(rows, DOCS)).count() == 4


@pytest.mark.parametrize("rows", [documents(), [], [(1, None, None, None, 0)], [(500, NOTICE, None, "s", 1), (3, "plain", None, "s", 1), (None, "x " + NOTICE, "en", "s", 1)]])
def test_licenses_agree_with_sql(spark, rows):
    got = against(spark, lambda d: licenses.scan(licenses.as_files(d)), licenses.OP2_SQL, DOCS, rows, "documents")
    if len(rows) > 50:
        assert set(got["origin"]) == {"own", "inherited", "none"} or set(got["origin"]) == {"own", "inherited"}


def scanned(spark, rows):
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash")).withColumn("dir", F.lit("x")), keep=())
    return sorted((tuple(r)[:2] + (r["origin"], r["from_dir"]) for r in got.collect()), key=str)


def test_nearest_license_file_wins(spark):
    rows = [("a/LICENSE", NOTICE), ("a/b/LICENSE", "Licensed under CC BY 4.0."), ("a/b/c/x", "code"), ("a/y", "code"), ("z/q", "code"), ("a/b/own", "w " * 99 + "\n" + NOTICE), ("a/b/own2", NOTICE), ("q/license.txt", "all rights are kept"), ("q/x", "code")]
    got = {p: r for p, *r in scanned(spark, rows)}
    assert got["a/b/c/x"] == ["CC-BY-4.0", "inherited", "a/b"] and got["a/y"] == ["MIT", "inherited", "a"]
    assert got["z/q"] == got["q/x"] == [None, "none", None] and got["a/b/own"] == ["MIT", "own", None]


def filled(name):
    whole = next(t for k, t, w in licenses.TEMPLATES if w and k == name)
    body = whole.replace(". ", ".\n\n", 1) if name in ("MIT", "ISC") else whole
    lines, line = [], ""
    for word in body.replace("\n\n", " \n\n ").split(" "):
        if word == "\n\n":
            lines += [line, "Copyright (c) 2021 Some Body <some@body.example>", ""]
            line = ""
        elif len(line) + len(word) > 70:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


HEADER = """%(c)s This file is part of Frob.
%(c)s
%(c)s This program is free software; you can redistribute it and/or modify
%(c)s it under the terms of the GNU General Public License as published by
%(c)s the Free Software Foundation; either version %(v)s of the License, or
%(c)s (at your option) any later version.

int main() { return 0; }
"""


def test_whole_license_texts_and_wrapped_headers(spark):
    rows = [(f"p/{k.lower()}/{n}", filled(k)) for k, n in (("MIT", "LICENSE"), ("BSD-2-Clause", "LICENSE.txt"), ("BSD-3-Clause", "COPYING"), ("ISC", "license.md"), ("Unlicense", "UNLICENSE"))]
    rows += [(f"p/{k}/src/code.c", "int x;") for k in ("mit", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense")]
    rows += [(f"g/{v}{i}.c", HEADER % {"c": c, "v": v}) for v in (2, 3) for i, c in enumerate(["#", "//", " *", ";;", "--"])]
    rows += [("m/about", filled("MIT")), ("m/x", "code"), ("n/about", filled("MIT") + "\n\n" + "prose about other things " * 300), ("n/x", "code")]
    got = {p: r for p, *r in scanned(spark, rows)}
    for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"):
        own = next(r for p, r in got.items() if p.startswith(f"p/{k.lower()}/") and "src" not in p)
        assert own == [k, "own", None] and got[f"p/{k.lower()}/src/code.c"] == [k, "inherited", f"p/{k.lower()}"]
    assert all(got[f"g/{v}{i}.c"] == [f"GPL-{v}.0", "own", None] for v in (2, 3) for i in range(5))
    assert got["m/about"][0] == got["n/about"][0] == "MIT" and got["n/x"] == [None, "none", None]


def test_licenses_of_null_and_shared_paths(spark):
    rows = [(None, NOTICE), (None, "text"), (None, None), ("a/x", NOTICE), ("a/x", "Licensed under CC BY 4.0."), ("a/x", "plain"), ("a/x", "plain"), ("top", "plain"), ("", "plain"), ("LICENSE", NOTICE)]
    got = scanned(spark, rows)
    assert [r for r in got if r[0] is None] == [(None, "MIT", "own", None), (None, None, "none", None), (None, None, "none", None)]
    assert [r[1:3] for r in got if r[0] == "a/x"].count(("CC-BY-4.0", "own")) == 1 and [r[1:3] for r in got if r[0] == "a/x"].count(("MIT", "own")) == 1
    assert [r for r in got if r[0] == "top"] == [("top", "MIT", "inherited", "")] and len(got) == len(rows)


def test_licenses_of_equal_scores_go_by_name(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATES", (("Z-1", "Covered by the frob terms of use", False), ("A-1", "Covered by the frob terms of use", False)))
    assert scanned(spark, [("a", "Covered by the frob terms of use.")]) == [("a", "A-1", "own", None)]


def test_licenses_lose_no_match(spark):
    """Made headers of every nearness to the notices against SQL that compares all sentences with all of them."""
    rng = random.Random(12)
    notices = [t.split() for _, t, whole in licenses.TEMPLATES if not whole]
    common = "the of and mit und by work use under file for public version".split()
    rows = [(1, "the MIT", "en", "s", 0), (2, "MIT", "en", "s", 0), (3, "under MIT", "de", "s", 0)]
    for i in range(4, 1500):
        words = [w for w in rng.choice(notices) if rng.random() < rng.choice([0.2, 0.5, 0.9, 1.0])] + rng.choices(common, k=rng.randint(0, 6)) + [f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 0, 1, 4]))]
        rng.shuffle(words)
        rows.append((i, " ".join(words[:40]) + rng.choice([".", "\n", " prose follows. And more of it."]), rng.choice(["en", "de"]), "s", 0))
    got = against(spark, lambda d: licenses.scan(licenses.as_files(d)), licenses.OP2_SQL, DOCS, rows, "documents")
    near = got["score"].dropna()
    assert 100 < len(near) and ((near > 0.6) & (near < 0.65)).sum() > 10 and got["score"].isna().sum() > 100


def test_needed_terms_are_in_every_match():
    df = {w: 1 + 7 * i % 50 for i, w in enumerate(sorted({w for _, t, _ in licenses.TEMPLATES for w in licenses.terms_of(t)}))}
    need = licenses.needed(df, 60)
    for (_, _, whole), v in zip(licenses.TEMPLATES, licenses._weights(df, 60)):
        rest = sum(w * w for t, w in v.items() if t not in need)
        assert whole or rest < licenses.LEAST_COSINE**2 * sum(w * w for w in v.values())
    assert need and need < set(df)


def test_license_identifiers(spark):
    said = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "BSD-3-Clause": "BSD-3-Clause", "WTFPL": None}
    rows = [(f"s{i}/x.c", f"{c} SPDX-License-Identifier: {k}\n\nint main();\n") for i, (k, c) in enumerate(zip(said, ["//", "#", " *", "--", "/*", ";;"]))]
    rows += [("t/a", "This is under the GPLv3"), ("u/b", "The Unlicense.\n\nprose that says other things about it"), ("v/c", "plain words of no licence")]
    got = {p: r[0] for p, *r in scanned(spark, rows)}
    assert [got[f"s{i}/x.c"] for i in range(len(said))] == list(said.values())
    assert got["t/a"] == "GPL-3.0" and got["u/b"] == "Unlicense" and got["v/c"] is None


def test_licenses_with_hot_groups_and_long_lines(spark, monkeypatch):
    from perigee.llm import common

    monkeypatch.setattr(common, "HEAVY", 4)
    rows = [(f"d/e{i % 3}/f{i}", "same text " + NOTICE if i % 2 else f"text {i}") for i in range(90)] + [(f"d/g/{i}", None) for i in range(30)]
    rows += [("d/LICENSE", "Licensed under CC BY 4.0."), ("l/1", "license-" * 20_000 + "x\n" + "\n" * 20_000 + NOTICE), ("l/LICENSE", "a-" * 30_000 + "mit license " * 10_000)]
    got = {p: r for p, *r in scanned(spark, rows)}
    assert len(got) == len(rows) and sum(r[1] == "inherited" for r in got.values()) == 75 and got["d/g/3"] == ["CC-BY-4.0", "inherited", "d"]
    assert got["l/1"] == ["MIT", "own", None]


PAGES = "page_id long, url string, html string"
LONG = "<p>" + "é" * 60


@pytest.mark.parametrize("rows", [[], [(3, "http://a/ü\r\n", LONG), (1, None, LONG), (2, "u", LONG), (9, "u", None), (8, "u", ""), (7, "u", "x"), (6, "u", "x"), (5, "u", "y" * 99), (4, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100)]])
def test_warc_agrees_with_sql(spark, rows):
    got = against(spark, warc.archived, warc.OP7_SQL, PAGES, rows, "pages")
    if rows:
        assert dict(zip(got["page_id"], got["record_type"]))[1] == "response" and (got["record_type"] == "revisit").sum() == 3


def test_warc_of_null_and_repeated_ids(spark):
    rows = [(5, "a", LONG), (5, "b", LONG), (None, "c", LONG), (None, None, LONG), (7, "d", LONG), (None, "e", "z" * 300), (None, "f", "z" * 300), (None, "g", "short"), (None, None, None), (9, "h", "y" * 40_000_00), (3, "i", "y" * 40_000_00)]
    got = against(spark, warc.archived, warc.OP7_SQL, PAGES, rows, "pages")
    by = sorted((r["record_type"], r["refers_to"]) for r in got.fillna(-1).to_dict("records") if r["page_id"] == -1)
    assert by == [("response", -1)] * 4 + [("revisit", 5)] * 2


def test_revisits_need_their_response(spark):
    import hashlib

    payload = b"p" * 200
    digest = hashlib.sha256(payload).hexdigest()
    data, index = warc.normalise(warc.record(1, None, payload, digest, None) + warc.record(2, None, payload, digest, 9))
    archives = spark.createDataFrame([("x", bytearray(data), index)], "path string, content binary, index array<struct<offset: long, length: long>>")
    with pytest.raises(Exception, match="refers to no payload"):
        warc.read_archives(archives, warc.sidecar(archives)).collect()
    assert warc.read_archives(archives, warc.sidecar(archives).where("offset = 0")).count() == 1


def test_warc_members_and_offsets(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "body %d " % i * 50) for i in range(20)], PAGES)
    whole = warc.write_archives(pages.coalesce(1)).collect()
    assert len(whole) == 1
    plain = gzip.decompress(whole[0]["content"])
    data, index = warc.normalise(whole[0]["content"])
    assert gzip.decompress(data) == plain and len(index) == 20
    a, n = index[7]
    head, block = warc.split_record(gzip.decompress(data[a: a + n]))
    assert block.endswith(b"body 7 ") or b"body" in block
    assert warc.normalise(data)[0] == data and warc.normalise(plain)[0] == data  # any form comes out the same
    assert warc.sidecar(spark.createDataFrame([("p", index)], "path string, index array<struct<offset: long, length: long>>")).count() == 20
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(plain[:-100]))
    old, warc._PIECE = warc._PIECE, 7
    try:
        assert warc.normalise(data)[0] == data
    finally:
        warc._PIECE = old


def brute_fingerprint(text):
    import re

    import xxhash

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i: i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def parts(values, near):
    low = {v: v for v in values}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    values = sorted(values)
    for i, x in enumerate(values):
        for y in values[:i]:
            if near(x, y):
                a, b = sorted((find(x), find(y)))
                low[b] = a
    return {v: find(v) for v in values}


def test_masks_cover_every_pair_of_bits():
    ms = simhash.masks()
    assert len(ms) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in ms) for i in range(64) for j in range(64))


def test_simhash_documents(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "A b C", "a  b\tc", "a b c d", "x", "x", "É y z", "\x1c k", *[r[1] for r in documents(60)]])]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert all(got[i]["fingerprint"] == f"{p:016x}" for i, p in prints.items())
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    part = parts(set(prints.values()), lambda x, y: (x ^ y).bit_count() <= 2)
    low = {}
    for i, p in prints.items():
        low[part[p]] = min(low.get(part[p], i), i)
    assert all(got[i]["component_id"] == low[part[p]] for i, p in prints.items())
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("pairwise", [0, 3, 48])
def test_simhash_links_on_crowded_fingerprints(spark, pairwise):
    rng = random.Random(2)
    values = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(25):
            v = center
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = {simhash._signed(v): v for v in values}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), pairwise)
    assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= 2 for r in edges.collect())
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = parts(set(signed), lambda x, y: (signed[x] ^ signed[y]).bit_count() <= 2)
    sizes = {}
    for v in want.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert got == {s: r for s, r in want.items() if sizes[r] > 1}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 80)] + [(7, 7), (1, 0), (500, 499)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(80)) and got[500] == 499
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_numbers_equal_rows_in_parts(spark, monkeypatch):
    rows = [(None, "boiler plate text of it", "a")] * 700 + [(i % 50, "w " * (i % 7), "ab"[i % 2]) for i in range(400)] + [(None, "boiler plate text of it", None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "EQUAL", 10**9)
    assert parts == sorted(map(str, mixing.mix(docs).collect())) and len(parts) == len(rows)
