"""License scans by TF-IDF cosine to templates, inherited along directories (DataFrame operations only).

Sentences of every file, as they stand on a line and with wrapped lines joined, are compared with short
notices and identifiers, and files that are named like licence files also as a whole with whole licence texts, all as sparse
TF-IDF vectors. A file with a match has that licence. One that is named like a licence file, or of which
notices are at least half, covers its directory and all below it. Other files inherit from the nearest ancestor
directory that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import WORD, join_spread, saved, table, text_of

#: Notices and headers as they are commonly written, by SPDX identifier. Fixed values.
NOTICES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License), you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software, you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software, you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software, you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software, you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("GPL-3.0", "Licensed under GPLv3"),
    ("GPL-2.0", "Licensed under GPLv2"),
    ("LGPL-3.0", "Licensed under LGPLv3"),
    ("LGPL-2.1", "Licensed under LGPLv2.1"),
    ("AGPL-3.0", "Licensed under AGPLv3"),
    ("Unlicense", "The Unlicense"),
)
#: The tag that names a licence by its identifier, what may stand between the two, and the ends of identifiers that have several.
TAG, BETWEEN, LATER = "spdx-license-identifier", r"[: \t(\"']*", ("", "-only", "-or-later", "+")
_IDENTIFIED = tuple((k, f"{TAG}: {k}{end}") for k in dict.fromkeys(k for k, _ in NOTICES) for end in (LATER if "GPL" in k else ("",)))
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole licence texts, without their copyright line. Fixed values; texts of many pages are known by their title and header.
WHOLE = (
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
)
TEMPLATES = (*((k, t, False) for k, t in NOTICES + _IDENTIFIED), *((k, t, True) for k, t in WHOLE))
#: Names of licence files, in lower case.
NAMED = r"^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
#: Ends of sentences, on a line and in a paragraph whose lines were joined; the patterns are the same in Java and RE2.
SENTENCE, JOINED = r"\n|[.!?][ \t\r\n]+", r"\x01|[.!?][ \t\r]+"
#: Paragraph ends and line ends, with the signs that comments begin lines with.
PARAGRAPH, WRAP = r"\n[ \t\r#*/;%-]*\n[ \t\r\n#*/;%-]*", r"[ \t\r]*\n[ \t]*[#*/;%-]*[ \t]*"
#: Terms, of which dots and hyphens at the end are cut. No group repeats in any pattern, so lines of any length are safe.
TERM, ENDS = r"[0-9a-z][0-9a-z.-]*", ".-"
#: A match, and the share of a file's words that notices hold in a licence file of another name.
LEAST_COSINE, FILE_SHARE = 0.6, 0.5


def _any_of(words: set[str]) -> str:
    """A pattern for any of the words, branching by first letter; it reads lower case."""
    heads = "|".join(h + "(?:" + "|".join(sorted(re.escape(w[1:]) for w in words if w[0] == h)) + ")" for h in sorted({w[0] for w in words}))
    return "(?<![0-9a-z])(?:" + heads + ")(?![0-9a-z])"


def terms_of(text: str) -> list[str]:
    """The terms of a template, as ``_listed`` gives them."""
    return [w.rstrip(ENDS) for w in re.findall(TERM, re.sub(TAG + BETWEEN, TAG + ".", text.lower()))]


def weigh(tf: int, df: int, n: int) -> float:
    return (1 + math.log(tf)) * (math.log((n + 1) / (df + 1)) + 1)


def _weights(df: dict[str, int], n: int) -> list[dict[str, float]]:
    """The vector of every template, given in how many of ``n`` texts its terms are."""
    return [{w: weigh(tf, df[w], n) for w, tf in Counter(terms_of(t)).items()} for _, t, _ in TEMPLATES]


def needed(df: dict[str, int], n: int) -> set[str]:
    """Terms of notices of which every match holds at least one.

    The most frequent terms are left out as long as they hold, in each notice, less of its squared length than a
    match needs: by Cauchy and Schwarz, what has no other term of a notice stays below ``LEAST_COSINE`` with it.
    """
    held = [v for v, (_, _, whole) in zip(_weights(df, n), TEMPLATES) if not whole]
    room = [(LEAST_COSINE - 1e-6) ** 2 * sum(w * w for w in v.values()) for v in held]
    left = [0.0] * len(held)
    out = set()
    for term in sorted({w for v in held for w in v}, key=lambda w: (-df[w], w)):
        at = [i for i, v in enumerate(held) if term in v]
        if all(left[i] + held[i][term] ** 2 < room[i] for i in at):
            for i in at:
                left[i] += held[i][term] ** 2
        else:
            out.add(term)
    return out


def _hint(words: set[str]) -> str:
    """A pattern that every text with one of the terms has; an identifier's term is its tag in the text."""
    return _any_of({TAG if w.startswith(TAG + ".") else w for w in words})


def _listed(text) -> Column:
    """The terms of a text, repeats included; a tag and its identifier are one."""
    low = F.lower(text)
    low = F.when(F.contains(low, F.lit(TAG)), F.regexp_replace(low, TAG + BETWEEN, TAG + ".")).otherwise(low)
    return F.transform(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)), lambda x: F.rtrim(x, F.lit(ENDS)))


def _parts(hint: str) -> Column:
    """What of a text can match, as (kind, part): sentences by line (l) and joined (j) with a needed term; whole licence files (w)."""
    text = F.col("text")
    joined = F.regexp_replace(F.regexp_replace(text, PARAGRAPH, "\x01"), WRAP, " ")

    def sentences(x, ends, kind):
        return F.transform(F.filter(F.array_distinct(F.split(x, ends)), lambda p: F.lower(p).rlike(hint)), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("part")))

    none = F.array().cast("array<struct<kind:string,part:string>>")
    notices = F.concat(sentences(text, SENTENCE, "l"), sentences(joined, JOINED, "j"))
    return F.concat(F.when(F.lower(text).rlike(hint), notices).otherwise(none), F.when(F.col("named"), F.array(F.struct(F.lit("w").alias("kind"), text.alias("part")))).otherwise(none))


def _terms(parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return parts.select(*keys, F.explode(_listed(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def scan(files: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``path, license, score, origin, from_dir`` per row of ``path, text`` and the kept columns.

    ``origin`` is ``own``, ``inherited`` or ``none``; ``from_dir`` is the directory whose licence file is
    inherited. ``score`` is the cosine of the best part to 6 places, null without a licence of its own; of
    equal scores the first identifier counts. A sentence matches a notice at a cosine of ``LEAST_COSINE``. Weights
    count in how many rows' texts and templates a term is, every term of every whole text; only then are
    sentences passed over, those without any of the ``needed`` terms, which can't reach the cosine. Equal parts are
    scored once, so a notice that stands in a third of the files costs a partial count a task. Of several licence files in a
    directory the best match counts, then the first name, then the first identifier. A null path is its own
    place: it keeps its own licence and inherits nothing; rows that share a path keep their own licences each.
    Null texts have no licence. Other columns are ignored. Empty tables give empty results.
    """
    spark = files.sparkSession
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    rows = files.select(*keep, "path", text_of().alias("text"), F.coalesce(name.rlike(NAMED), F.lit(False)).alias("named"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    notices = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "t int, license string, notice string, whole boolean")
    of_notice = _terms(notices, ["t", "whole"], "notice")

    # one count a text; partial counts are of a task's terms, however often they stand there
    df = rows.select(F.explode(F.array_distinct(_listed(F.col("text")))).alias("term")).unionByName(of_notice.select("term"))
    df = saved(df.groupBy("term").agg(F.count("*").alias("df")), "license-df")
    texts = rows.count() + len(TEMPLATES)
    vocabulary = {w for _, t, _ in TEMPLATES for w in terms_of(t)}
    known = {r["term"]: r["df"] for r in df.where(F.col("term").isin(sorted(vocabulary))).collect()}
    hint = _hint(needed(known, texts))

    lean = rows.select(*keep, "path", "named", "k1", "k2", _parts(hint).alias("parts"), F.when(F.size("parts") > 0, F.regexp_count("text", F.lit(WORD))).alias("words"))
    lean = saved(lean.withColumn("held", F.size("parts") > 0), "license-rows")
    part = lean.where("held").select("named", "k1", "k2", "words", F.explode("parts").alias("p")).select("named", "k1", "k2", "words", "p.*", (F.col("p.kind") == "w").alias("whole"))
    part = part.withColumn("s", F.md5(F.concat(F.col("whole").cast("string"), "part").cast("binary")))
    # equal texts are one, with the number of their rows
    of_text = saved(part.groupBy("named", "k1", "k2", "kind", "s").agg(F.first("words").alias("words"), F.count("*").alias("copies")), "license-parts")
    every = part.groupBy("s", "whole").agg(F.first("part").alias("part"), F.count("*").alias("n"))
    every = saved(every.withColumn("size", F.regexp_count("part", F.lit(WORD))), "license-sentences")
    of_part = saved(_terms(every, ["s", "whole"], "part"), "license-terms")
    weight = ((1 + F.log(F.col("tf").cast("double"))) * (F.log(F.lit(texts + 1.0) / (F.col("df") + 1)) + 1)).alias("w")
    # the templates are a fixed list, so their terms are bounded
    t = of_notice.join(df.where(F.col("term").isin(sorted(vocabulary))), "term").select("t", "whole", "term", weight)

    used = saved(of_part.groupBy("term").agg(F.count("*").alias("n")).join(df, "term"), "license-used")
    s = join_spread(of_part, used, ["term"], "n", of_part.count()).select("s", "whole", "term", weight)
    s_norm = s.groupBy("s").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s_norm"))
    t_norm = t.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    dot = s.withColumnRenamed("w", "sw").join(F.broadcast(t), ["term", "whole"]).groupBy("s", "whole", "t").agg(F.sum(F.col("sw") * F.col("w")).alias("dot"))
    dot = dot.join(F.broadcast(t_norm), "t").join(F.broadcast(notices.select("t", "license")), "t").join(s_norm, "s")
    dot = dot.withColumn("score", F.round(F.col("dot") / (F.col("s_norm") * F.col("t_norm")), 6)).where(F.col("score") >= LEAST_COSINE)
    first = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("m")
    best = dot.groupBy("s").agg(first).select("s", "m.*").join(every.select("s", "size", "n"), "s")
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = join_spread(of_text, saved(best, "license-matches"), ["s"], "n", total)
    share = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("size"))), F.lit(0))
    own = own.groupBy("named", "k1", "k2").agg(first, F.greatest(share("l"), share("j")).alias("covered"), F.first("words").alias("words"))
    own = own.select("named", "k1", "k2", "m.*", (F.col("named") | (F.col("covered") >= F.col("words") * FILE_SHARE)).alias("covers"))
    # a fact for every text that was compared, so that many rows of one text without a match are found too
    facts = of_text.groupBy("named", "k1", "k2").agg(F.max("copies").alias("copies")).join(own, ["named", "k1", "k2"], "left")
    facts = saved(facts, "license-own")
    total = facts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    names = [*keep, "path", "license", "score", "covers"]
    mine = join_spread(lean.where("held").select(*keep, "path", "named", "k1", "k2"), facts, ["named", "k1", "k2"], "copies", total).select(*names)
    mine = mine.unionByName(lean.where("not held").select(*keep, "path"), allowMissingColumns=True)
    mine = saved(mine.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "license-files")

    covered = mine.where("covers and path is not null").groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("dir_license"))
    covered = saved(covered, "license-dirs")
    dirs = saved(mine.where("path is not null").groupBy("dir").agg(F.count("*").alias("n")), "license-places")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("level"))
    up = up.withColumn("at", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("level")), "/"))
    # a directory with very many below it is one key of this join
    above = up.groupBy("at").agg(F.count("*").alias("n")).join(covered.withColumnRenamed("dir", "at"), "at")
    near = join_spread(up, above, ["at"], "n", up.count()).groupBy("dir").agg(F.max_by(F.struct("dir_license", "at"), "level").alias("near"))
    near = saved(dirs.join(near, "dir", "left").select("dir", "n", "near.dir_license", "near.at"), "license-near")
    total = near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = join_spread(mine.where("path is not null"), near, ["dir"], "n", total).unionByName(mine.where("path is null"), allowMissingColumns=True)
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return placed.select(*keep, "path", F.coalesce("license", "dir_license").alias("license"), "score", origin.alias("origin"), F.when(origin == "inherited", F.col("at")).alias("from_dir"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents laid out as files: source / language / thousand of the id / id.

    Ids divisible by 50 stand one directory higher and those divisible by 500 directly under the source, named
    as licence files, so that directories of every depth hold files and some licence files. A null id is a
    null path.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    name = F.col("doc_id").cast("string")
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    named = F.concat(F.lit("LICENSE-"), name)
    path = F.when(F.col("doc_id") % 500 == 0, F.concat_ws("/", part("source"), named)).when(F.col("doc_id") % 50 == 0, F.concat_ws("/", part("source"), part("lang"), named))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path.otherwise(F.concat_ws("/", part("source"), part("lang"), shelf, name))).alias("path"), "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(table(spark, sf_dir, "documents")))


def _sql() -> str:
    listed = lambda x: f"list_transform(regexp_extract_all(regexp_replace(lower({x}), '{quoted(TAG + BETWEEN)}', '{TAG}.', 'g'), '{TERM}'), lambda x: rtrim(x, '{ENDS}'))"
    quoted = lambda x: x.replace("'", "''")
    notices = ",\n    ".join(f"({i}, '{k}', '{quoted(t)}', {str(w).lower()})" for i, (k, t, w) in enumerate(TEMPLATES))
    weight = "(1 + ln(tf)) * (ln((texts + 1.0) / (df + 1)) + 1)"
    return rf"""
WITH notices(t, license, notice, whole) AS (VALUES
    {notices}),
files AS (
  SELECT *, row_number() OVER () AS r, regexp_matches(lower(coalesce(regexp_extract(path, '[^/]*$'), '')), '{NAMED}') AS named,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         regexp_replace(regexp_replace(text, '{PARAGRAPH}', chr(1), 'g'), '{WRAP}', ' ', 'g') AS joined
  FROM (
    SELECT doc_id, coalesce(text, '') AS text,
           CASE WHEN doc_id IS NULL THEN NULL
                WHEN doc_id % 500 = 0 THEN coalesce(source, '_') || '/LICENSE-' || doc_id
                WHEN doc_id % 50 = 0 THEN coalesce(source, '_') || '/' || coalesce(lang, '_') || '/LICENSE-' || doc_id
                ELSE coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || (doc_id // 1000) || '/' || doc_id END AS path
    FROM documents)),
parts AS (
  SELECT r, 'l' AS kind, false AS whole, unnest(list_distinct(string_split_regex(text, '{SENTENCE}'))) AS s FROM files
  UNION ALL SELECT r, 'j', false, unnest(list_distinct(string_split_regex(joined, '{JOINED}'))) FROM files
  UNION ALL SELECT r, 'w', true, text FROM files WHERE named),
sentences AS (SELECT s, whole, {listed("s")} AS terms, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS size FROM (SELECT DISTINCT s, whole FROM parts)),
st AS (SELECT s, whole, term, count(*) AS tf FROM (SELECT s, whole, unnest(terms) AS term FROM sentences) GROUP BY ALL),
nt AS (SELECT t, whole, term, count(*) AS tf FROM (SELECT t, whole, unnest({listed("notice")}) AS term FROM notices) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({listed("text")})) AS term FROM files UNION ALL SELECT term FROM nt) GROUP BY term),
n AS (SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM notices) AS texts),
sw AS (SELECT s, whole, st.term, {weight} AS w FROM st JOIN df ON st.term = df.term, n),
tw AS (SELECT t, whole, nt.term, {weight} AS w FROM nt JOIN df ON nt.term = df.term, n),
sn AS (SELECT s, whole, sqrt(sum(w * w)) AS norm FROM sw GROUP BY s, whole),
tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tw GROUP BY t),
dots AS (SELECT s, sw.whole, t, sum(sw.w * tw.w) AS dot FROM sw JOIN tw ON sw.term = tw.term AND sw.whole = tw.whole GROUP BY s, sw.whole, t),
scored AS (
  SELECT d.s, d.whole, license, round(dot / (sn.norm * tn.norm), 6) AS score
  FROM dots d JOIN sn ON d.s = sn.s AND d.whole = sn.whole JOIN tn ON d.t = tn.t JOIN notices ON d.t = notices.t),
best AS (SELECT * FROM scored WHERE score >= {LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY s, whole ORDER BY score DESC, license) = 1),
matched AS (
  SELECT r, kind, size, license, score FROM parts p JOIN best b ON p.s = b.s AND p.whole = b.whole JOIN sentences z ON p.s = z.s AND p.whole = z.whole),
own AS (
  SELECT r, arg_min(license, (-score, license)) AS license, max(score) AS score,
         greatest(coalesce(sum(size) FILTER (kind = 'l'), 0), coalesce(sum(size) FILTER (kind = 'j'), 0)) AS covered
  FROM matched GROUP BY r),
covered AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license FROM own JOIN files USING (r) WHERE (named OR covered >= words * {FILE_SHARE}) AND path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path, license) = 1),
near AS (
  SELECT f.r, c.license, c.dir FROM files f JOIN covered c ON starts_with(f.path, c.dir || '/') OR c.dir = ''
  QUALIFY row_number() OVER (PARTITION BY f.r ORDER BY length(c.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.license, near.license) AS license, own.score AS score,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.license IS NULL THEN near.dir END AS from_dir
FROM files f LEFT JOIN own ON f.r = own.r LEFT JOIN near ON f.r = near.r
"""


OP2_SQL = _sql()
