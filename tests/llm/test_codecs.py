"""WebP, SentencePiece and token counts against round trips and libraries."""

import base64
import hashlib
import json
import random
import sys
import zlib

import numpy as np
import pytest
from perigee.llm import sentencepieces, token_counts, webp
from perigee.llm.bpe import merge
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", "   ", "don't we'll 'tis '' \"'s x'rex 're'v 'r 'l'l 'd's 'S It'S", "ΑΣΣ ΟΔΟΣ İstanbul", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>'s", "x" * 5000, "\x1c\x1d a\x85b c​ d",
       "日本語 テスト １２３ ½ é", "👩‍👩‍👧 🇩🇪 a'", "'", "'r", "  lead   and trail  ", "tab\tnew\n\nline\r\n", "<s> </s> <0x41> <unk>", "a\x00b", "\U0010ffff x", "word " * 40_000]


def texts(n=600, seed=1):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        out.append("".join(rng.choice("'srevlmtd a.1\n!<é") for _ in range(rng.randint(1, 30))))
        out.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x500), rng.randint(0x3040, 0x30FF), 0x20, 0x1F600])) for _ in range(rng.randint(1, 40))))
    return out


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    engine, t = token_counts.Transducer(path), texts()
    got = [n for b in token_counts.blocks(t, 5000) for n in engine.counts(b).tolist()]
    assert got == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]


def library_counts(t):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(t, add_special_tokens=False)]


EVERY = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]


@pytest.mark.parametrize("frame", ["%s", "a%sb", "!%s!", "%s\ubdf5"])
def test_token_counts_of_every_code_point(frame):
    engine, t = token_counts.transducer(public_tokenizers.path("word_bpe_49k.json")), [frame % c for c in EVERY]
    assert [n for b in token_counts.blocks(t) for n in engine.counts(b).tolist()] == library_counts(t)


def test_token_counts_of_random_strings():
    engine, rng = token_counts.transducer(public_tokenizers.path("word_bpe_49k.json")), random.Random(9)
    kinds = [lambda: chr(rng.randint(97, 122)), lambda: chr(rng.randint(32, 126)), lambda: chr(rng.randint(160, 0x500)), lambda: chr(rng.randint(0x300, 0x36F)),
             lambda: chr(rng.choice([rng.randint(0xAC00, 0xD7A3), rng.randint(0x1100, 0x11FF), rng.randint(0x3040, 0x30FF)])), lambda: rng.choice(EVERY), lambda: rng.choice(" \n'")]
    t = ["".join(rng.choice(kinds)() for _ in range(rng.randint(1, 50))) for _ in range(20_000)]
    t += ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (47, 48, 49, 3000)]
    want = library_counts(t)
    assert [n for b in token_counts.blocks(t) for n in engine.counts(b).tolist()] == want
    old, token_counts.STATES_KEPT = token_counts.STATES_KEPT, 50
    try:  # forgetting changes nothing
        assert [n for b in token_counts.blocks(t[-500:], 300) for n in engine.counts(b).tolist()] == want[-500:]
    finally:
        token_counts.STATES_KEPT = old


def test_merge_transitions_emit_only_what_is_settled():
    engine = token_counts.Transducer(public_tokenizers.path("word_bpe_49k.json"))
    machine, rng = engine.merges, random.Random(2)
    for _ in range(300):
        word = [rng.choice(b"etaoinshrdlu") for _ in range(rng.randint(2, 12))]
        word[-1] += 256
        state, steps = 0, []
        for x in word:
            got = machine.compile(state << 9 | x)
            state = got >> 16
            steps.append(got & 0xFFFF)
        assert state == 0 and sum(steps) == len(machine._merged(tuple(word)))
        # tokens emitted before the end stand whatever follows
        other = [*word[:-1], word[-1] - 256, 256 + rng.choice(b"etaoin")]
        assert sum(steps[:-1]) < len(machine._merged(tuple(other)))


def test_other_tokenizer_settings_are_refused(tmp_path):
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            token_counts.Transducer(str(tmp_path / "t.json"))


def test_entry_states_equal_a_plain_walk():
    engine, rng = token_counts.Transducer(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(0)
    rows = rng.integers(0, 11, (37, 16)).astype(np.uint8)
    state, want = token_counts.FREE, []
    for row in rows:
        want.append(state)
        for c in row:
            state = engine.step[state, c]
    assert engine.entries(rows).tolist() == want


def test_token_count_operator(spark):
    rows = [(1, "two words", 5), (2, None, 5), (3, "", 5), (1, "two words", 5), (None, "a " * 3000, 5)]
    x = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, token_counts.token_counts(x, public_tokenizers.path("word_bpe_49k.json")).fillna(-1, ["doc_id"]).collect()))
    assert got == [(-1, 6000, 3000, True), (1, 9, 2, False), (1, 9, 2, False), (2, 0, 0, False), (3, 0, 0, False)]
    assert token_counts.token_counts(x.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_sentencepiece_equals_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    engine, library, t = sentencepieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path), texts()
    got = engine.encode(t)
    assert got == library.encode(t, num_threads=1)
    assert [engine.decode(i) for i in got] == t
    engine.words.clear()
    old, sentencepieces.KEPT = sentencepieces.KEPT, 10
    try:
        assert [i for x in t[:200] for i in engine.encode([x])] == got[:200]
    finally:
        sentencepieces.KEPT = old


def test_unigram_viterbi_with_shared_prefixes():
    engine = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    engine.merges = False
    engine.score = {"▁": -1.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁a": -2.5, "ba": -1.0, "c": -9.0}
    engine.ids = {p: i for i, p in enumerate(engine.score)}
    engine.ends = {}
    for p in engine.ids:
        engine.ends.setdefault(p[-1], []).append(len(p))
    engine.words = {}

    def best(w):
        rows = [(0.0, [])]
        for i in range(1, len(w) + 1):
            rows.append(max(((rows[j][0] + engine.score[w[j:i]], [*rows[j][1], w[j:i]]) for j in range(i) if w[j:i] in engine.score), key=lambda r: r[0]))
        return rows[-1][1]

    words = ["▁ab", "▁aba", "▁abab", "▁b", "▁bac", "▁bb"]
    engine.learn(words)
    assert all(engine.words[w] == [engine.ids[p] for p in best(w)] for w in words)


def test_sentencepiece_operator(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    x = spark.createDataFrame([(1, "Hello  world\n", 1), (2, None, 1), (3, "", 1), (4, "a▁b", 1)], "doc_id long, text string, ids long")
    got = {r["doc_id"]: r for r in sentencepieces.digest(x, path, keep_ids=True).collect()}
    assert got[1]["round_trip"] and got[2]["n_pieces"] == 0 and got[3]["round_trip"] and not got[4]["round_trip"]
    assert got[1]["ids_sha256"] == hashlib.sha256(np.array(got[1]["ids"], "<i4").tobytes()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(sentencepieces.encode(x, path), path).collect()}
    assert back == {1: "Hello  world\n", 2: "", 3: "", 4: "a b"}
    assert sentencepieces.digest(x.limit(0), path).count() == 0


def test_merging_matches_a_plain_loop():
    rng = random.Random(4)
    ranks = {}
    symbols = list("abc")
    for i in range(40):
        a, b = rng.choice(symbols), rng.choice(symbols)
        ranks.setdefault((a, b), i)
        symbols.append(a + b)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
        plain = list(w)
        while True:
            r = min(((ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks), default=None)
            if r is None:
                break
            plain[r[1]: r[1] + 2] = [plain[r[1]] + plain[r[1] + 1]]
        assert merge(w, lambda a, b: ranks.get((a, b))) == plain


class Foreign:
    """A bit stream put together by hand from the format's description; nothing of the encoder is used."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, lengths, size):
        """A prefix code as literal lengths and runs (16, 17, 18); returns its codes, first bit first."""
        tokens, i, last = [], 0, None
        full = [lengths.get(s, 0) for s in range(size)]
        while i < size:
            n = 1
            while i + n < size and full[i + n] == full[i]:
                n += 1
            if full[i] == 0 and n >= 11:
                n = min(n, 138)
                tokens.append((18, n - 11, 7))
            elif full[i] == 0 and n >= 3:
                n = min(n, 10)
                tokens.append((17, n - 3, 3))
            elif full[i] and full[i] == last and n >= 3:
                n = min(n, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = 1
                tokens.append((full[i], 0, 0))
                last = full[i] or last
            i += n
        self.put(0, 1)
        used = sorted({t[0] for t in tokens})
        assert len(used) > 1
        n = (len(used) - 1).bit_length()
        own = {s: n - 1 if i < (1 << n) - len(used) else n for i, s in enumerate(used)}
        self.put(15, 4)
        for s in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15):
            self.put(own.get(s, 0), 3)
        self.put(0, 1)
        codes = self.canonical(own)
        for s, extra, n in tokens:
            self.bits += codes[s]
            self.put(extra, n)
        return self.canonical({s: n for s, n in lengths.items() if n})

    @staticmethod
    def canonical(lengths):
        code, before, out = 0, 0, {}
        for n, s in sorted((n, s) for s, n in lengths.items()):
            code <<= n - before
            out[s] = [code >> (n - 1 - i) & 1 for i in range(n)]
            code, before = code + 1, n
        return out

    def flat(self, symbols, size):
        """A complete code over some symbols, of two neighbouring lengths."""
        n = (len(symbols) - 1).bit_length()
        short = (1 << n) - len(symbols)
        return self.code({s: n - 1 if i < short else n for i, s in enumerate(symbols)}, size)

    def image(self, stream, cache, main):
        """Codes and symbols: ("p", argb), ("c", place), ("b", length, distance code)."""
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        places = 1 << cache if cache else 0
        green = self.flat([*range(256), *range(256, 264), *range(280, 280 + places)], 280 + places)
        rest = [self.flat(list(range(256)), 256) for _ in range(3)]
        far = self.flat(list(range(14)), 40)
        for item in stream:
            if item[0] == "p":
                v = item[1]
                self.bits += green[v >> 8 & 255] + rest[0][v >> 16 & 255] + rest[1][v & 255] + rest[2][v >> 24]
            elif item[0] == "c":
                self.bits += green[280 + item[1]]
            else:
                for codes, value, base in ((green, item[1], 256), (far, item[2], 0)):
                    s = next(s for s in range(40) if self.least(s) <= value < self.least(s + 1))
                    self.bits += codes[base + s]
                    self.put(value - self.least(s), max(0, (s - 2) >> 1))

    @staticmethod
    def least(s):
        return s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1

    def file(self):
        self.bits += [0] * (-len(self.bits) % 16)
        data = bytes(sum(b << i for i, b in enumerate(self.bits[k: k + 8])) for k in range(0, len(self.bits), 8))
        body = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
        return b"RIFF" + len(body).to_bytes(4, "little") + body

    @classmethod
    def header(cls, width, height):
        out = cls()
        for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            out.put(v, n)
        return out


#: The first near neighbours of the format's table (columns to the left, rows up), and its last. Fixed values.
NEAR = {1: (0, 1), 2: (1, 0), 3: (1, 1), 4: (-1, 1), 5: (0, 2), 6: (2, 0), 7: (1, 2), 8: (-1, 2), 9: (2, 1), 10: (-2, 1), 11: (2, 2), 12: (-2, 2), 13: (0, 3), 14: (3, 0), 15: (1, 3), 16: (-1, 3), 120: (8, 7)}


def random_pixels(rng, count, width, cache, main=True):
    """A random stream and, by plain steps, the pixels that it means."""
    stream, out, known = [], [], {}

    def emit(v):
        out.append(v)
        known[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache) if cache else 0] = v

    while len(out) < count:
        kind = rng.random()
        if kind < 0.2 and out:
            code = rng.choice([*NEAR, *range(121, 160)])
            d = max(1, NEAR[code][0] + NEAR[code][1] * width) if code in NEAR else code - 120
            n = rng.randint(1, min(12, count - len(out)))
            if d <= len(out) and code < 129:
                stream.append(("b", n, code))
                for _ in range(n):
                    emit(out[-d])
                continue
        if kind < 0.5 and cache:
            place = rng.randrange(1 << cache)
            stream.append(("c", place))
            emit(known.get(place, 0))
            continue
        v = rng.getrandbits(32) if rng.random() < 0.7 or not out else rng.choice(out)
        stream.append(("p", v))
        emit(v)
    return stream, out


def argb(v):
    return [v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255]


def rows_of_pixels(image):
    return [[[v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24] for v in row] for row in image]


@pytest.mark.parametrize("cache", [0, 1, 4, 8])
def test_foreign_streams_of_references_and_cache(cache):
    rng = random.Random(cache)
    for _ in range(12):
        width, height = rng.randint(1, 20), rng.randint(1, 20)
        stream, want = random_pixels(rng, width * height, width, cache)
        f = Foreign.header(width, height)
        f.put(0, 1)
        f.image(stream, cache, True)
        assert webp.decode(f.file()).tolist() == rows_of_pixels([want[i: i + width] for i in range(0, len(want), width)])


def plain_predict(mode, l, t, r, c):
    """The format's fourteen predictions of one pixel, sample by sample."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    cut = lambda v: min(255, max(0, v))
    if mode == 11:
        guess = [x + y - z for x, y, z in zip(l, t, c)]
        to_l, to_t = (sum(abs(g - x) for g, x in zip(guess, p)) for p in (l, t))
        return l if to_l < to_t else t
    if mode == 12:
        return [cut(x + y - z) for x, y, z in zip(l, t, c)]
    if mode == 13:
        return [cut(m + int((m - z) / 2)) for m, z in zip(avg(l, t), c)]
    return {0: [255, 0, 0, 0], 1: l, 2: t, 3: r, 4: c, 5: avg(avg(l, r), t), 6: avg(l, c), 7: avg(l, t), 8: avg(c, t), 9: avg(t, r), 10: avg(avg(l, c), avg(t, r))}.get(mode, [255, 0, 0, 0])


@pytest.mark.parametrize("mode", [*range(14), "mixed"])
def test_foreign_streams_with_predictors(mode):
    rng = random.Random(str(mode))
    for width, height in ((1, 1), (1, 7), (9, 1), (5, 4), (13, 11)):
        stream, left = random_pixels(rng, width * height, width, 0)
        wide, high = (width + 3) >> 2, (height + 3) >> 2
        modes = [rng.randrange(14) if mode == "mixed" else mode for _ in range(wide * high)]
        f = Foreign.header(width, height)
        for v, n in ((1, 1), (0, 2), (0, 3)):
            f.put(v, n)
        f.image([("p", rng.getrandbits(8) | m << 8 | rng.getrandbits(8) << 16) for m in modes], 0, False)
        f.put(0, 1)
        f.image(stream, 0, True)
        out = []
        for i, v in enumerate(left):
            y, x = divmod(i, width)
            at = lambda k: argb(out[k])  # noqa: B023,E731
            if i == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = at(i - 1)
            elif x == 0:
                p = at(i - width)
            else:
                p = plain_predict(modes[(y >> 2) * wide + (x >> 2)], at(i - 1), at(i - width), at(i - width + 1), at(i - width - 1))
            a, r, g, b = ((e + q) & 255 for e, q in zip(argb(v), p))
            out.append(a << 24 | r << 16 | g << 8 | b)
        assert webp.decode(f.file()).tolist() == rows_of_pixels([out[i: i + width] for i in range(0, len(out), width)])


def test_foreign_streams_with_colour_transforms_and_palettes():
    rng = random.Random(77)
    signed = lambda v: v - 256 if v > 127 else v
    for trial in range(40):
        width, height = rng.randint(1, 14), rng.randint(1, 9)
        kind = trial % 3 + 1
        f = Foreign.header(width, height)
        f.put(1, 1)
        f.put(kind, 2)
        inner = width
        if kind == 1:
            f.put(1, 3)
            wide, high = (width + 7) >> 3, (height + 7) >> 3
            tiles = [rng.getrandbits(32) for _ in range(wide * high)]
            f.image([("p", v) for v in tiles], 0, False)
        if kind == 3:
            n = rng.choice([1, 2, 3, 4, 9, 16, 17, 200, 256])
            f.put(n - 1, 8)
            steps, colours, now = [rng.getrandbits(32) for _ in range(n)], [], [0] * 4
            f.image([("p", v) for v in steps], 0, False)
            for v in steps:
                now = [(x + y) & 255 for x, y in zip(now, argb(v))]
                colours.append(now[0] << 24 | now[1] << 16 | now[2] << 8 | now[3])
            pack = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
            inner = -(-width // pack)
        f.put(0, 1)
        stream, got = random_pixels(rng, inner * height, inner, 0)
        f.image(stream, 0, True)
        out = []
        for y in range(height):
            for x in range(width):
                a, r, g, b = argb(got[y * inner + (x // pack if kind == 3 else x)])
                if kind == 1:
                    t = argb(tiles[(y >> 3) * wide + (x >> 3)])
                    r = (r + (signed(t[3]) * signed(g) >> 5)) & 255
                    b = (b + (signed(t[2]) * signed(g) >> 5) + (signed(t[1]) * signed(r) >> 5)) & 255
                elif kind == 2:
                    r, b = (r + g) & 255, (b + g) & 255
                else:
                    bits = 8 // pack
                    k = g >> bits * (x % pack) & (1 << bits) - 1
                    out.append(colours[k] if k < len(colours) else 0)
                    continue
                out.append(a << 24 | r << 16 | g << 8 | b)
        assert webp.decode(f.file()).tolist() == rows_of_pixels([out[i: i + width] for i in range(0, len(out), width)])


def test_stored_files_use_what_pays():
    rng = random.Random(6)
    ramp = bytes(b for i in range(4000) for b in ((3 * i + rng.randrange(2)) & 255, (5 * i + rng.randrange(2)) & 255, (7 * i) & 255, (i + rng.randrange(2)) & 255))
    row = [rng.randrange(256) for _ in range(64)]
    table = bytes((v + rng.randrange(3)) & 255 for _ in range(200) for v in row)
    green = [rng.randrange(-100, 100) for _ in range(6000)]
    tinted = bytes(x & 255 for g in green for x in ((g * 24 >> 5) + rng.randrange(3), g, (g * -16 >> 5) + rng.randrange(3), 255))
    grey = bytes(x for _ in range(6000) for g in [rng.randrange(256)] for x in ((g + rng.randrange(2)) & 255, g, (g + rng.randrange(2)) & 255, 255))
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(4)) for _ in range(300)]
    prose = b"".join(rng.choice(words) + (b" abc" if rng.random() < 0.5 else b"") for _ in range(9000))
    for data, kind in ((ramp, webp.PREDICT), (table, webp.PREDICT), (tinted, webp.CROSS), (grey, webp.GREEN), (prose, None), (b"ab" * 9000, "palette"), (bytes(64), None)):
        image = webp.to_image(data)
        how = webp.choose(image)
        assert kind == "palette" or how.get("transforms", (None,)) == (kind,)
        media = webp.stored(data)
        assert webp.decode(media).tobytes()[: len(data)] == data and media == webp.stored(data)
        if kind in (webp.PREDICT, webp.CROSS, webp.GREEN) or data is prose:
            assert len(media) < len(webp.encode(image))
    assert webp.choose(webp.to_image(prose))["cache"] == 11


def prose_payloads(count, rng):
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return [webp.padded(" ".join(rng.choice(words) for _ in range(rng.randint(250, 450))).encode()) for _ in range(count)]


def test_files_made_together_are_those_made_alone():
    rng = random.Random(17)
    payloads = [*prose_payloads(12, rng), bytes(64), b"ab" * 3000, rng.randbytes(5000), bytes(range(64)), *prose_payloads(1, rng) * 2]
    payloads += [bytes((3 * i + rng.randrange(2)) & 255 for i in range(9000)), bytes(x for _ in range(3000) for g in [rng.randrange(256)] for x in (g, g, g, 255))]
    media, old = webp.stored_all(payloads), webp.TOGETHER
    assert [webp.decode(m).tobytes()[: len(p)] for m, p in zip(media, payloads)] == payloads
    for webp.TOGETHER in (1, 1500, 1 << 30):
        assert webp.stored_all(payloads) == media
    webp.TOGETHER = old
    assert webp.stored_all(payloads[::-1]) == media[::-1] and webp.stored_all([]) == []
    assert [webp.encode(image, **how) for image, how in zip(map(webp.to_image, payloads), webp.choose_all([webp.to_image(p) for p in payloads]))] == media


def test_steps_of_many_files_are_shared():
    # time is the machine's, calls are not: what a file of some 500 pixels costs in calls of Python and NumPy
    payloads, calls = prose_payloads(128, random.Random(3)), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    webp.stored_all(payloads)
    sys.setprofile(count)
    try:
        webp.stored_all(payloads)
    finally:
        sys.setprofile(None)
    assert calls < 300 * len(payloads)


def test_known_webp_file():
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]


@pytest.mark.parametrize("seed", range(4))
def test_webp_round_trips(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        h, w = rng.integers(1, 40, 2)
        im = [lambda: rng.integers(0, 256, (h, w, 4)), lambda: rng.integers(0, 3, (h, w, 4)), lambda: np.zeros((h, w, 4)), lambda: rng.integers(0, 2, (h, w, 1)) * np.ones((1, 1, 4)), lambda: np.cumsum(rng.integers(0, 3, (h, w, 4)), 1)][rng.integers(0, 5)]().astype(np.uint8)
        colours = len(np.unique(im.reshape(-1, 4), axis=0))
        steps = [int(t) for t in rng.permutation(3) if rng.random() < 0.5]
        wide = w
        if colours <= 256 and rng.random() < 0.4:
            steps = [webp.PALETTE, *steps]
            pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            wide = (w + (1 << pack) - 1) >> pack
        tile, group = int(rng.integers(2, 6)), int(rng.integers(2, 5))
        side = lambda n, t: (n + (1 << t) - 1) >> t
        shape = side(h, tile), side(wide, tile)
        modes = (rng.integers(0, 14, shape) << 8 | 0xFF000000).astype(np.uint32)
        cross = (rng.integers(0, 1 << 24, shape) | 0xFF000000).astype(np.uint32)
        groups = (group, rng.integers(0, 3, (side(h, group), side(wide, group)))) if rng.random() < 0.3 else None
        cache = int(rng.integers(1, 12)) if rng.random() < 0.5 else 0
        data = webp.encode(im, tuple(steps), tile, cache, bool(rng.random() < 0.7), modes, cross, groups, palette=False)
        assert np.array_equal(webp.decode(data), im)
        assert np.array_equal(webp.decode(webp.encode(im)), im)


def test_webp_windows_and_bad_streams():
    rng = np.random.default_rng(9)
    im = np.frombuffer(("The quick brown fox. " * 900 + "x" * 64)[:16384].encode(), np.uint8).reshape(-1, 16, 4).copy()
    im[::3] = rng.integers(0, 256, im[::3].shape)
    data = webp.encode(im)
    old, webp.WINDOW = webp.WINDOW, 1 << 10
    try:
        assert np.array_equal(webp.decode(data), im)
    finally:
        webp.WINDOW = old
    for bad in (b"", b"RIFFxxxxWEBP", data[:40] + data[60:], data[:8] + b"JUNK" + data[12:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_webp_operator(spark):
    rows = [(1, "abc", 9), (2, None, 9), (3, "", 9), (4, "abc", 9), (5, "é" * 1000 + "\n" * 500, 9), (None, "z" * 70_000, 9)]
    x = spark.createDataFrame(rows, "doc_id long, text string, media long")
    got = {r["doc_id"]: r for r in webp.stored_and_read(x).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1]["media_sha256"] == got[4]["media_sha256"] and got[2]["feature"] == got[3]["feature"] and len(got[5]["feature"]) == 16
    assert webp.stored_and_read(x.limit(0)).count() == 0
    media = webp.store(x.where("doc_id = 5")).unionByName(spark.createDataFrame([(7, 1, 1, bytearray(b"junk"))], "doc_id long, n_bytes long, payload_bytes long, media binary"))
    p = {r["doc_id"]: r for r in webp.pixel_arrays(media).collect()}
    assert p[7]["pixels"] is None and bytes(p[5]["pixels"])[:2000] == ("é" * 1000).encode() and p[5]["width"] == 16
