"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one behind the other. The first is the pre-tokenizer's pattern over
character classes: its states say what of a word is open, its transitions mark where words start. Texts are
cut into chunks of equal length; each chunk's effect is a map from entry state to exit state, the maps of all
chunks compose in a parallel prefix scan, and with the entry states known every chunk finds its words on its
own, all chunks in step. The second is the merge table over bytes: a state holds the pieces that may still
grow, each with the piece before it, and a transition emits the number of tokens that no later byte can
change. Its transitions are compiled when first met and kept in a table of bounded size; all words of a block
run through it in step.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.bpe import merge
from perigee.llm.common import table, text_of

LIMIT = 2048
CHUNK = 64
#: Texts are worked on together up to this many characters.
BLOCK = 1 << 18
#: States of the merge transducer that one worker keeps; beyond it compilation starts afresh.
STATES_KEPT = 1 << 17
#: Words of more bytes than this run through the transducer one by one, others in step.
IN_STEP = 48

# character classes
SPACE, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, L, E, SPECIAL = range(11)
# states: nothing open, letters, other signs, a quote that opens a token, and that with r, v or l behind it
FREE, WORD, SIGNS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
# what a transition marks: a token starts at this character, or at the one before as well
NONE, HERE, BEFORE, BOTH = range(4)


def compile_pattern() -> tuple[np.ndarray, np.ndarray]:
    """``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` as (next state, mark) by [state, class]."""
    step, mark = np.zeros((7, 11), np.uint8), np.zeros((7, 11), np.uint8)
    letters = (LETTER, ONE, R, V, L, E)
    for state in range(7):
        for c in range(11):
            if c == SPACE:
                to = FREE, NONE
            elif c in (NUMBER, SPECIAL):
                to = FREE, HERE
            elif c in (OTHER, QUOTE):
                to = (SIGNS, NONE) if state in (SIGNS, QUOTED) else (QUOTED if c == QUOTE else SIGNS, HERE)
            else:
                to = WORD, NONE if state == WORD else HERE
            if state == QUOTED and c in letters:
                # a contraction in one letter closes; r, v, l wait for their second
                to = {ONE: (FREE, NONE), R: (QUOTE_R, NONE), V: (QUOTE_V, NONE), L: (QUOTE_L, NONE)}.get(c, (WORD, HERE))
            if state in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if state == QUOTE_L else E):
                    to = FREE, NONE
                elif c in letters:
                    to = WORD, BEFORE  # it was a word's first letter
                else:
                    to = to[0], BOTH if to[1] == HERE else BEFORE
            step[state, c], mark[state, c] = to
    return step, mark


#: Stands for an added token in a text; a non-character that normal texts don't hold.
MARK = "\U0010ffff"
#: What the compiled automaton covers; a file that says otherwise is refused. Fixed values of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


@cache
def _classes() -> np.ndarray:
    """The class of every code point, as the library's own splitter tells them apart."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for c, pattern in ((SPACE, r"\s+"), (LETTER, r"[\p{L}]+"), (NUMBER, r"[\p{N}]+")):
            for _, (a, z) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                out[low + a: low + z] = c
    for c, chars in ((QUOTE, "'"), (ONE, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (SPECIAL, MARK)):
        for x in chars:
            out[ord(x)] = c
    return out


@cache
def _unsure() -> re.Pattern:
    """Characters that may be normalised in another way by another Unicode version.

    Those unknown here, and those above U+0370 that combine with what stands before them. All others have one
    lower case and composition for good; texts with one of these are left to the library's own normaliser.
    """
    marks = [0x370 <= i and (unicodedata.category(chr(i)) in ("Cn", "Mn", "Mc", "Me") or 0x1100 <= i < 0x1200) for i in range(0x110000)]
    edge = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]] + [len(marks)]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in zip(edge[::2], edge[1::2])) + "]")


class Merges:
    """The merge table as a transducer over symbols: bytes, and 256 more for the last byte of a word.

    A state is a tuple of numbers, one for each tail of what was read that some piece starts with, longest
    first: the tail as a trie node, the last piece of all before it, and how many tokens that has beyond
    those already emitted. A piece ends the best split of what was read just when merging it and the piece
    before it on their own leaves both, which one of the tails fulfils.
    """

    def __init__(self, merges: list[tuple[str, str]], symbols: dict[str, int]):
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.names, self.seq, self.piece_at = list(symbols), [(i,) for i in symbols.values()], {}
        at = dict(zip(self.names, range(len(self.names))))
        for a, b in merges:
            if a + b in at:
                raise ValueError(f"two merges make {a + b!r}")
            at[a + b] = len(self.names)
            self.names.append(a + b)
            self.seq.append(self.seq[at[a]] + self.seq[at[b]])
        self.spelt = {i: x for x, i in symbols.items()}
        self.trie, self.piece, n = {}, {}, 1  # node 0 is the root
        for k, seq in enumerate(self.seq):
            if len(seq) > 1 and not self._whole(k):
                continue  # a piece that merging never leaves
            node = 0
            for x in seq:
                if (to := self.trie.get(node << 9 | x)) is None:
                    to = self.trie[node << 9 | x] = n
                    n += 1
                node = to
            self.piece[node] = k + 1
        self.apart: dict[int, bool] = {}
        self.clear()

    def _merged(self, seq: tuple[int, ...]) -> list[str]:
        get = self.ranks.get
        return merge([self.spelt[x] for x in seq], lambda a, b: get((a, b)))

    def _whole(self, k: int) -> bool:
        return self._merged(self.seq[k]) == [self.names[k]]

    def _stay(self, a: int, b: int) -> bool:
        if (got := self.apart.get(a << 20 | b)) is None:
            if len(self.apart) > 4 * STATES_KEPT:
                self.apart.clear()
            got = self.apart[a << 20 | b] = self._merged(self.seq[a - 1] + self.seq[b - 1]) == [self.names[a - 1], self.names[b - 1]]
        return got

    def clear(self) -> None:
        """Forget all compiled transitions; state 0 is the start of a word."""
        self.states, self.number, self.known = [(0,)], {(0,): 0}, {}
        self._table(14)

    def _full(self) -> bool:
        return len(self.states) > STATES_KEPT or len(self.known) > 8 * STATES_KEPT

    def _table(self, bits: int) -> None:
        """The known transitions as an open hash table of ``2 ** bits`` slots."""
        self.bits, self.keys, self.values = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        if self.known:
            self._put(np.fromiter(self.known, np.int64, len(self.known)), np.fromiter(self.known.values(), np.int64, len(self.known)))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, key: np.ndarray, value: np.ndarray) -> None:
        slot, last = self._slot(key), (1 << self.bits) - 1
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]  # of several keys in one slot the last stays
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], slot[~placed] + 1 & last

    def compile(self, key: int) -> int:
        """The transition of ``state << 9 | symbol`` as ``next state << 16 | tokens emitted``."""
        symbol, tails, count, found = key & 511, [], 0, 0
        trie, piece = self.trie, self.piece
        for t in self.states[key >> 9]:
            # node, piece before it and tokens up to there
            if (node := trie.get((t >> 28) << 9 | symbol)) is None:
                continue
            before = t >> 8 & 0xFFFFF
            if not found and (p := piece.get(node)) and (not before or self._stay(before, p)):
                found, count = p, (t & 255) + 1
            tails.append(node << 28 | t & 0xFFFFFFF)
        if not found:
            raise ValueError("a symbol without a piece")
        if symbol > 255:
            to, emits = 0, count
        else:
            tails.append(found << 8 | count)
            emits = min(t & 255 for t in tails)
            state = tuple(t - emits for t in tails)
            if (to := self.number.get(state)) is None:
                to = self.number[state] = len(self.states)
                self.states.append(state)
        self.known[key] = got = to << 16 | emits
        return got

    def step(self, key: np.ndarray) -> np.ndarray:
        """The transitions of many keys at once; unknown ones are compiled first."""
        slot, last = self._slot(key), (1 << self.bits) - 1
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if not len(miss):
            return out
        slot, want = slot[miss], key[miss]
        while True:
            at = self.keys[slot]
            go = (at >= 0) & (at != want)
            if not go.any():
                break
            slot = np.where(go, slot + 1 & last, slot)
        out[miss] = self.values[slot]
        if (new := at < 0).any():
            fresh = np.unique(want[new])
            value = np.fromiter(map(self.compile, fresh.tolist()), np.int64, len(fresh))
            if len(self.known) * 3 > 1 << self.bits:
                self._table(self.bits + 2)
            else:
                self._put(fresh, value)
            out[miss[new]] = value[np.searchsorted(fresh, want[new])]
        return out

    def walk(self, symbols: np.ndarray) -> int:
        """Tokens of one word of any length."""
        state = total = 0
        for x in symbols.tolist():
            if (got := self.known.get(state << 9 | x)) is None:
                if self._full():
                    held = self.states[state]
                    self.clear()
                    if held != (0,):
                        self.states.append(held)
                        self.number[held] = 1
                    state = len(self.states) - 1
                got = self.compile(state << 9 | x)
            state, total = got >> 16, total + (got & 0xFFFF)
        return total

    def tokens(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word ``symbols[start: start + size]``; the last symbol of each is above 255."""
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(size > IN_STEP).tolist():
            out[i] = self.walk(symbols[start[i]: start[i] + size[i]])
        if self._full():
            self.clear()
        if len(self.known) * 3 > 1 << self.bits:
            self._table(int(len(self.known) * 3).bit_length() + 1)
        short = np.flatnonzero(size <= IN_STEP)
        short = short[np.argsort(-size[short], kind="stable")]
        at, n, total = start[short], size[short], np.zeros(len(short), np.int64)
        state = np.zeros(len(short), np.int64)
        for p in range(int(n[0]) if len(n) else 0):
            k = int(np.searchsorted(-n, -p))  # those longer than p
            got = self.step(state[:k] << 9 | symbols[at[:k] + p])
            state[:k] = got >> 16
            total[:k] += got & 0xFFFF
        out[short] = total
        return out


class Transducer:
    """The compiled tokenizer of a ``tokenizers`` file of this pattern; files of other settings are refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model, pre, normal = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not (plain and normal.get("normalizers") == NORMAL and pre.get("pretokenizers") == SPLIT and model["type"] == "BPE"
                and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))):
            raise ValueError("a tokenizer of other settings than those compiled")
        suffix = model.get("end_of_word_suffix") or ""
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        symbols = {names[b]: b for b in range(256)} | {names[b] + suffix: 256 + b for b in range(256)}
        if not suffix or not symbols.keys() <= model["vocab"].keys():
            raise ValueError("a tokenizer without a piece for each byte, inside and at the end of a word")
        self.merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], symbols)
        self.library = Tokenizer.from_file(path).normalizer.normalize_str
        self.step, self.mark = compile_pattern()

    def normal(self, text: str) -> str:
        """What the automaton reads: NFC, lower case, added tokens as one mark."""
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return MARK.join(self._normal(p) for p in parts[::2])
        return self._normal(text)

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # a text's own U+10FFFF becomes another unassigned sign of as many bytes; it has no merges either
        text = text.replace(MARK, "\U0010fffe")
        if _unsure().search(text):
            return self.library(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def entries(self, classes: np.ndarray) -> np.ndarray:
        """Entry state of every chunk (rows of ``classes``): maps of all chunks, then their prefix scan."""
        n = len(classes)
        maps = np.tile(np.arange(7, dtype=np.uint8), (n, 1))
        flat = self.step.ravel()
        for j in range(classes.shape[1]):
            maps = flat[maps * np.uint8(11) + classes[:, j, None]]
        gap = 1
        while gap < n:  # after this round a map covers the 2 * gap chunks up to its own
            joined = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), axis=1)
            maps = np.concatenate([maps[:gap], joined])
            gap *= 2
        return np.concatenate([[FREE], maps[:-1, FREE]]).astype(np.uint8)

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens start in a normal text, and where those that are open end."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        classes = np.zeros(-(-(n + 1) // CHUNK) * CHUNK, np.uint8)
        classes[:n] = _classes()[code]
        rows = classes.reshape(-1, CHUNK)
        state, marks = self.entries(rows), np.empty(rows.shape, np.uint8)
        step, mark = self.step.ravel(), self.mark.ravel()
        for j in range(CHUNK):
            at = state * np.uint8(11) + rows[:, j]
            marks[:, j], state = mark[at], step[at]
        marks = marks.ravel()
        here = (marks & 1).astype(bool)
        here[:-1] |= marks[1:] >= BEFORE
        # a token ends where the next starts or at white space
        first = np.flatnonzero(here)
        edge = np.flatnonzero(here | (classes == SPACE))
        return first, edge[np.searchsorted(edge, first, "right")]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        normal = [self.normal(t) for t in texts]
        whole = " ".join(normal)
        first, end = self.starts(whole)
        symbols = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        # where each character starts among the bytes
        at = np.append(np.flatnonzero(symbols & 0xC0 != 0x80), len(symbols))
        start, stop = at[first], at[end]
        symbols[stop - 1] += 256
        special = symbols[start] == 0xF4
        special &= stop - start == 4
        special[special] = [whole[i] == MARK for i in first[special].tolist()]
        each = np.ones(len(first), np.int64)
        each[~special] = self.merges.tokens(symbols, start[~special], (stop - start)[~special])
        bounds = np.cumsum([0] + [len(t) + 1 for t in normal])
        total = np.concatenate([[0], np.cumsum(each)])
        at = np.searchsorted(first, bounds)
        return total[at[1:]] - total[at[:-1]]


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + 1
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; null counts as empty.

    Counts are those of the library without begin, end or padding; the special strings inside a text count
    as one token each. Empty texts have 0. Nothing is shuffled; a document of any length is cut into chunks
    that are worked on in step. Empty tables give empty results; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = transducer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.concatenate([np.zeros(0, np.int64), *[engine.counts(b) for b in blocks(texts)]])
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return x.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
