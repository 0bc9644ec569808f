"""SentencePiece encoding and decoding by a forward pass shared between words with a common prefix.

No piece of the model crosses from other characters into a space mark, so a text is a sequence of marked
words and only distinct ones need work. Sorted, they are a trie in depth-first order: the forward row of a
word's prefix is reused by all words below it. For a unigram model the row holds best scores (Viterbi). For
a merge (BPE) model the best split of a prefix is the one that merging gives; its last piece is the only one
whose pair with the piece before it stays apart when the two are merged on their own, so the same forward
recursion runs on that test instead of a sum of scores and gives the library's result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.bpe import merge
from perigee.llm.common import table, text_of
from perigee.llm.token_counts import blocks

SPACE = "▁"
#: Words and piece pairs that a worker remembers; beyond it, it forgets all and goes on.
KEPT = 1 << 19
#: Characters of texts that are encoded together; distinct words are sorted inside such a block.
BLOCK = 1 << 20


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.merges = model.trainer_spec.model_type == 2
        spec = model.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are covered")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.ids, self.score, self.raw, self.byte = {}, {}, [], {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[3:-1], 16)
                self.byte[b] = i
                self.raw.append(bytes([b]))
            elif p.type in (2, 3):
                self.raw.append(b"")
            else:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.raw.append(p.piece.encode())
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.strip(SPACE) or p.endswith(SPACE) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses words")
        self.words: dict[str, list[int]] = {}
        self.apart: dict[int, bool] = {}
        line = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
        self.split = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else "")).findall
        self.ends: dict[str, list[int]] = {}  # lengths of pieces by last character, longest first
        for p in self.ids:
            self.ends.setdefault(p[-1], []).append(len(p))
        self.ends = {c: sorted(set(n), reverse=True) for c, n in self.ends.items()}
        self.names = {i: p for p, i in self.ids.items()}
        self.tails: dict[str, list[int]] = {}  # lengths from three up by the last three characters, longest first
        for p in self.ids:
            if len(p) > 2:
                self.tails.setdefault(p[-3:], []).append(len(p))
        self.tails = {c: sorted(set(n), reverse=True) for c, n in self.tails.items()}

    def _stay(self, a: int, b: int) -> bool:
        """Merging two pieces from their characters ends in just these two; ``a`` is -1 for an unknown character."""
        if (got := self.apart.get(a << 32 | b)) is None:
            if len(self.apart) > KEPT:
                self.apart.clear()
            get, parts = self.score.get, [self.names[b]] if a < 0 else [self.names[a], self.names[b]]
            got = merge(list("".join(parts)), lambda x, y: None if (s := get(x + y)) is None else -s) == parts
            self.apart[a << 32 | b] = got
        return got

    def _learn_merges(self, words: list[str]) -> None:
        """As ``learn`` for a merge model: the rows hold the number and the length of each prefix's last piece."""
        get, tails, stay, apart, known = self.ids.get, self.tails.get, self._stay, self.apart.get, self.words
        last, size, before = [0], [0], ""
        for word in sorted(words):
            n = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                n += 1
            del last[n + 1:], size[n + 1:]
            for i in range(n + 1, len(word) + 1):
                found, k = None, 0
                if i > 2:
                    for k in tails(word[i - 3: i], ()):
                        if k <= i and (p := get(word[i - k: i])) is not None and (k == i or apart(last[i - k] << 32 | p) or stay(last[i - k], p)):
                            found = p
                            break
                if found is None and i > 1 and (p := get(word[i - 2: i])) is not None and (i == 2 or apart(last[i - 2] << 32 | p) or stay(last[i - 2], p)):
                    found, k = p, 2
                if found is None:
                    found, k = get(word[i - 1], -1), 1
                last.append(found)
                size.append(k)
            before, i, out = word, len(word), []
            while i:
                if (p := last[i]) >= 0:
                    out.append(p)
                else:
                    out += self._ids(word[i - 1])[::-1]
                i -= size[i]
            out.reverse()
            known[word] = out

    def learn(self, words: list[str]) -> None:
        """Encode distinct words: sorted, each continues from the forward row it shares with the one before."""
        if self.merges:
            return self._learn_merges(words)
        last: list[str] = [""]  # last piece of the best split of each prefix
        best: list[float] = [0.0]
        before = ""
        for word in sorted(words):
            n = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                n += 1
            del last[n + 1:], best[n + 1:]
            for i in range(n + 1, len(word) + 1):
                self._forward(word, i, last, best)
            before, i, out = word, len(word), []
            while i:
                out.append(last[i])
                i -= len(last[i])
            self.words[word] = [k for p in reversed(out) for k in self._ids(p)]

    def _forward(self, word: str, i: int, last: list[str], best: list[float]) -> None:
        """The best split of a prefix by scores."""
        found, top = word[i - 1], -math.inf
        for n in self.ends.get(word[i - 1], ()):
            if n > i or (p := word[i - n: i]) not in self.ids:
                continue
            if best[i - n] + self.score[p] > top:
                found, top = p, best[i - n] + self.score[p]
        last.append(found)
        best.append(top if top > -math.inf else best[i - 1] - 1e4)  # an unknown character

    def _ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.byte.get(b, 0) for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        marked = [self.split(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set(chain.from_iterable(marked)).difference(self.words)
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
            new = set(chain.from_iterable(marked))
        self.learn(list(new))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, m))) for m in marked]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (array<int>) of every whole text; null and empty texts have no pieces.

    Equal to the library's plain encode for merge models. Characters without a piece become their bytes.
    No shuffle; a worker remembers a bounded number of words. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = pieces(path)
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1).to_pylist(), BLOCK):
                ids = engine.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                at += len(part)

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return x.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; ids of control pieces give nothing, null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = pieces(path)
        for batch in batches:
            at = 0
            text = [engine.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_sha256, round_trip`` (and ``ids``): encoded, decoded and compared.

    ``ids_sha256`` is over the ids as little-endian 32-bit words. ``round_trip`` tells whether decoding gives
    the text back; only a text that itself holds the space mark U+2581 doesn't, as it is read as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = pieces(path)
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1).to_pylist(), BLOCK):
                ids = engine.encode(part)
                out = [batch.column(0).slice(at, len(part)), pa.array([len(t.encode()) for t in part], pa.int64()),
                       pa.array(map(len, ids), pa.int64()),
                       pa.array([hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for i in ids]),
                       pa.array([engine.decode(i) == t for i, t in zip(ids, part)])]
                names = ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "round_trip"]
                if keep_ids:
                    out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)
                at += len(part)

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    kind = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean"
    return x.mapInArrow(run, kind + ", ids array<int>" * keep_ids)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
