"""Lossless WebP: a full decoder of the VP8L bit stream, and the encoder that fills the store.

The decoder reads prefix codes, back-references and colour cache, with one or many code groups, and inverts
the predictor, cross-colour, subtract-green and palette transforms. With one code group the number of bits
that a pixel takes is a function of where it starts, so NumPy computes it for every bit of a window at once,
a plain loop follows the chain of pixel starts, and all pixels of the chain are gathered at once. Streams
with several code groups are read pixel by pixel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm.common import saved, table, text_of

PREDICT, CROSS, GREEN, PALETTE = range(4)
#: Side limit of the format.
SIDE = 1 << 14
#: Bits of a stream whose pixel lengths are computed together.
WINDOW = 1 << 20
#: Fixed by the format: the order in which the lengths of the length code are written.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The near neighbours that distance codes 1 to 120 stand for: by distance, then by column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
CACHE_FACTOR = 0x1E35A7BD
ALPHA = 0xFF000000


# ---------------------------------------------------------------- prefix codes


@lru_cache(maxsize=1)
def _turned() -> np.ndarray:
    """16-bit numbers with their bits in reverse."""
    x = np.arange(1 << 16, dtype=np.int64)
    for k in (1, 2, 4, 8):
        low = sum(((1 << k) - 1) << i for i in range(0, 16, 2 * k))
        x = (x >> k & low) | (x & low) << k
    return x


@lru_cache(maxsize=64)
def lookup(packed: bytes) -> tuple[np.ndarray, int]:
    """(symbol << 4 | length) by the next ``bits`` bits; for one symbol 0 bits. ``packed``: lengths by symbol."""
    lengths = np.frombuffer(packed, np.uint8)
    used = lengths.nonzero()[0]
    if len(used) == 0:
        return np.zeros(1, np.uint16), 0
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.uint16), 0
    n = lengths[used]
    order = n.argsort(kind="stable")
    n = n[order].astype(np.int64)
    bits = int(n[-1])
    share = 1 << bits - n
    if int(share.sum()) != 1 << bits:
        raise ValueError("a prefix code is not complete")
    # in canonical order the symbols fill the table in stretches, once its index is read from its first bit on
    return (used[order] << 4 | n).astype(np.uint16).repeat(share).take(_order(bits)), bits


def _small_codes(lengths: bytes | list[int]) -> list[int]:
    """As ``all_canonical``, step by step, for the few symbols of the length code."""
    out, code, before = [0] * len(lengths), -1, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code = (code + 1) << n - before if before else 0
        before = n
        out[s] = _TURNED_SMALL[code] >> 7 - n
    return out


_TURNED_SMALL = [int(f"{x:07b}"[::-1], 2) for x in range(128)]


@lru_cache(maxsize=1024)
def _small_lookup(packed: bytes) -> tuple[list[int], int]:
    """As ``lookup``, step by step, for the few symbols of the length code."""
    used = [s for s, n in enumerate(packed) if n]
    if len(used) < 2:
        return [s << 4 for s in used] or [0], 0
    bits = max(packed)
    if sum(1 << bits - packed[s] for s in used) != 1 << bits:
        raise ValueError("a prefix code is not complete")
    out, codes = [0] * (1 << bits), _small_codes(packed)
    for s in used:
        n = packed[s]
        out[codes[s]:: 1 << n] = [s << 4 | n] * (1 << bits - n)
    return out, bits


@lru_cache(maxsize=16)
def _order(bits: int) -> np.ndarray:
    """Numbers of so many bits with their bits in reverse."""
    return _turned()[: 1 << bits] >> (16 - bits)


_NEVER = 1 << 62


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman lengths by symbol, none above ``limit``; counts are flattened until they fit."""
    out = np.zeros(len(counts), np.uint8)
    used = counts.nonzero()[0]
    weight = counts[used].astype(np.int64)
    while len(used):
        order = weight.argsort(kind="stable")
        depth = _depths(weight[order].tolist())
        if depth[0] <= limit:
            out[used[order]] = depth
            break
        weight = (weight >> 1) | 1
    return out


def _depths(weights: list[int]) -> list[int]:
    """Depths of leaves in a Huffman tree, by rising weight, so that the first is deepest; of a single leaf 1."""
    n = len(weights)
    if n < 2:
        return [1] * n
    # what has run out or isn't made yet is larger than anything
    leaf, made = [*weights, _NEVER], [_NEVER] * n
    by_leaf, by_made, i, j, a = [0] * n, [0] * n, 0, 0, weights[0]
    for k in range(n - 1):
        b = made[j]
        if a <= b:
            by_leaf[i] = k
            i += 1
            total, a = a, leaf[i]
        else:
            by_made[j] = k
            j += 1
            total, b = b, made[j]
        if a <= b:
            by_leaf[i] = k
            i += 1
            made[k], a = total + a, leaf[i]
        else:
            by_made[j] = k
            j += 1
            made[k] = total + b
    depth = [1] * n
    for k in range(n - 3, -1, -1):
        depth[k] = depth[by_made[k]] + 1
    return [depth[k] for k in by_leaf]


# Many codes stand one after the other in flat arrays by symbol; code k begins at base[k], and base ends with their length.


def all_lengths(counts: np.ndarray, base: np.ndarray, limit: int) -> np.ndarray:
    """``code_lengths`` of many codes."""
    out = np.zeros(len(counts), np.uint8)
    used = counts.nonzero()[0]
    owner = base.searchsorted(used, "right") - 1
    edges = owner.searchsorted(np.arange(len(base))).tolist()
    used = used[(owner << 34 | counts[used]).argsort(kind="stable")]
    weights, depths = counts[used].tolist(), []
    for k, (a, z) in enumerate(zip(edges, edges[1:])):
        got = _depths(weights[a:z])
        if got and got[0] > limit:
            got = code_lengths(counts[base[k]: base[k + 1]], limit)[used[a:z] - base[k]].tolist()
        depths += got
    out[used] = depths
    return out


def all_canonical(lengths: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by symbol, with their first bit lowest, as they stand in the stream, and the bits they take: none for a single symbol."""
    codes, bits = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = lengths.nonzero()[0]
    owner = base.searchsorted(used, "right") - 1
    several = (np.bincount(owner, minlength=len(base)) > 1)[owner]
    used, owner = used[several], owner[several]
    n = lengths[used].astype(np.int64)
    order = (owner << 4 | n).argsort(kind="stable")
    used, n = used[order], n[order]
    # a code that is complete takes all of its code space, so shares before it add up to none of the next one's
    share = 1 << (15 - n)
    codes[used] = _turned()[((share.cumsum() - share) & 0x7FFF) >> (15 - n)] >> (16 - n)
    bits[used] = n
    return codes, bits


# ---------------------------------------------------------------- decoding


class Bits:
    """A stream read from the lowest bit of each byte up."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        i = self.at >> 3
        got = int.from_bytes(self.data[i: i + 8], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        return got

    def symbol(self, code: tuple[np.ndarray, int]) -> int:
        table, bits = code
        i = self.at >> 3
        got = int(table[int.from_bytes(self.data[i: i + 8], "little") >> (self.at & 7) & (1 << bits) - 1])
        self.at += got & 15
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return got >> 4


def read_code(b: Bits, size: int) -> bytes:
    """Lengths by symbol of one prefix code."""
    lengths = bytearray(size)
    if b.read(1):
        n = b.read(1) + 1
        first = b.read(8 if b.read(1) else 1)
        for s in (first, b.read(8)) if n == 2 else (first,):
            if s >= size:
                raise ValueError("a symbol is out of range")
            lengths[s] = 1
        return bytes(lengths)
    own, shown = bytearray(19), LENGTH_ORDER[: 4 + b.read(4)]
    three = b.read(3 * len(shown))
    for k in shown:
        own[k] = three & 7
        three >>= 3
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    if most > size:
        raise ValueError("a prefix code has too many lengths")
    table, bits = _small_lookup(bytes(own))
    mask, data = (1 << bits) - 1, b.data
    at, i, before, at0 = b.at, 0, 8, 0
    word = 0
    at0 = -64
    while i < size and most:
        most -= 1
        if at - at0 > 32:
            at0 = at & ~7
            word = int.from_bytes(data[at0 >> 3: (at0 >> 3) + 8], "little")
        got = table[word >> (at - at0) & mask]
        at += got & 15
        s = got >> 4
        if s < 16:
            lengths[i] = s
            i += 1
            before = s or before
            continue
        extra, base = ((2, 3), (3, 3), (7, 11))[s - 16]
        n = base + (word >> (at - at0) & (1 << extra) - 1)
        at += extra
        if i + n > size:
            raise ValueError("a prefix code has too many lengths")
        if s == 16:
            lengths[i: i + n] = bytes([before]) * n
        i += n
    if at > b.end:
        raise ValueError("the stream ends early")
    b.at = at
    return bytes(lengths)


def read_group(b: Bits, sizes: tuple) -> list[tuple[np.ndarray, int]]:
    """The five codes of a group. Bits that repeat those of the code before, for as many symbols, repeat the code."""
    out, before = [], None
    for size in sizes:
        at = b.at
        if before and before[0] == size and at + before[1] <= b.end and _slice(b.data, at, before[1]) == before[2]:
            b.at += before[1]
            out.append(out[-1])
            continue
        out.append(lookup(read_code(b, size)))
        before = size, b.at - at, _slice(b.data, at, b.at - at)
    return out


def _slice(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at >> 3: (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1


def _distance(code: np.ndarray, width: int) -> np.ndarray:
    return np.where(code > 120, code - 120, _near(width)[np.minimum(code, 120)])


@lru_cache(maxsize=16)
def _near(width: int) -> np.ndarray:
    return np.array([0] + [max(1, x + y * width) for x, y in NEAR], np.int64)


def _plain(n: int, extra: int) -> int:
    """Length or distance of prefix symbol ``n`` with its extra bits."""
    return n + 1 if n < 4 else ((2 + (n & 1)) << ((n - 2) >> 1)) + extra + 1


def read_pixels(b: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """The pixels (ARGB words, row by row) of one entropy-coded image."""
    cache = b.read(4) if b.read(1) else 0
    if cache > 11:
        raise ValueError("the colour cache is too large")
    groups, which, tile = 1, None, 0
    if main and b.read(1):
        tile = b.read(3) + 2
        wide = (width + (1 << tile) - 1) >> tile
        high = (height + (1 << tile) - 1) >> tile
        which = (read_pixels(b, wide, high) >> 8 & 0xFFFF).astype(np.int64).reshape(high, wide)
        groups = int(which.max()) + 1
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    codes = [read_group(b, sizes) for _ in range(groups)]
    if groups == 1:
        return _read_one_group(b, width, width * height, cache, codes[0])
    return _read_groups(b, width, height, cache, codes, which, tile)


def _read_groups(b: Bits, width: int, height: int, cache: int, codes: list, which: np.ndarray, tile: int) -> np.ndarray:
    total, out, known = width * height, np.zeros(width * height, np.uint32), [0] * (1 << cache if cache else 0)
    i, cached = 0, 0
    while i < total:
        code = codes[which[i // width >> tile, i % width >> tile]]
        s = b.symbol(code[0])
        if s < 256:
            r, bl, a = (b.symbol(code[k]) for k in (1, 2, 3))
            out[i] = a << 24 | r << 16 | s << 8 | bl
            i += 1
        elif s < 280:
            n = s - 256
            n = _plain(n, b.read(max(0, (n - 2) >> 1)))
            d = b.symbol(code[4])
            d = _plain(d, b.read(max(0, (d - 2) >> 1)))
            d = int(_distance(np.array([d]), width)[0])
            _copy(out, i, n, d, total)
            i += n
        else:
            while cached < i:
                known[(CACHE_FACTOR * int(out[cached]) & 0xFFFFFFFF) >> (32 - cache)] = int(out[cached])
                cached += 1
            out[i] = known[s - 280]
            i += 1
    return out


def _copy(out: np.ndarray, i: int, n: int, d: int, total: int) -> None:
    if d > i or i + n > total:
        raise ValueError("a back-reference leaves the image")
    if d >= n:
        out[i: i + n] = out[i - d: i - d + n]
    else:
        out[i: i + n] = np.resize(out[i - d: i], n)


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    """The bits of 8,192 bytes by their place in a byte."""
    return np.tile(np.arange(8), 1 << 13)


def _follow(ends: np.ndarray, green: np.ndarray, b: Bits, lead: int, stop: int, need: int, distances: tuple) -> tuple[list, int, tuple]:
    """The chain of starts from where ``b`` stands, before bit ``stop`` and for ``need`` pixels, and where it goes on.

    ``ends`` by start, from byte ``lead`` on; ``_NEVER`` for references: these are returned by their number in the
    chain, with length and distance code.
    """
    follow, symbols, far_table, mask = memoryview(ends), memoryview(green), memoryview(distances[0]), distances[1]
    p, chain, where, sizes, far = b.at - 8 * lead, [], [], [], []
    add = chain.append
    while need > 0 and p < stop:
        had = len(chain)
        for _ in range(need):
            add(p)
            p = follow[p]
            if p >= stop:
                break
        need -= len(chain) - had
        if p == _NEVER:
            entry = symbols[chain[-1]]
            p = chain[-1] + (entry & 15)
            i = lead + (p >> 3)
            word = int.from_bytes(b.data[i: i + 8], "little") >> (p & 7)  # 43 bits are the most that a reference takes
            s = (entry >> 4) - 256
            extra = (s - 2) >> 1 if s > 3 else 0
            n = _plain(s, word & (1 << extra) - 1)
            word >>= extra
            entry = far_table[word & mask]
            word >>= entry & 15
            p += extra + (entry & 15)
            s = entry >> 4
            extra = (s - 2) >> 1 if s > 3 else 0
            p += extra
            where.append(len(chain) - 1)
            sizes.append(n)
            far.append(_plain(s, word & (1 << extra) - 1))
            need -= n - 1
    return chain, p, (where, sizes, far)


def _read_one_group(b: Bits, width: int, total: int, cache: int, code: list) -> np.ndarray:
    """All pixels where one code group holds: windows of bits, a chain of pixel starts, then one gather."""
    out = np.zeros(total, np.uint32)
    if all(bits == 0 for _, bits in code[:4]) and int(code[0][0][0]) >> 4 < 256:
        g, r, bl, a = (int(t[0]) >> 4 for t, _ in code[:4])
        out[:] = a << 24 | r << 16 | g << 8 | bl
        return out
    if code[0][1] == 0 and int(code[0][0][0]) >> 4 >= 280:
        return out  # every pixel is one place of the cache, which begins as zeros
    raw = np.frombuffer(b.data + bytes(24), np.uint8)
    tables = [(t, (1 << bits) - 1) for t, bits in code]
    most = int(code[0][0].max())
    done, spans = 0, []
    while done < total:
        if b.at >= b.end and any(bits for _, bits in code[:4]):
            raise ValueError("the stream ends early")
        lead = b.at >> 3
        size = min(WINDOW >> 3, len(b.data) - lead)
        part = raw[lead: lead + size + 24].astype(np.int64)
        three = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        word = three.repeat(8)
        n = len(word)
        word >>= np.resize(_places(), n) if n > len(_places()) else _places()[:n]  # the next 16 bits and more, by bit
        kinds: dict[int, tuple] = {}
        for t, mask in tables[:4]:  # the last is looked up where a reference stands
            if id(t) not in kinds:
                k = t.take(word & mask) if len(t) > 1 else None
                kinds[id(t)] = k, None if k is None else (k & 15).astype(np.int64)
        green, wide = kinds[id(tables[0][0])]
        if green is None:
            green = np.full(n, tables[0][0][0], np.uint16)
        ends = np.arange(n)
        if wide is not None:
            ends += wide
        for t, _ in tables[1:4]:
            if (wide := kinds[id(t)][1]) is not None:
                ends += wide.take(ends, mode="clip")
        if most >= 256 << 4:
            special = (green >= 256 << 4).nonzero()[0]
            entry = green[special]
            # a cache code ends by itself; what a reference takes is read when the chain comes to one
            ends[special] = np.where(entry < 280 << 4, _NEVER, special + (entry & 15))
        chain, p, held = _follow(ends, green, b, lead, 8 * size, total - done, tables[4])
        at = np.array(chain, np.int64)
        b.at = 8 * lead + p
        entry = green[at]
        got = entry >> 4
        pixel = got.astype(np.uint32) << np.uint32(8)
        nxt = at + (entry & 15)
        for (t, mask), shift in zip(tables[1:4], (16, 0, 24)):
            k = kinds[id(t)][0]
            if k is None:
                pixel |= np.uint32((int(t[0]) >> 4) << shift)
                continue
            v = k.take(nxt, mode="clip")
            pixel |= (v >> 4).astype(np.uint32) << np.uint32(shift)
            nxt += v & 15
        rest = (got >= 256).nonzero()[0]
        if len(rest):
            where, size_of, far = held
            length = np.ones(len(at), np.int64)
            length[where] = size_of
            begin = done + length.cumsum() - length
            plain = got < 256
            out[begin[plain]] = pixel[plain]
            reach = 279 - got.astype(np.int64)
            reach[where] = _distance(np.array(far, np.int64), width)
            spans.append((begin[rest], length[rest], reach[rest]))
            done += int(length.sum())
        else:
            out[done: done + len(at)] = pixel
            done += len(at)
        if not len(at):
            raise ValueError("the stream ends early")
    if b.at > b.end:
        raise ValueError("the stream ends early")
    if not spans:
        return out
    begin, size_of, far = map(np.concatenate, zip(*spans))
    if (far <= 0).any():
        return _resolve(out, begin, size_of, far, cache, total)
    for i, n, d in zip(begin.tolist(), size_of.tolist(), far.tolist()):
        _copy(out, i, n, d, total)
    return out


def _slots(pixels: np.ndarray, cache: int | np.ndarray) -> np.ndarray:
    """The place of each pixel in a colour cache of ``2 ** cache`` places."""
    return ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.asarray(32 - cache).astype(np.uint64)).astype(np.int16)


def _before(slots: np.ndarray, of: np.ndarray, images: int) -> np.ndarray:
    """The last pixel before each one in the same place of its image's cache, -1 if there is none."""
    order = _by_image(slots, of, images)
    out = np.full(len(slots), -1, np.int64)
    same = slots[order[1:]] == slots[order[:-1]]
    if images > 1:
        same &= of[order[1:]] == of[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _resolve(out: np.ndarray, begin: np.ndarray, size: np.ndarray, far: np.ndarray, cache: int, total: int) -> np.ndarray:
    """Fill in copies (``far`` above 0) and cache codes (minus the place, less 1) where literals stand.

    Every pixel points to the one it takes its value from. A copy's place in the cache is that of the literal
    or cache code it leads back to, so all places are known before any value is, and a cache code points to
    the last pixel before it in its place. Pointers are followed by doubling.
    """
    copy = far > 0
    if (begin[copy] < far[copy]).any() or len(begin) and int((begin + size).max()) > total:
        raise ValueError("a back-reference leaves the image")
    points, n = np.arange(total), size[copy]
    at = np.repeat(begin[copy] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    points[at] -= np.repeat(far[copy], n)
    root = _ends(points)
    slots, hit, place = _slots(out, cache), begin[~copy], -far[~copy] - 1
    literal = root == np.arange(total)
    literal[hit] = False
    first = np.full(1 << cache, total)
    np.minimum.at(first, slots[literal], np.flatnonzero(literal))
    # what no literal has filled is the zero the cache starts with, and that belongs to the first place
    slots[hit] = np.where(first[place] > hit, 0, place)
    hit = hit[first[place] < hit]
    # one more place in front of all holds a zero
    points = np.concatenate([[0], root + 1])
    points[hit + 1] = _before(slots[root], root, 1)[hit] + 1
    return np.concatenate([np.zeros(1, np.uint32), out])[_ends(points)[1:]]


def _ends(points: np.ndarray) -> np.ndarray:
    while True:
        further = points[points]
        if np.array_equal(further, points):
            return points
        points = further


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as rows x columns x (R, G, B, A)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + struct.unpack("<I", data[4:8])[0]
    while at + 8 <= min(end, len(data)):
        kind, size = data[at: at + 4], struct.unpack("<I", data[at + 4: at + 8])[0]
        if kind == b"VP8L":
            return decode_stream(data[at + 8: at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode_stream(data: bytes) -> np.ndarray:
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height, _, version = b.read(14) + 1, b.read(14) + 1, b.read(1), b.read(3)
    if version:
        raise ValueError("an unknown version")
    todo, seen, wide = [], set(), width
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICT, CROSS):
            tile = b.read(3) + 2
            side = lambda n: (n + (1 << tile) - 1) >> tile  # noqa: E731,B023
            todo.append((kind, wide, tile, read_pixels(b, side(wide), side(height)).reshape(side(height), side(wide))))
        elif kind == PALETTE:
            n = b.read(8) + 1
            colours = _bytes(read_pixels(b, n, 1)).astype(np.int64).cumsum(axis=0).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, wide, pack, _words(colours)))
            wide = (wide + (1 << pack) - 1) >> pack
        else:
            todo.append((kind, wide, 0, None))
    image = read_pixels(b, wide, height, True).reshape(height, wide)
    for kind, wide, n, extra in reversed(todo):
        image = (unpredict, uncross, ungreen, unpalette)[kind](image, wide, n, extra)
    return _bytes(image.ravel() << np.uint32(8) | image.ravel() >> np.uint32(24)).reshape(height, width, 4)


def _bytes(words: np.ndarray) -> np.ndarray:
    """A, R, G, B of ARGB words."""
    return np.ascontiguousarray(words, ">u4").view(np.uint8).reshape(-1, 4)


def _words(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, np.uint8).reshape(-1, 4).view(">u4").ravel().astype(np.uint32)


# ---------------------------------------------------------------- transforms, inverted


def ungreen(image: np.ndarray, *_) -> np.ndarray:
    g = image >> 8 & 0xFF
    return (image & 0xFF00FF00) | (image + g & 0xFF) | (((image >> 16) + g & 0xFF) << 16)


def unpalette(image: np.ndarray, width: int, pack: int, colours: np.ndarray) -> np.ndarray:
    bits = 8 >> pack
    x = np.arange(width)
    index = (image[:, x >> pack] >> 8 & 0xFF) >> ((x & (1 << pack) - 1) * bits).astype(np.uint32) & (1 << bits) - 1
    return np.concatenate([colours, np.zeros(256 - len(colours), np.uint32)])[index] if len(colours) < 256 else colours[index]


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5


def _spread(tiles: np.ndarray, tile: int, height: int, width: int) -> np.ndarray:
    return tiles[np.arange(height)[:, None] >> tile, np.arange(width)[None] >> tile]


def uncross(image: np.ndarray, width: int, tile: int, tiles: np.ndarray, sign: int = 1) -> np.ndarray:
    t = _spread(tiles, tile, *image.shape)
    red, green, blue = (image >> s & 0xFF for s in (16, 8, 0))
    new_red = red.astype(np.int32) + sign * _delta(t & 0xFF, green) & 0xFF
    by_red = new_red if sign > 0 else red
    new_blue = blue.astype(np.int32) + sign * (_delta(t >> 8 & 0xFF, green) + _delta(t >> 16 & 0xFF, by_red)) & 0xFF
    return (image & 0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    to_left = np.abs(top - corner).sum(-1, keepdims=True)
    to_top = np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


#: Predictions from left, top, top right and top left, as A, R, G, B on the last axis.
MODES = (
    lambda l, t, r, c: np.broadcast_to(np.array([255, 0, 0, 0]), t.shape),
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _average(_average(l, r), t),
    lambda l, t, r, c: _average(l, c),
    lambda l, t, r, c: _average(l, t),
    lambda l, t, r, c: _average(c, t),
    lambda l, t, r, c: _average(t, r),
    lambda l, t, r, c: _average(_average(l, c), _average(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: np.clip(l + t - c, 0, 255),
    lambda l, t, r, c: np.clip(_average(l, t) + ((_average(l, t) - c).astype(np.int32) / 2).astype(np.int32), 0, 255),
)
#: Modes that don't look to the left, so that a row is one step.
ACROSS = {0, 2, 3, 4, 8, 9}


def predictions(image: np.ndarray, tile: int, tiles: np.ndarray) -> np.ndarray:
    """Predictions for every pixel of a known image (rows x columns x ARGB), for the encoder."""
    h, w, _ = image.shape
    x = image.astype(np.int32)
    left, top, right, corner = (np.zeros_like(x) for _ in range(4))
    left[:, 1:] = x[:, :-1]
    top[1:], corner[1:, 1:] = x[:-1], x[:-1, :-1]
    right[1:, :-1], right[1:, -1] = x[:-1, 1:], x[1:, 0]
    mode = _spread(tiles, tile, h, w) >> 8 & 15
    mode[0], mode[:, 0], mode[0, 0] = 1, 2, 0
    out = np.zeros_like(x)
    for m in np.unique(mode):
        out[mode == m] = MODES[m if m < 14 else 0](left[mode == m], top[mode == m], right[mode == m], corner[mode == m])
    return out


def unpredict(image: np.ndarray, width: int, tile: int, tiles: np.ndarray) -> np.ndarray:
    h, w = image.shape
    x = _bytes(image.ravel()).reshape(h, w, 4).astype(np.int32)
    x[0, 0] = x[0, 0] + (255, 0, 0, 0) & 255
    x[0] = np.cumsum(x[0], axis=0) & 255
    modes = (tiles >> 8 & 15).astype(np.int64)
    for y in range(1, h):
        row, above = x[y], x[y - 1]
        row[0] = row[0] + above[0] & 255
        mode = modes[y >> tile][np.arange(w) >> tile]
        mode[mode > 13] = 0
        if w > 1 and set(np.unique(mode[1:]).tolist()) <= ACROSS:
            right = np.concatenate([above[1:], row[:1]])
            for m in np.unique(mode[1:]):
                i = 1 + np.flatnonzero(mode[1:] == m)
                row[i] = row[i] + MODES[m](None, above[i], right[i], above[i - 1]) & 255
        elif w > 1 and (mode[1:] == 1).all():
            x[y] = np.cumsum(row, axis=0) & 255
        else:
            for i in range(1, w):
                right = above[i + 1] if i + 1 < w else row[0]
                row[i] = row[i] + MODES[mode[i]](row[i - 1], above[i], right, above[i - 1]) & 255
    return _words(x.astype(np.uint8)).reshape(h, w)


# ---------------------------------------------------------------- encoding


def _pack(streams: list[np.ndarray]) -> list[bytes]:
    """Streams of values and sizes (two rows, at most 32 bits each) as bytes, one value after the other from the lowest bit up."""
    value, size = np.concatenate(streams, axis=1)
    n = np.array([x.shape[1] for x in streams])
    end = size.cumsum()
    upto = np.concatenate([[0], end])[np.concatenate([[0], n.cumsum()])]
    bits = upto[1:] - upto[:-1]
    words = (bits >> 5) + 2  # each stream begins with a word of its own
    first = words.cumsum() - words
    at = end - size + (32 * first - upto[:-1]).repeat(n)
    moved = value.astype(np.uint64) << (at & 31).astype(np.uint64)
    at >>= 5
    out = np.bincount(at, (moved & 0xFFFFFFFF).astype(np.float64), int(words.sum()))
    out[1:] += np.bincount(at, (moved >> np.uint64(32)).astype(np.float64), len(out))[:-1]
    data = out.astype(np.uint32).astype("<u4").tobytes()
    return [data[4 * a: 4 * a + (k + 7 >> 3)] for a, k in zip(first.tolist(), bits.tolist())]


def _pairs(*pairs: tuple[int, int]) -> np.ndarray:
    return np.array(pairs, np.int64).T


def _tokens(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``n`` equal lengths ``v`` as symbols of the length code: by symbol its run, itself and how many lengths it stands for.

    A run begins with its length itself, unless that is zero; what is left at the end, if less than 3, stands as it is.
    """
    lead = (v > 0).astype(np.int64)
    most = np.where(v > 0, 6, 138)
    full, tail = (n - lead) // most, (n - lead) % most
    count = lead + full + np.where(tail < 3, tail, 1)
    run = np.arange(len(v)).repeat(count)
    step = np.arange(len(run)) - (count.cumsum() - count)[run] - lead[run]
    repeats = np.where((step >= 0) & (step < full[run]), most[run], np.where((step == full[run]) & (tail[run] > 2), tail[run], 0))
    return run, np.where(repeats == 0, v[run], np.where(v[run] > 0, 16, np.where(repeats > 10, 18, 17))), repeats


#: Bits that follow each symbol of the length code.
_ROOM = np.array([0] * 16 + [2, 3, 7])


def _described(lengths: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """How each of many prefix codes is written: values and sizes."""
    used = lengths.nonzero()[0]
    owner = base.searchsorted(used, "right") - 1
    number, last = np.bincount(owner, minlength=len(base) - 1), np.zeros(len(base) - 1, np.int64)
    edges = (number.cumsum() - number).tolist()
    last[owner] = used - base[owner]
    short = (number <= 2) & (last < 256)
    out: list = [None] * len(number)
    for k in short.nonzero()[0].tolist():
        s = (used[edges[k]: edges[k] + int(number[k])] - base[k]).tolist() or [0]
        out[k] = _few(*s)
    which = (~short).nonzero()[0]
    m = len(which)
    if not m:
        return out
    size = last[which] + 1
    code = np.arange(m).repeat(size)
    v = lengths[np.arange(len(code)) + (base[which] - size.cumsum() + size)[code]].astype(np.int64)
    cut = np.concatenate([[0], ((v[1:] != v[:-1]) | (code[1:] != code[:-1])).nonzero()[0] + 1])
    run, symbol, repeats = _tokens(v[cut], np.diff(cut, append=len(v)))
    code = code[cut][run]
    n, own_base = np.bincount(code, minlength=m), 19 * np.arange(m + 1)
    own = all_lengths(np.bincount(19 * code + symbol, minlength=19 * m), own_base, 7)
    codes, bits = all_canonical(own, own_base)
    own = own.reshape(m, 19)[:, LENGTH_ORDER].astype(np.int64)
    shown = np.maximum(4, 19 - (own[:, ::-1] > 0).argmax(axis=1))
    wide = np.searchsorted(4 ** np.arange(1, 9), n - 2, "right")
    some = n > 1
    head = np.zeros((m, 2, 24), np.int64)
    head[:, 1, 0], head[:, 0, 1], head[:, 1, 1] = 1, shown - 4, 4
    head[:, 0, 2:21], head[:, 1, 2:21] = own, 3 * (np.arange(19) < shown[:, None])
    head[:, 0, 21], head[:, 1, 21], head[:, 0, 22], head[:, 1, 22] = some, 1, wide * some, 3 * some
    head[:, 0, 23], head[:, 1, 23] = (n - 2) * some, (2 + 2 * wide) * some
    items = np.zeros((2, len(code), 2), np.int64)
    items[0, :, 0], items[1, :, 0] = codes[19 * code + symbol], bits[19 * code + symbol]
    items[0, :, 1], items[1, :, 1] = np.where(repeats > 0, repeats - np.where(repeats > 10, 11, 3), 0), _ROOM[symbol]
    items = items.reshape(2, -1)
    ends = (2 * n.cumsum()).tolist()
    for k, h, a, z in zip(which.tolist(), head, [0, *ends], ends):
        out[k] = np.concatenate([h, items[:, a:z]], axis=1)
    return out


@lru_cache(maxsize=4096)
def _few(*symbols: int) -> np.ndarray:
    """How a prefix code of one or two symbols below 256 is written."""
    return _pairs((1, 1), (len(symbols) - 1, 1), (1, 1), *[(x, 8) for x in symbols])


#: Pixels of images that are written together; a larger image is written alone.
TOGETHER = 1 << 17
#: Bits of the longest code that is written; short tables are quick to read, and longer codes save next to nothing.
LONGEST = 12


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes from 1 up."""
    if not len(value):
        return (np.zeros(0, np.int64),) * 3
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    second = v >> np.maximum(high - 1, 0) & 1
    small = v < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + second), np.where(small, 0, v & (1 << extra) - 1), extra


def matches(pixels: np.ndarray, of: np.ndarray, looked: np.ndarray, shortest: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (start, length, distance): stretches that repeat the last place with the same three pixels.

    ``pixels`` are those of many images, one after the other, ``of`` their images; ``looked`` says which images may
    have references.
    """
    none = (np.zeros(0, np.int64),) * 3
    at = ((of[2:] == of[:-2]) & looked[of[2:]]).nonzero()[0]
    if not len(at):
        return none
    p = pixels.astype(np.uint64)
    key = ((p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:])[at]
    # by sixteen bits of it, which sort quickly; the few keys that share them hide a match from one another
    order = _by_image((key >> np.uint64(48)).astype(np.uint16), of[at], len(looked))
    key, at = key[order], at[order]
    same = ((key[1:] == key[:-1]) & (of[at[1:]] == of[at[:-1]])).nonzero()[0]
    back = np.zeros(len(pixels), np.int64)
    back[at[same + 1]] = at[same + 1] - at[same]
    # equal keys of different pixels
    k = back.nonzero()[0]
    odd = any(not np.array_equal(pixels[k + step], pixels[k - back[k] + step]) for step in (0, 1, 2))
    cut = (back[1:] != back[:-1]).nonzero()[0] + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(back)]])
    hit = (back[start] > 0) & (end - start + 2 >= shortest)
    start, end = start[hit], end[hit]
    out, last = [], 0
    for i, z, d in zip(start.tolist(), (end + 2).tolist(), back[start].tolist()):
        i = max(i, last)
        while z - i >= shortest and d < 1 << 20:
            n = min(z - i, 4096)
            if odd and not np.array_equal(pixels[i: i + n], pixels[i - d: i - d + n]):
                break
            out.append((i, n, d))
            i = last = i + n
    return tuple(np.array(out, np.int64).T) if out else none


def _by_image(key: np.ndarray, of: np.ndarray, images: int) -> np.ndarray:
    """Stable order by image, then by a short key."""
    order = key.argsort(kind="stable")
    return order if images == 1 else order[of[order].astype(np.min_scalar_type(images)).argsort(kind="stable")]


def _coded(images: list[tuple]) -> list[np.ndarray]:
    """The prefix codes and pixels of entropy-coded images, as values and sizes.

    ``images``: (pixels, bits of the cache, whether repeats are sought, code groups of the pixels or None).
    """
    m, n = len(images), np.array([len(x[0]) for x in images])
    cache, looked = np.array([x[1] for x in images]), np.array([x[2] for x in images]) & (n >= 8)
    pixels, of, first = np.concatenate([x[0] for x in images]), np.arange(m).repeat(n), n.cumsum() - n
    number = np.array([1 if x[3] is None else int(x[3].max()) + 1 for x in images])
    group = (number.cumsum() - number)[of]
    for (_, _, _, own), a in zip(images, first.tolist()):
        if own is not None:
            group[a: a + len(own)] += own
    start, size, far = matches(pixels, of, looked)
    if len(start):
        open_at = np.bincount(start, minlength=len(pixels) + 1) - np.bincount(start + size, minlength=len(pixels) + 1)
        plain = (open_at[:-1].cumsum() == 0).nonzero()[0]
    else:
        plain = np.arange(len(pixels))
    argb = _bytes(pixels[plain])
    green, group_p, group_r = argb[:, 2].astype(np.int64), group[plain], group[start]
    hit = np.zeros(len(plain), bool)
    if cache.any():
        k = cache[of].nonzero()[0]
        v, slots, known = pixels[k], np.zeros(len(pixels), np.int16), np.zeros(len(pixels), bool)
        slots[k] = _slots(v, cache[of[k]])
        before = _before(slots[k], of[k], m)
        known[k] = np.where(before < 0, 0, v[before]) == v
        hit = known[plain]
        green[hit] = 280 + slots[plain[hit]]
    ls, lv, ln = _prefix(size)
    ds, dv, dn = _prefix(far + 120)
    # five codes a group: green, red, blue, alpha, distances; red, blue and alpha share one but in small images, where
    # each channel has its own: constant ones vanish
    image = np.arange(m).repeat(number)
    room = np.full((len(image), 5), 256)
    room[:, 0], room[:, 4] = 280 + np.where(cache > 0, 1 << cache, 0)[image], 40
    base = np.concatenate([[0], room.ravel().cumsum()])
    use = np.arange(len(base) - 1).reshape(-1, 5)
    use[n[image] > 64, 2:4] = use[n[image] > 64, 1:2]
    at_g, at_r, at_b, at_a, at_d = base[use].T
    g, r, b, a = at_g[group_p] + green, at_r[group_p] + argb[:, 1], at_b[group_p] + argb[:, 3], at_a[group_p] + argb[:, 0]
    s, d = at_g[group_r] + 256 + ls, at_d[group_r] + ds
    counts = np.bincount(np.concatenate([g, s, d, *((r, b, a) if not hit.any() else (x[~hit] for x in (r, b, a)))]), minlength=int(base[-1]))
    lengths = all_lengths(counts, base, LONGEST)
    codes, bits = all_canonical(lengths, base)
    heads = _described(lengths, base)
    # two values a pixel or reference: green and red, or a length, then blue and alpha, or a distance
    n1, n2 = bits[g], bits[b]
    v1, v2 = codes[g] | codes[r] << n1, codes[b] | codes[a] << n2
    n1, n2 = n1 + bits[r], n2 + bits[a]
    if hit.any():
        v1[hit], n1[hit], v2[hit], n2[hit] = codes[g[hit]], bits[g[hit]], 0, 0
    items = np.array([[v1, v2], [n1, n2]])
    if len(start):
        refs = np.array([[codes[s] | lv << bits[s], codes[d] | dv << bits[d]], [bits[s] + ln, bits[d] + dn]])
        where = np.concatenate([plain, start])
        order = where.argsort(kind="stable")
        plain, items = where[order], np.concatenate([items, refs], axis=2)[:, :, order]
    items = items.transpose(0, 2, 1).reshape(2, -1)
    edges = (2 * plain.searchsorted(np.concatenate([first, [len(pixels)]]))).tolist()
    sets = (number.cumsum() - number).tolist()
    use = use.tolist()
    return [np.concatenate([heads[k] for five in use[i: i + j] for k in five] + [items[:, a:z]], axis=1) for i, j, a, z in zip(sets, number.tolist(), edges, edges[1:])]


def _colours(pixels: np.ndarray) -> int:
    """How many different pixels there are."""
    x = np.sort(pixels)
    return 1 + int(np.count_nonzero(x[1:] != x[:-1]))


def encode(rgba: np.ndarray, transforms: tuple = (), tile: int = 4, cache: int = 0, repeats: bool = True, modes=None, cross=None, groups=None, palette: bool = True) -> bytes:
    """A lossless WebP file of rows x columns x (R, G, B, A).

    A palette is used, alone, where it makes the stream shorter for certain: at most 256 colours and no more
    than a quarter of the pixels. The other transforms are the caller's choice, applied in the order given;
    ``modes`` and ``cross`` give their tiles, ``groups`` (tile bits, tiles of group numbers) those of the code groups.
    """
    return encode_all([rgba], [dict(transforms=transforms, tile=tile, cache=cache, repeats=repeats, modes=modes, cross=cross, groups=groups, palette=palette)])[0]


def encode_all(images: list[np.ndarray], hows: list[dict]) -> list[bytes]:
    """The files that ``encode`` makes of many images, each with its own arguments; none depends on the others."""
    files = [_parts(image, **how) for image, how in zip(images, hows)]
    coded = iter(_coded([x for parts in files for x in parts if isinstance(x, tuple)]))
    return [_file(x) for x in _pack([np.concatenate([next(coded) if isinstance(x, tuple) else x for x in parts], axis=1) for parts in files])]


def _file(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _parts(rgba: np.ndarray, transforms: tuple = (), tile: int = 4, cache: int = 0, repeats: bool = True, modes=None, cross=None, groups=None, palette: bool = True) -> list:
    """What a file's stream consists of: values with their sizes, and in between entropy-coded images as ``_coded`` takes them."""
    height, width, _ = rgba.shape
    if not (0 < width <= SIDE and 0 < height <= SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    image = np.ascontiguousarray(rgba, np.uint8).reshape(-1, 4).view(">u4").ravel().astype(np.uint32)
    image = (image >> np.uint32(8) | image << np.uint32(24)).reshape(height, width)
    side = lambda n: (n + (1 << tile) - 1) >> tile
    if palette and _colours(image.ravel()[:2048]) <= 256:
        if 4 * _colours(image.ravel()[: 1024 + image.size // 4]) <= image.size:
            colours = np.unique(image)
            if len(colours) <= 256 and 4 * len(colours) <= image.size:
                transforms, cache = (PALETTE,), 0
    wide, head, out = width, [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)], []

    def small(pixels: np.ndarray) -> None:
        """A transform's own image: it has no cache and no references."""
        nonlocal head
        out.extend([_pairs(*head, (0, 1)), (pixels, 0, False, None)])
        head = []

    for kind in transforms:
        head += [(1, 1), (kind, 2)]
        if kind == PALETTE:
            colours, index = np.unique(image, return_inverse=True)
            n = len(colours)
            steps = np.diff(_bytes(colours).astype(np.int64), axis=0, prepend=0).astype(np.uint8)
            head.append((n - 1, 8))
            small(_words(steps))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            to = (wide + (1 << pack) - 1) >> pack
            padded = np.zeros((height, to << pack), np.int64)
            padded[:, :wide] = index.reshape(height, wide)
            shifts = (np.arange(1 << pack) * (8 >> pack))
            image = ((padded.reshape(height, to, -1) << shifts).sum(-1) << 8 | ALPHA).astype(np.uint32)
            wide = to
        elif kind == GREEN:
            g = image >> 8 & 0xFF
            image = (image & 0xFF00FF00) | (image - g & 0xFF) | (((image >> 16) - g & 0xFF) << 16)
        else:
            head.append((tile - 2, 3))
            shape = side(height), side(wide)
            given = modes if kind == PREDICT else cross
            tiles = np.full(shape, ALPHA | (11 << 8 if kind == PREDICT else 0), np.uint32) if given is None else given.astype(np.uint32).reshape(shape)
            small(tiles.ravel())
            if kind == PREDICT:
                x = _bytes(image.ravel()).reshape(height, wide, 4)
                image = _words((x - predictions(x, tile, tiles)).astype(np.uint8)).reshape(height, wide)
            else:
                image = uncross(image, wide, tile, tiles, -1)
    head += [(0, 1), *([(1, 1), (cache, 4)] if cache else [(0, 1)]), (1 if groups else 0, 1)]
    own = None
    if groups:
        side_of, numbers = groups
        i = np.arange(image.size)
        own = numbers[i // wide >> side_of, i % wide >> side_of].astype(np.int64)
        out.extend([_pairs(*head, (side_of - 2, 3), (0, 1)), (numbers.ravel().astype(np.uint32) << 8 | ALPHA, 0, True, None)])
        head = []
    if head:
        out.append(_pairs(*head))
    return [*out, (image.ravel(), cache, repeats, own)]


# ---------------------------------------------------------------- what a stored image uses

#: Pixels of an image that the estimate looks at; what a transform or a cache must save over the whole image: bits
#: that its own description takes, and a share of all bits.
LOOKED, FIXED, WORTH = 512, 400, 1 / 20
#: Bits that a pixel out of the cache takes, by the estimate, and bits for describing a place that is used.
PLACE, DESCRIBED = 9.0, 4.0


@lru_cache(maxsize=1)
def _count_bits() -> np.ndarray:
    n = np.arange(4 * LOOKED + 1)
    return n * np.log2(np.maximum(n, 1))


def _costs(of: np.ndarray, argb: np.ndarray, images: int) -> np.ndarray:
    """Bits of an ideal code for the pixels of each image ``of``: green by itself, the other three samples together."""
    at, bits = of * 256, _count_bits()
    green, *rest = (np.bincount(at + argb[:, k], minlength=images * 256) for k in (2, 0, 1, 3))
    n = np.bincount(of, minlength=images)
    held = lambda counts: bits[counts].reshape(images, 256).sum(axis=1)
    return bits[n] - held(green) + bits[3 * n] - held(rest[0] + rest[1] + rest[2])


def _cache_gains(of: np.ndarray, argb: np.ndarray, cache: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Bits that caches save, given the bits of a pixel: for each whose place still holds it, less what the places take.

    Pixels that the one before repeats count for nothing, as runs of them are references anyway.
    """
    v = _words(argb)
    place = ((v.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> (32 - cache[of]).astype(np.uint64)).astype(np.int64)
    key = of << 11 | place
    order = np.argsort(key, kind="stable")
    k, w = key[order], v[order]
    again = (k[1:] == k[:-1]) & (w[1:] == w[:-1]) & (order[1:] - order[:-1] > 1)
    hit = k[1:][again]
    hits = np.bincount(hit >> 11, minlength=len(cache))
    first = np.ones(len(hit), bool)
    first[1:] = hit[1:] != hit[:-1]
    return hits * (each - PLACE) - np.bincount(hit[first] >> 11, minlength=len(cache)) * DESCRIBED


def choose_all(images: list[np.ndarray]) -> list[dict]:
    """Transforms and cache for images, from their pixels alone: what an estimate over a stretch of each finds shortest.

    One rule for images of every size, estimated for many at once: a transform or a cache is used if it saves more
    than ``FIXED`` bits and a ``WORTH`` of all over the whole image, by the estimate. A cache has more places the
    more pixels there are; a predictor leaves too few equal pixels for one. A choice doesn't depend on the other images.
    """
    if not images:
        return []
    m, sizes, looks = len(images), np.array([i.shape[0] * i.shape[1] for i in images]), []
    for image, n in zip(images, sizes.tolist()):
        at = max(0, (n - LOOKED) // 2) // image.shape[1] * image.shape[1]
        looks.append(image.reshape(-1, 4)[at: at + LOOKED])
    n = np.array([len(x) for x in looks])
    of, x = np.repeat(np.arange(m), n), np.ascontiguousarray(np.concatenate(looks)[:, [3, 0, 1, 2]])
    scale, width = sizes / n, np.array([i.shape[1] for i in images])
    plain = _costs(of, x, m)
    least = np.maximum(FIXED / scale, plain * WORTH)
    cache = np.minimum(11, np.maximum(1, np.ceil(np.log2(sizes + 1)).astype(np.int64) - 2))
    held = _cache_gains(of, x, cache, plain / n)
    cache, held = np.where(held > least, cache, 0), np.where(held > least, held, 0.0)
    green = x.copy()
    green[:, 1] -= x[:, 2]
    green[:, 3] -= x[:, 2]
    costs = [_costs(of, green, m) - held]
    for back in (np.ones(m, np.int64), width):
        left = np.full(m, np.inf)
        for b in np.unique(back):
            if len(x) > b:
                same = (of[b:] == of[:-b]) & (back[of[b:]] == b)
                some = n[back == b] - b
                got = _costs(of[b:][same], (x[b:] - x[:-b])[same], m)[back == b]
                left[back == b] = np.where(some > 0, got * n[back == b] / np.maximum(some, 1), np.inf)
        costs.append(left)
    # factors in 32nds that take most of red and blue away given green; whole numbers, so exact in any order
    r, g, b = (np.ascontiguousarray(x[:, k]).view(np.int8).astype(np.int64) for k in (1, 2, 3))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    total = lambda v: np.add.reduceat(v, starts)
    spread = np.maximum(n * total(g * g) - total(g) ** 2, 1)
    to_red, to_blue = (np.clip(np.rint(32 * (n * total(g * v) - total(g) * total(v)) / spread), -128, 127).astype(np.int64) for v in (r, b))
    crossed = x.copy()
    crossed[:, 1] -= ((to_red[of] * g) >> 5).astype(np.uint8)
    crossed[:, 3] -= ((to_blue[of] * g) >> 5).astype(np.uint8)
    costs.append(np.where((to_red != 0) | (to_blue != 0), _costs(of, crossed, m) - held, np.inf))
    costs = np.stack(costs)
    best = costs.argmin(axis=0)
    pays = plain - held - costs.min(axis=0) > least
    out = []
    for i, image in enumerate(images):
        tiles = ((image.shape[0] + 63) >> 6, (image.shape[1] + 63) >> 6)
        if not pays[i]:
            out.append({"cache": int(cache[i])})
        elif best[i] == 0:
            out.append({"transforms": (GREEN,), "cache": int(cache[i])})
        elif best[i] < 3:
            out.append({"transforms": (PREDICT,), "tile": 6, "modes": np.full(tiles, ALPHA | int(best[i]) << 8, np.uint32)})
        else:
            tile = np.uint32(ALPHA | (int(to_blue[i]) & 255) << 8 | int(to_red[i]) & 255)
            out.append({"transforms": (CROSS,), "tile": 6, "cross": np.full(tiles, tile), "cache": int(cache[i])})
    return out


def choose(rgba: np.ndarray) -> dict:
    return choose_all([rgba])[0]


# ---------------------------------------------------------------- operator


def to_image(data: bytes) -> np.ndarray:
    """Payload bytes as an image of four samples a pixel, 16 columns while the format allows; zeros fill the last row."""
    pixels = -(-len(data) // 4)
    width = 16
    while -(-pixels // width) > SIDE:
        width *= 2
    height = max(1, -(-pixels // width))
    return np.frombuffer(data.ljust(width * height * 4, b"\0"), np.uint8).reshape(height, width, 4)


def padded(raw: bytes) -> bytes:
    """The payload of a text's bytes: zeros up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def stored_all(payloads: list[bytes]) -> list[bytes]:
    """The files that payloads are kept as; what each uses is estimated for all of them at once."""
    images = [to_image(data) for data in payloads]
    hows, upto, out = choose_all(images), np.cumsum([i.size // 4 for i in images]), []
    while len(out) < len(images):
        a = len(out)
        z = max(a + 1, int(upto.searchsorted((upto[a - 1] if a else 0) + TOGETHER, "right")))
        out += encode_all(images[a:z], hows[a:z])
    return out


def stored(data: bytes) -> bytes:
    """The file that a payload is kept as."""
    return stored_all([data])[0]


def feature(rgba: np.ndarray) -> str:
    """64 bits as hex: which of 64 equal stretches of the pixels are brighter than the whole image."""
    light = rgba.reshape(-1, 4).astype(np.int64) @ np.array([2, 5, 1, 8])
    edges = np.arange(65) * len(light) // 64
    total = np.concatenate([[0], np.cumsum(light)])
    part, size = total[edges[1:]] - total[edges[:-1]], np.diff(edges)
    bright = part * len(light) > total[-1] * size
    return np.packbits(bright).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 256):  # bounds what a worker holds
            part = texts.slice(at, 256).to_pylist()
            raw = [t.encode("utf-8", "surrogatepass") for t in part]
            sizes, part = pa.array(map(len, raw), pa.int64()), [padded(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, 256), sizes,
                 pa.array(map(len, part), pa.int64()), pa.array(stored_all(part), pa.binary())],
                ["doc_id", "n_bytes", "payload_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, media``: every whole text as a lossless WebP file. Null is empty."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return x.mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """``doc_id, width, height, pixels`` (RGBA bytes, row by row) of ``doc_id, media``; null where it can't be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0), batch.column(1)):
                try:
                    x = decode(data.as_py() or b"")
                    row = [[x.shape[1]], [x.shape[0]], [x.tobytes()]]
                except ValueError:
                    row = [[None], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.binary())], ["doc_id", "width", "height", "pixels"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, width int, height int, pixels binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _READ.split(", ")]
    for batch in batches:
        rows = []
        for media, size in zip(batch.column(3), batch.column(2).to_pylist()):
            media = media.as_py()
            image = decode(media)
            payload = image.tobytes()[:size]
            rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
        sha, crc, n, media_sha, mark = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(media_sha, pa.string()), pa.array(mark, pa.string())], names)


def stored_and_read(docs: DataFrame) -> DataFrame:
    """Store every whole text losslessly, read the stored bytes back and describe them.

    The payload is the UTF-8 text with zero bytes up to a positive multiple of 64 (null and empty: 64 zeros).
    The media go to the shared folder as Parquet before they are read. Equal texts give equal values. Empty
    tables give empty results; extra columns are ignored.
    """
    return saved(store(docs), "webp").mapInArrow(_read, _READ)


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_and_read(table(spark, sf_dir, "documents"))
