"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

Words, in lower case, are the maximal runs of letters, marks and numbers of all of Unicode; each character of the
scripts that are written without spaces (``ALONE``) is a word of its own; everything else separates. Texts are
read as UTF-8 straight from Arrow's buffers.

A range of bytes is hashed 8 bytes at a time, each step a multiplication and a shift of what is there so far, so
no sums or differences of positions cancel; long ranges are hashed by stretches, and then the hashes of those. A
seed that is drawn anew for each run keeps crawled text from being made to collide.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from readloom.llm.common import mix, utf8

#: Scripts without spaces between words.
ALONE = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_ALONE = "".join(rf"\p{{{s}}}" for s in ALONE)
#: One word; also for engines without differences of classes.
WORD = rf"[{_ALONE}]|(?:[^\P{{L}}{_ALONE}]|[^\P{{M}}{_ALONE}]|[^\P{{N}}{_ALONE}])+"
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Ranges of more bytes are hashed by stretches of so many.
STRETCH = 256
_CODES = 0x110000


def code_kinds(*patterns: str) -> np.ndarray:
    """For each code point the number of the first pattern that matches it, from 1, or 0."""
    every = "".join(map(chr, range(_CODES)))
    out = np.zeros(_CODES, np.uint8)
    for k in range(len(patterns), 0, -1):
        at = [m.span() for m in regex.finditer(f"(?:{patterns[k - 1]})+", every)]
        for a, b in at:
            out[a:b] = k
    return out


@lru_cache(maxsize=1)
def _word_kinds() -> np.ndarray:
    """1: part of a run, 2: a word alone."""
    return code_kinds(rf"[^\P{{L}}{_ALONE}]|[^\P{{M}}{_ALONE}]|[^\P{{N}}{_ALONE}]", f"[{_ALONE}]")


def byte_kinds(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the kind of the character that each byte belongs to, first bytes of the characters from U+0080 on). A byte
    out of place has the kind of U+0000."""
    low = np.full(256, kinds[0], kinds.dtype)
    low[:128] = kinds[:128]
    out = low[data]
    at = np.flatnonzero(data >= 0xC0)
    if at.size:
        lead, last = data[at].astype(np.int64), len(data) - 1
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.array([0, 0, 31, 15, 7])[size]
        for k in range(1, int(size.max())):
            some = size > k
            code[some] = (code[some] << 6) | (data[np.minimum(at[some] + k, last)] & 63)
        kind = kinds[np.minimum(code, _CODES - 1)]
        out[at] = kind
        for k in range(1, int(size.max())):
            some = (size > k) & (at + k <= last)
            out[at[some] + k] = kind[some]
    return out, at


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, little-endian, with zeros behind the end; one place more than bytes."""
    padded = np.zeros(len(data) + 9, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).astype(np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, eight: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each range of bytes. eight: what ``loads`` makes of the bytes, if it is there already."""
    starts, left = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    out = mix(left.astype(np.uint64) * _STEP[0] + np.uint64(seed & (1 << 64) - 1))
    if (long := np.flatnonzero(left > STRETCH)).size:
        parts = -(-left[long] // STRETCH)
        stops = np.cumsum(parts)
        k = np.arange(int(stops[-1])) - np.repeat(stops - parts, parts)
        a = np.repeat(starts[long], parts) + k * STRETCH
        each = byte_hashes(data, a, np.minimum(a + STRETCH, np.repeat(starts[long] + left[long], parts)), seed, eight)
        out[long] = mix(out[long] ^ byte_hashes(each.astype("<u8").view(np.uint8), 8 * (stops - parts), 8 * stops, seed))
        short = np.flatnonzero(left <= STRETCH)
    else:
        short = None
    eight = loads(data) if eight is None else eight
    at, left, h = (starts, left, out) if short is None else (starts[short], left[short], out[short])
    who = None
    result = h
    while len(at):
        h = (h ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _STEP[1]
        h ^= h >> np.uint64(29)
        h *= _STEP[4]
        h ^= h >> np.uint64(32)
        if who is None:
            result = h
            who = np.flatnonzero(left > 8)
            at, left, h = at[who] + 8, left[who] - 8, h[who]
        else:
            result[who] = h
            go = left > 8
            who, at, left, h = who[go], at[go] + 8, left[go] - 8, h[go]
    result = mix(result)
    if short is None:
        return result
    out[short] = result
    return out


def words(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words before each row's end with a leading 0, first byte of each word, bytes, offsets)."""
    data, offsets = utf8(pc.utf8_lower(texts))
    n = len(data)
    kind, far = byte_kinds(data, _word_kinds())
    inside = kind == 1
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, inside[1:]
    first, last = inside & (~before | cut[:-1]), inside & (~after | cut[1:])
    if far.size and (own := far[kind[far] == 2]).size:
        first[own] = True
        last[np.minimum(own + 2 + (data[own] >= 0xF0) - (data[own] < 0xE0), n - 1)] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return byte_hashes(data, starts, ends, seed), np.searchsorted(starts, offsets), starts, data, offsets


def ngrams(hashes: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's n-grams, with repeats. A row of fewer than n words, but one at least, has one
    gram: all its words."""
    counts = np.diff(ends)
    rows = np.repeat(np.arange(len(counts)), counts)
    m = len(hashes)
    if m == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    step = np.resize(_STEP, n)
    total = hashes * step[0]
    for i in range(1, n):
        total[: m - i] += hashes[i:] * (step[i] + np.uint64(2 * (i // len(_STEP))))
    place = np.arange(m) - ends[:-1][rows]
    full = place + n <= counts[rows]
    out_rows, out = rows[full], mix(total[full])
    if (short := np.flatnonzero((counts > 0) & (counts < n))).size:
        own = []
        for r in short.tolist():
            mine = hashes[ends[r] : ends[r + 1]]
            own.append(np.bitwise_xor.reduce(mix(mine * _STEP[1] + np.arange(1, len(mine) + 1, dtype=np.uint64) * _STEP[2])))
        out_rows = np.concatenate([out_rows, short])
        out = np.concatenate([out, mix(np.array(own, np.uint64) + np.uint64(7))])
    return out_rows, out


def sets(rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct grams, ordered by row and hash."""
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]
