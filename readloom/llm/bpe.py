"""Operator 8, BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. The key of a pair is left * size + right; the
lowest-rank pair of each word is found by binary search of its pairs in the sorted keys of all mergeable
pairs. Each round applies every word's lowest-rank pair at once; only pairs next to a merge are looked up
again, and words without a mergeable pair leave the array. A word of more than ``LONG`` bytes would make as many
rounds as it has merges; it goes alone, its pairs in a heap (n log n steps).

Each Python worker keeps the words it has met (at most about ``KEPT`` at a time, then it starts anew), so a word
is merged once and not once per occurrence. They are looked up by a hash with a seed of the worker's own, and
what is found counts only if its bytes are the word's: no hash decides what a word becomes.

Defined results: a null text gives null ids and a null decoding, an empty one no ids; ids of any type, nulls in
other columns and repeated rows pass through; further columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import in_batches, ranges, reachable, slices, table, utf8
from readloom.llm.grams import byte_hashes, byte_kinds, code_kinds, loads

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 512
KEPT = 400_000
KEPT_IDS = 16_000_000
_NONE = np.int64(1 << 62)
_LOW = np.int64((1 << 32) - 1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


_APOSTROPHE = 39
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of each code point."""
    return code_kinds(r"\p{L}", r"\p{N}", r"\s")


def pretokens(data: np.ndarray, offsets: np.ndarray, pattern: regex.Pattern | None = None) -> np.ndarray:
    """The first byte of each pre-token; they cover the texts without gaps. By the default pattern with array
    operations; by another one row by row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    last = first[1:]
    first = first[:-1]
    if pattern is not None:
        starts = first.copy()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            sizes = [len(w.encode()) for w in pattern.findall(data[a:b].tobytes().decode())]
            starts[a + np.cumsum([0, *sizes[:-1]]) if sizes else []] = True
        return np.flatnonzero(starts)
    kind, _ = byte_kinds(data, _kinds())
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # a space goes with what follows it
    space = (kind == _SPACE) & ~last
    space[:-1] &= kind[1:] != _SPACE
    at = np.flatnonzero(space)  # the last byte of the last white space before something else
    one = data[at] < 0x80
    starts[at[one]] = True
    if not one.all():
        wide = at[~one]
        for _ in range(3):
            wide = np.where((data[wide] & 0xC0) == 0x80, np.maximum(wide - 1, 0), wide)
        starts[wide] = True
    at = at[data[at] == 32]
    starts[at + 1] = False
    # contractions
    at = np.flatnonzero((data == _APOSTROPHE) & starts & ~last)
    if len(at):
        stop = offsets[np.searchsorted(offsets, at, "right")]
        one, two = data[at + 1], data[np.minimum(at + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (at + 2 < stop) & ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108))
        starts[at[short | long] + 1] = False
        for some, size in ((short, 2), (long, 3)):
            after = at[some] + size
            starts[after[after < stop[some]]] = True
    return np.flatnonzero(starts)


class Known:
    """An open-addressing table from hashes to numbers, asked and filled by whole arrays."""

    def __init__(self, slots: int):
        self.keys, self.values, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.uint64(slots - 1)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that aren't there."""
        out = np.full(len(hashes), -1, np.int64)
        at, left = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        wanted = hashes
        while len(left):
            key = self.keys[at]
            hit = key == wanted
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (key != 0)
            left, wanted, at = left[on], wanted[on], (at[on] + 1) & int(self.mask)
        return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Hashes that are all different and not there yet."""
        at = (hashes & self.mask).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            own = free & (self.keys[at] == hashes)
            self.values[at[own]] = values[own]
            hashes, values, at = hashes[~own], values[~own], (at[~own] + 1) & int(self.mask)


def _grown(x: np.ndarray, to: int, fill: int = 0) -> np.ndarray:
    return x if len(x) >= to else np.concatenate([x, np.full(max(to, 2 * len(x)) - len(x), fill, x.dtype)])


class Vocabulary:
    """raw: the lines of the vocabulary's file, each a token in base64 and its rank."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.seed = int.from_bytes(os.urandom(8), "little")
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.single = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = []
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.size + b, rank))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [_NONE], np.int64)
        self.values = np.array([v for _, v in pairs] + [_NONE], np.int64)
        tokens = [b""] * self.size
        for whole, rank in self.ranks.items():
            tokens[rank] = whole
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.pattern = None if pattern == PATTERN else regex.compile(pattern)
        self._forget()

    # --- merging -----------------------------------------------------------------------------------------

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words, given one after the other with their lengths (1 at least), merged to the end."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words = np.arange(len(lengths))
        if (long := lengths > LONG).any():
            starts = np.cumsum(lengths) - lengths
            for w in np.flatnonzero(long):
                one = self._merge_long(symbols[starts[w] : starts[w] + lengths[w]])
                done.append((np.array([w]), np.array([len(one)]), one))
            symbols, words, lengths = symbols[np.repeat(~long, lengths)], words[~long], lengths[~long]
        lengths = lengths.copy()
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = self.lookup(symbols[:-1], symbols[1:]) if len(symbols) else 0
        rank[np.cumsum(lengths) - 1] = _NONE
        while len(words):
            starts = np.cumsum(lengths) - lengths
            place = np.arange(len(symbols))
            lowest = np.minimum.reduceat(np.where(rank == _NONE, _NONE, (rank << np.int64(32)) | place), starts)
            if (ended := lowest == _NONE).any():
                out = np.repeat(ended, lengths)
                done.append((words[ended], lengths[ended], symbols[out]))
                go = ~ended
                symbols, rank, words = symbols[~out], rank[~out], words[go]
                shift = (np.cumsum(np.where(ended, lengths, 0)))[go]
                lowest, lengths = lowest[go], lengths[go]
                if not len(words):
                    break
                at = (lowest & _LOW) - shift
            else:
                at = lowest & _LOW
            symbols[at] = lowest >> np.int64(32)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            lengths -= 1
            at = at - np.arange(len(at))
            starts = np.cumsum(lengths) - lengths
            more = at < starts + lengths - 1
            rank[at] = _NONE
            rank[at[more]] = self.lookup(symbols[at[more]], symbols[at[more] + 1])
            before = at[at > starts] - 1
            rank[before] = self.lookup(symbols[before], symbols[before + 1])
        if not done:
            return symbols, lengths
        order = np.concatenate([d[0] for d in done])
        sizes = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        back = np.argsort(order, kind="stable")
        return flat[ranges((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One word, its pairs in a heap by rank and place, its symbols in a linked list: n log n steps."""
        n = len(symbols)
        rank = np.append(self.lookup(symbols[:-1], symbols[1:]), _NONE)
        heap = np.sort((rank[rank != _NONE] << np.int64(32)) | np.flatnonzero(rank != _NONE)).tolist()
        rank, symbol, after, before = rank.tolist(), symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, size, none = self.pairs, self.size, int(_NONE)
        while heap:
            top = heapq.heappop(heap)
            at, low = top & 0xFFFFFFFF, top >> 32
            if rank[at] != low:
                continue
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone], rank[gone], after[at] = low, -1, none, then
            rank[at] = none
            if then < n:
                before[then] = at
                if (r := pairs.get(low * size + symbol[then], none)) != none:
                    rank[at] = r
                    heapq.heappush(heap, r << 32 | at)
            if (left := before[at]) >= 0:
                rank[left] = r = pairs.get(symbol[left] * size + low, none)
                if r != none:
                    heapq.heappush(heap, r << 32 | left)
        out = np.array(symbol, np.int64)
        return out[out >= 0]

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys[:-1].tolist(), self.values[:-1].tolist()))

    # --- words -------------------------------------------------------------------------------------------

    def _forget(self) -> None:
        """Keep only the vocabulary's own tokens, each a word of one symbol."""
        self.known, self.clashes = Known(1 << 20), {}
        self.entries = self.used = self.size
        self.start, self.count, self.flat = np.arange(self.size), np.ones(self.size, np.int64), np.arange(self.size, dtype=np.int32)
        #: The bytes of each word, 8 to a chunk, and how many they are; -1 for those that aren't looked up again.
        self.bytes, self.chunk, self.chunks, self.held = np.full(self.size, -1), np.zeros(self.size, np.int64), np.zeros(0, np.uint64), 0
        real = np.flatnonzero((self.token_size > 0) & (self.token_size <= LONG))
        starts, ends = self.token_start[real], self.token_start[real] + self.token_size[real]
        eight = loads(self.token_bytes)
        hashes = byte_hashes(self.token_bytes, starts, ends, self.seed, eight)
        self._name(real, hashes, eight, starts, self.token_size[real])

    def _name(self, entries: np.ndarray, hashes: np.ndarray, eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the bytes of entries. Of those with one hash the first goes to the table, the others aside."""
        parts = -(-lengths // 8)
        at = np.repeat(starts, parts) + 8 * ranges(np.zeros(len(parts), np.int64), parts)
        left = np.minimum(np.repeat(starts + lengths, parts) - at, 8)
        top = self.held + len(at)
        self.chunks = _grown(self.chunks, top)
        self.chunks[self.held : top] = eight[at] & _MASK[left]
        self.bytes[entries], self.chunk[entries] = lengths, self.held + np.cumsum(parts) - parts
        self.held = top
        first = np.zeros(len(entries), bool)
        first[np.unique(hashes, return_index=True)[1]] = True
        first &= self.known.get(hashes) < 0
        self.known.put(hashes[first], entries[first].astype(np.int32))
        for k in np.flatnonzero(~first).tolist():
            self.clashes[self._raw(eight, int(starts[k]), int(lengths[k]))] = int(entries[k])

    @staticmethod
    def _raw(eight: np.ndarray, start: int, length: int) -> bytes:
        return eight[start : start + length : 8].astype("<u8").tobytes()[:length]

    def _look(self, hashes: np.ndarray, eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1; an entry is taken only if all bytes agree."""
        at = self.known.get(hashes)
        who = np.flatnonzero(at >= 0)
        wrong = who[self.bytes[at[who]] != lengths[who]]
        k, here = 0, who
        while len(here):
            left = lengths[here] - 8 * k
            differ = self.chunks[np.minimum(self.chunk[at[here]] + k, self.held - 1)] != eight[starts[here] + 8 * k] & _MASK[np.minimum(left, 8)]
            if differ.any():
                wrong = np.concatenate([wrong, here[differ]])
            here = here[(left > 8) & ~differ] if k or differ.any() else here[left > 8]
            k += 1
        for i in np.unique(wrong).tolist():
            at[i] = self.clashes.get(self._raw(eight, int(starts[i]), int(lengths[i])), -1) if self.clashes else -1
        return at

    def _learn(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The new entries of words, given one after the other."""
        ids, sizes = self.merge(self.single[flat], lengths)
        n, more, top = self.entries, len(lengths), self.used + len(ids)
        self.start, self.count, self.flat = _grown(self.start, n + more), _grown(self.count, n + more), _grown(self.flat, top)
        self.bytes, self.chunk = _grown(self.bytes, n + more, -1), _grown(self.chunk, n + more)
        self.bytes[n : n + more] = -1
        self.start[n : n + more], self.count[n : n + more] = np.cumsum(sizes) - sizes + self.used, sizes
        self.flat[self.used : top] = ids
        self.entries, self.used = n + more, top
        return np.arange(n, n + more)

    def entries_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the entry of each pre-token, pre-tokens before each row's end with a leading 0). Words are looked up by
        hash and compared by their bytes; those not met before are merged first, all at once. Those of more than
        ``LONG`` bytes are merged each time and not looked up."""
        data, offsets = utf8(texts)
        starts = pretokens(data, offsets, self.pattern)
        lengths = np.diff(np.append(starts, len(data)))
        eight = loads(data)
        at, some = np.full(len(starts), -1), np.flatnonzero(lengths <= LONG)
        hashes = byte_hashes(data, starts[some], starts[some] + lengths[some], self.seed, eight)
        if self.entries - self.size > KEPT or self.used - self.size > KEPT_IDS:
            self._forget()
        at[some] = self._look(hashes, eight, starts[some], lengths[some])
        new = np.flatnonzero(at[some] < 0)
        while new.size:  # a second time only for different words with one hash
            unique, first = np.unique(hashes[new], return_index=True)
            word = some[new[first]]
            self._name(self._learn(data[ranges(starts[word], lengths[word])], lengths[word]), unique, eight, starts[word], lengths[word])
            at[some[new]] = self._look(hashes[new], eight, starts[some[new]], lengths[some[new]])
            new = new[at[some[new]] < 0]
        if (long := np.flatnonzero(lengths > LONG)).size:
            at[long] = self._learn(data[ranges(starts[long], lengths[long])], lengths[long])
        return at, np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        at, ends = self.entries_of(texts)
        counts = self.count[at]
        return self.flat[ranges(self.start[at], counts)], np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all sequences one after the other, and the bytes of each."""
        sizes = self.token_size[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.token_bytes[ranges(self.token_start[ids], sizes)], np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])


@lru_cache(maxsize=4)
def vocabulary_of(raw: bytes, pattern: str = PATTERN) -> Vocabulary:
    """One to a worker, with the words that it has met."""
    return Vocabulary(raw, pattern)


def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    return vocabulary_of(Path(path).read_bytes(), pattern)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's file (a MB or so), read by the driver and sent to the executors."""
    return reachable(spark).sparkContext.broadcast(Path(path).read_bytes())


def _offsets(counts: np.ndarray, null: np.ndarray, kind: str) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(kind))


def id_lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(counts, null, "int32"), pa.array(ids.astype(np.int32)), mask=pa.array(null))


def strings(data: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()), valid, int(null.sum()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN, decoded: bool = False) -> DataFrame:
    """doc_id, token_ids and, if asked for, what they decode to."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, shared = dict(df.dtypes)["doc_id"], shipped(df.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                null = np.asarray(texts.is_null())
                ids, counts = v.encode(texts)
                out = {"doc_id": part.column("doc_id"), "token_ids": id_lists(ids, counts, null)}
                if decoded:
                    out["decoded"] = strings(*v.decode(ids, counts), null)
                yield pa.RecordBatch.from_pydict(out)

    return in_batches(df, work, f"doc_id {kind}, token_ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """doc_id and the text of its token ids; bytes that are no UTF-8 become U+FFFD, an id that the vocabulary
    lacks, or a null one, raises."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind, shared = dict(df.dtypes)["doc_id"], shipped(df.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            null = np.asarray(lists.is_null())
            counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            values = lists.flatten()
            ids = np.asarray(values).astype(np.int64)
            if values.null_count or len(ids) and (ids.min() < 0 or ids.max() >= v.size or not v.token_size[ids].all()):
                raise ValueError("an id that the vocabulary lacks")
            data, sizes = v.decode(ids, counts)
            ends = np.cumsum(sizes)
            raw = data.tobytes()
            texts = [None if gone else raw[e - s : e].decode(errors="replace") for s, e, gone in zip(sizes.tolist(), ends.tolist(), null.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return in_batches(df, work, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), decoded=True)
