"""Operator 2, token ids as binary: a static range asymmetric numeral system (rANS).

One table of frequencies is counted over all documents and shared by all blocks. The ids of the documents are
cut into blocks of ``BLOCK`` ids; a block is coded on its own by ``LANES`` interleaved states (id i belongs to
lane i % LANES) that write 32-bit words to one stream. Every ``STRIDE`` steps the block has a checkpoint (the
states, and the place in the stream), so a block can be decoded from any checkpoint on, several at a time; each
stretch between checkpoints has a CRC-32 of its words, and the block one of its ids. Many blocks are coded by
the same array operations.

Documents are tokenised once: the ids are written to the shared folder, counted there, and coded from there.

Result: one row of kind 'table' (payload: the frequencies, zlib-compressed) and rows of kind 'block' with
doc_ids, starts and lengths (which ids of which documents the block holds, in order), payload, checkpoints,
checksums (of each stretch) and checksum (of the ids). Defined results: a null text has a length of null, an
empty one of 0, in the block where its turn comes; null ids, ids of any type and repeated rows are carried like any other;
further columns are dropped; an empty table gives an empty frequency table and no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.bpe import PATTERN, VOCABULARY, shipped, vocabulary_of
from readloom.llm.common import in_batches, pack, reachable, slices, stored, table, unpack

BLOCK = 1 << 15
LANES = 32
STRIDE = 256
BITS = 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def schema(kind: str) -> str:
    """kind: the type of the documents' ids."""
    return (
        f"kind string, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>, n_tokens bigint, payload binary, "
        "checkpoints binary, checksums array<bigint>, checksum bigint"
    )


def _bits(freqs: np.ndarray) -> int:
    """The frequencies add up to a power of two."""
    return max(0, int(freqs.sum()).bit_length() - 1)



def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies, at least 1 for each id that occurs, with the sum 2**BITS, or a greater power of two if there are
    so many different ids that they would take more than half of it."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    here = counts > 0
    bits = max(BITS, int(here.sum()).bit_length())
    spare = (1 << bits) - int(here.sum())
    share = counts[here] * (spare / total)
    out[here] = 1 + np.floor(share).astype(np.int64)
    rest = (1 << bits) - int(out.sum())
    order = np.argsort(-counts, kind="stable")[: int(here.sum())]
    out[order] += rest // len(order)
    out[order[: rest % len(order)]] += 1
    return out


def encode_blocks(freqs: np.ndarray, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes, list[int], int]]:
    """(payload, checkpoints, checksum of each stretch, checksum of the ids) of each block, all at once."""
    if not blocks:
        return []
    bits = _bits(freqs)
    scale, most = np.uint64(bits), np.uint64(31 - bits + 32)
    f = np.append(freqs, 1 << bits).astype(np.uint64)  # the last one fills up: it changes no state
    c = np.append(np.cumsum(freqs) - freqs, 0).astype(np.uint64)
    steps = max(1, -(-max(map(len, blocks)) // LANES))
    ids = np.full((len(blocks), steps * LANES), len(freqs), np.int64)
    for row, block in zip(ids, blocks):
        row[: len(block)] = block
    ids = ids.reshape(len(blocks), steps, LANES)
    state = np.full((len(blocks), LANES), _LOW)
    wrote = np.zeros((steps, len(blocks), LANES), bool)
    words = np.zeros((steps, len(blocks), LANES), np.uint32)
    marks = {}
    for s in range(steps - 1, -1, -1):
        freq, base = f[ids[:, s]], c[ids[:, s]]
        full = state >= freq << most
        wrote[s], words[s] = full, state  # the low 32 bits
        state = np.where(full, state >> _WORD, state)
        div = state // freq
        state = (div << scale) + (state - div * freq) + base
        if s % STRIDE == 0:
            marks[s] = state
    wrote, words = wrote.transpose(1, 0, 2), words.transpose(1, 0, 2)
    per_step = wrote.sum(axis=2)
    out = []
    for b, block in enumerate(blocks):
        own = max(1, -(-len(block) // LANES))
        payload = words[b, :own][wrote[b, :own]].astype("<u4").tobytes()
        place = np.concatenate([[0], np.cumsum(per_step[b, :own])])
        at = range(0, own, STRIDE)
        checks = b"".join(int(place[s]).to_bytes(4, "little") + marks[s][b].astype("<u8").tobytes() for s in at)
        sums = [zlib.crc32(payload[4 * int(place[s]) : 4 * int(place[min(s + STRIDE, own)])]) for s in at]
        out.append((payload, checks, sums, zlib.crc32(block.astype("<u4").tobytes())))
    return out


def decode_stretches(freqs: np.ndarray, symbols: np.ndarray, payload: bytes, checkpoints: bytes, sums: list[int], n: int, some: range | list[int]) -> np.ndarray:
    """The ids from each of some checkpoints up to the next, all stretches at the same time, one after the other in
    the result. symbols: the id of each slot."""
    size, count = 4 + 8 * LANES, len(sums)
    marks = np.frombuffer(checkpoints, np.uint8).reshape(count, size)
    places = np.append(marks[:, :4].copy().view("<u4")[:, 0].astype(np.int64), len(payload) // 4)
    for k in some:
        if zlib.crc32(payload[4 * places[k] : 4 * places[k + 1]]) != sums[k]:
            raise ValueError(f"checksum of stretch {k} differs")
    some = np.asarray(some, np.int64)
    place, state = places[some], marks[some, 4:].copy().view("<u8").astype(np.uint64)
    words = np.append(np.frombuffer(payload, "<u4"), 0).astype(np.uint64)
    f, c, bits = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64), _bits(freqs)
    scale, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    todo = np.minimum(STRIDE * LANES, n - some * STRIDE * LANES)
    out = np.zeros((len(some), -(-int(todo.max(initial=0)) // LANES), LANES), np.int64)
    lane = np.arange(LANES)
    for step in range(out.shape[1]):
        on = step * LANES + lane < todo[:, None]
        slot = state & mask
        ids = symbols[slot.astype(np.int64)]
        out[:, step] = ids
        x = f[ids] * (state >> scale) + slot - c[ids]
        low = on & (x < _LOW)
        at = np.cumsum(low, axis=1)
        x = np.where(low, (x << _WORD) | words[np.minimum(place[:, None] + at - 1, len(words) - 1)], x)
        place += at[:, -1]
        state = np.where(on, x, state)
    if (place != places[some + 1]).any() or (state[some == count - 1] != _LOW).any():
        raise ValueError("a stretch doesn't end where it should")
    return np.concatenate([np.zeros(0, np.int64), *(row.ravel()[:m] for row, m in zip(out, todo.tolist()))])


def decode_block(freqs: np.ndarray, symbols: np.ndarray, payload: bytes, checkpoints: bytes, sums: list[int], n: int, checksum: int) -> np.ndarray:
    ids = decode_stretches(freqs, symbols, payload, checkpoints, sums, n, range(len(sums))) if n else np.zeros(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("the checksum of the ids differs")
    return ids


def slots(freqs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freqs)), freqs)


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_ids, lengths, ids): the ids of some thousand documents a row, packed; length null for a null text."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, shared = dict(df.dtypes)["doc_id"], shipped(df.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                ids, counts = v.encode(texts)
                lengths = pa.array(counts, pa.int64(), mask=np.asarray(texts.is_null()))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column("doc_id"), lengths)]
                yield pa.RecordBatch.from_pydict({"doc_ids": lists[0], "lengths": lists[1], "ids": pa.array([pack(ids)], pa.binary())})

    return in_batches(df, work, f"doc_ids array<{kind}>, lengths array<bigint>, ids binary")


def frequencies(coded: DataFrame) -> np.ndarray:
    """Counted over all ids; what comes to the driver is one number per id of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                own = np.bincount(unpack(raw))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(here), "n": pa.array(total[here])})

    rows = in_batches(coded.select("ids"), work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.id.max()) + 1 if len(rows) else 0, np.int64)
    counts[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return scaled(counts)


def _blocks(freqs: np.ndarray, held: list[tuple], flush: bool) -> tuple[list[dict], list[tuple]]:
    """Full blocks of (doc_id, start, length, ids) pieces; what is left over."""
    groups, group, size = [], [], 0
    for doc, start, length, ids in held:
        while size + len(ids) > BLOCK:
            k = BLOCK - size
            if k:
                group.append((doc, start, k, ids[:k]))
            groups.append(group)
            doc, start, length, ids, group, size = doc, start + k, length - k, ids[k:], [], 0
        group.append((doc, start, length, ids))
        size += len(ids)
    if flush and group:
        groups.append(group)
        group = []
    flat = [np.concatenate([np.zeros(0, np.int64), *(p[3] for p in g)]) for g in groups]
    rows = []
    for g, ids, (payload, marks, sums, crc) in zip(groups, flat, encode_blocks(freqs, flat)):
        rows.append({"kind": "block", "doc_ids": [p[0] for p in g], "starts": [p[1] for p in g], "lengths": [p[2] for p in g], "n_tokens": len(ids), "payload": payload, "checkpoints": marks, "checksums": sums, "checksum": crc})
    return rows, group


def _arrow(doc_ids: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("kind", pa.string()), ("doc_ids", pa.list_(doc_ids)), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
        ("payload", pa.binary()), ("checkpoints", pa.binary()), ("checksums", pa.list_(pa.int64())), ("checksum", pa.int64()),
    ])


def token_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    spark = reachable(df.sparkSession)
    coded = stored(tokens(df, id_col, text_col, path, pattern), "token-ids")
    freqs = frequencies(coded)
    shared = spark.sparkContext.broadcast(freqs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_ids").type.value_type
            for docs, lengths, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "ids"))):
                ids = unpack(raw)
                ends = np.cumsum([n or 0 for n in lengths])
                held += [(d, 0, n, ids[e - (n or 0) : e]) for d, n, e in zip(docs, lengths, ends.tolist())]
                rows, held = _blocks(shared.value, held, False)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(kind))
        rows, _ = _blocks(shared.value, held, True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow(kind))

    head = [("table", None, None, None, int((freqs > 0).sum()), zlib.compress(freqs.astype("<u4").tobytes()), None, None, zlib.crc32(freqs.astype("<u4").tobytes()))]
    kind = schema(dict(coded.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">"))
    return spark.createDataFrame(head, kind).union(in_batches(coded, work, kind))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, token_ids): every piece of every block, decoded and checked; token_ids null for a null text.
    Blocks are decoded by many tasks, and in each the stretches between checkpoints side by side."""
    row = blocks.where("kind = 'table'").first()
    freqs = np.frombuffer(zlib.decompress(bytes(row.payload)), "<u4").astype(np.int64)
    if zlib.crc32(freqs.astype("<u4").tobytes()) != row.checksum:
        raise ValueError("the checksum of the frequency table differs")
    shared = reachable(blocks.sparkSession).sparkContext.broadcast(freqs)
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = slots(shared.value)
        for batch in batches:
            ids_type = batch.schema.field("doc_ids").type.value_type
            for b in batch.to_pylist():
                ids = decode_block(shared.value, of, b["payload"], b["checkpoints"], b["checksums"], b["n_tokens"], b["checksum"])
                ends = np.cumsum([n or 0 for n in b["lengths"]])
                lists = [None if n is None else ids[e - n : e].tolist() for n, e in zip(b["lengths"], ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(b["doc_ids"], ids_type), "start": pa.array(b["starts"], pa.int64()), "token_ids": pa.array(lists, pa.list_(pa.int32()))})

    return in_batches(blocks.where("kind = 'block'"), work, f"doc_id {kind}, start bigint, token_ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(table(spark, sf_dir, "documents"))
