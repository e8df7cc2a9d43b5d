"""Operator 5, language ID with language-bitmask n-gram filters.

Bit-sliced Bloom filters: one table of slots, each a mask with a bit for each language. An n-gram of a
language sets the language's bit in ``HASHES`` slots; the AND of an n-gram's slots is the set of all languages
that contain it, for one look-up for every 64 of them, whatever their number: beyond 64 there are several such
tables, each of at most 8 MB. Over a document the bits are counted by
language. A filter with a share f of its bits set also answers yes to a share f**HASHES of the n-grams it
never saw, so of n n-grams h hits stand for (h - n * fp) / (1 - fp) true ones. The language with most decides.

The filters are fitted on labelled documents: of each language about ``PER_LANGUAGE`` (the bound), chosen by
a hash of id and text; n-grams that occur in ``MIN_SHARE_OF_DOCS`` of them (two documents at least) go in.
64 languages at a time are fitted, so that the driver holds the documents of no more. Everything else covers all documents and whole texts.

``keep`` is false for documents without a letter, and for those with ``MIN_GRAMS`` n-grams or more of which
less than ``MIN_SHARE`` belong to the language that decides; shorter ones say too little to reject them.
Defined results: a null text is like an empty one: no language, score 0, not kept; a text's score doesn't hang on
the texts next to it; a tie goes to the language that is first by name; ids may be of any type; further columns,
whatever their names, are dropped by ``identify`` and returned untouched by ``filter_language``; languages with a null label are not learnt; without any labelled document nothing is
known and only documents too short to judge are kept; ids, nulls in other columns and repeated rows pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import in_batches, mix, reachable, slices, table

N = 4
SLOTS = 1 << 20
HASHES = 3
PER_LANGUAGE = 400
MIN_SHARE_OF_DOCS = 0.01
MIN_GRAMS = 40
MIN_SHARE = 0.3
#: Languages of one table.
WORD = 64
#: Numbers of a table of hits, of documents by language.
CELLS = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each character n-gram, n-grams before each row's end with a leading 0). Only n-grams whose inner
    characters are letters; what is no letter counts as a space."""
    codes = np.frombuffer("".join(("\0", *((t or "").replace("\0", " ").lower() + "\0" for t in texts))).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    m = len(codes) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inner = letter[1 : 1 + m].copy()
    total = codes[:m] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, N):
        total *= np.uint64(0x5851F42D4C957F2D)
        total += codes[i : i + m]
        if 1 < i < N - 1:
            inner &= letter[i : i + m]
    inner &= letter[:m] | letter[N - 1 : N - 1 + m]
    at = np.flatnonzero(inner)  # an n-gram may begin or end in the separator next to its row, as in a space
    return mix(total[at]), np.searchsorted(at, ends)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    width = SLOTS.bit_length() - 1
    return [((hashes >> np.uint64(i * width)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    languages: list[str]
    table: np.ndarray  # of slots; where there are more than 64 languages, a row of slots for every 64

    @cached_property
    def false_positive(self) -> np.ndarray:
        tables = np.atleast_2d(self.table)
        return np.array([float(((tables[i // WORD] >> tables.dtype.type(i % WORD)) & tables.dtype.type(1)).mean()) ** HASHES for i in range(len(self.languages))])

    def masks(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The masks of every 64 languages."""
        a, *more = _slots(hashes)
        for row in np.atleast_2d(self.table):
            out = row[a]
            for b in more:
                out &= row[b]
            yield out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each row, true hits by row and language)."""
        hashes, ends = grams(texts)
        n, fps = np.diff(ends), self.false_positive
        hits = np.zeros((len(texts), len(self.languages)))
        for k, masks in enumerate(self.masks(hashes)):
            for i, fp in enumerate(fps[k * WORD : (k + 1) * WORD]):
                sums = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(i)) & masks.dtype.type(1), dtype=np.int64)])
                hits[:, k * WORD + i] = np.maximum(sums[ends[1:]] - sums[ends[:-1]] - n * fp, 0) / max(1e-9, 1 - fp)
        return n, hits


def fit(df: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r[0]: r[1] for r in df.where("lang is not null").groupBy("lang").count().collect()}
    languages = sorted(counts)
    labelled = df.where("lang is not null and text is not null")
    kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(languages), WORD) <= bits)
    slots = np.zeros((max(1, -(-len(languages) // WORD)), SLOTS), kind)
    for k in range(len(slots)):
        some = languages[k * WORD : (k + 1) * WORD]
        share = F.lit(0)
        for name in some:
            share = F.when(F.col("lang") == name, int(min(1.0, per_language / counts[name]) * (1 << 30))).otherwise(share)
        rows = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share).select("lang", "text").toPandas()
        for i, name in enumerate(some):
            texts = rows.text[rows.lang == name].tolist()
            if not texts:
                continue
            hashes, ends = grams(texts)
            of = np.repeat(np.arange(len(texts)), np.diff(ends))
            order = np.lexsort((of, hashes))
            hashes, of = hashes[order], of[order]
            once = np.ones(len(of), bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
            found, docs = np.unique(hashes[once], return_counts=True)
            found = found[docs >= max(min(2, len(texts)), MIN_SHARE_OF_DOCS * len(texts))]
            for slot in _slots(found):
                slots[k, slot] |= kind(1 << i)
    return Filters(languages, slots if len(slots) > 1 else slots[0])


def _verdicts(f: Filters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language's number or -1, score, keep)."""
    step = max(1, CELLS // max(1, len(f.languages)))
    if len(texts) > step:
        parts = [_verdicts(f, texts[i : i + step]) for i in range(0, len(texts), step)]
        return tuple(np.concatenate(column) for column in zip(*parts))
    n, hits = f.scores(texts)
    best = hits.argmax(axis=1) if f.languages else np.zeros(len(texts), np.int64)
    top = hits[np.arange(len(texts)), best] if f.languages else np.zeros(len(texts))
    score = top / np.maximum(n, 1)
    letters = n > 0
    for i in np.flatnonzero(n == 0).tolist():
        letters[i] = any(c.isalpha() for c in texts[i] or "")
    return np.where(top > 0, best, -1), score, letters & ((n < MIN_GRAMS) | (score >= MIN_SHARE))


def identify(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, predicted (null: none), score (share of its n-grams in that language), keep."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)["doc_id"]
    shared = reachable(df.sparkSession).sparkContext.broadcast(filters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, None], object)
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score, keep = _verdicts(f, part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "predicted": pa.array(names[lang].tolist(), pa.string()), "score": pa.array(score), "keep": pa.array(keep),
                })

    return in_batches(df, work, f"doc_id {kind}, predicted string, score double, keep boolean")


def filter_language(df: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with the input's columns."""
    shared = reachable(df.sparkSession).sparkContext.broadcast(filters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(_verdicts(shared.value, part.column(text_col).to_pylist())[2]))

    return in_batches(df, work, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))
