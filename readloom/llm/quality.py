"""Operator 3, quality rules: a short-circuit cascade.

A document is rejected when any rule rejects it, so the order of the rules changes the cost and never the
result. Each rule's cost (CPU seconds over a sample) and selectivity (share of the sample it rejects, among what
the rules before it left) are estimated, and the rules are ordered by rejection per cost. The cascade runs over
Arrow batches: a rule sees only the texts that the rules before it left, and what several rules count (characters
of a class, words, lines) is counted once.

The sample is about ``SAMPLE_ROWS`` rows chosen by a hash of the whole row, wherever they lie; rules are timed and
tried where the rows are, and only sums (at most a few hundred numbers) come to the driver.

Defined results: a null or blank text is rejected; ids of any type, nulls in other columns and repeated rows pass
through untouched; texts of any length are judged whole; an empty table gives an empty table; of an input with
further columns, whatever their names, ``quality_flags`` returns only the id and ``keep``, and ``filter_quality``
exactly the input's columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import in_batches, reachable, slices, table, utf8
from readloom.llm.grams import byte_hashes

#: Rows of the sample by which the rules are ordered (the order has no influence on the result).
SAMPLE_ROWS = 1000
#: Words of a row whose different ones are counted by a sort of its own; shorter rows are sorted together.
_LONG = 256


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_BLANK, _UPPER, _MARK, _DIGIT = _class(b" \t\r\n"), _class(bytes(range(65, 91))), _class(b"!"), _class(b"0123456789")
_SYMBOL = _class(b"#$%&*|<>{}\\^~_=+@")
_CONTINUED = _class(bytes(range(0x80, 0xC0)))


class Texts:
    """Texts one after the other, and what rules count in them: a number for each text, counted when first asked."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.data, self.offsets = utf8(column)

    def left(self, keep: np.ndarray) -> Texts:
        """Some of the texts, with what is counted already."""
        out = Texts(self.column.filter(pa.array(keep)))
        for name in ("solid", "words", "kinds", "lines", "line_kinds"):
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name][keep]
        return out

    def count(self, characters: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(characters[self.data]), self.offsets))

    @cached_property
    def solid(self) -> np.ndarray:
        """Characters other than blanks."""
        return np.diff(self.offsets) - self.count(_BLANK | _CONTINUED)

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        solid = ~_BLANK[self.data]
        before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
        return np.flatnonzero(solid & (~before | edge[:-1])), np.flatnonzero(solid & (~after | edge[1:])) + 1

    @cached_property
    def words(self) -> np.ndarray:
        return np.diff(np.searchsorted(self._spans[0], self.offsets))

    @cached_property
    def kinds(self) -> np.ndarray:
        """Different words."""
        starts, ends = self._spans
        return _different(byte_hashes(self.data, starts, ends), np.searchsorted(starts, self.offsets))

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of the newlines, newlines before each text's end with a leading 0)."""
        at = np.flatnonzero(self.data == 10)
        return at, np.searchsorted(at, self.offsets)

    @cached_property
    def lines(self) -> np.ndarray:
        return np.diff(self._lines[1]) + 1

    @cached_property
    def line_kinds(self) -> np.ndarray:
        """Different lines."""
        at = self._lines[0]
        rows = len(self.offsets) - 1
        ends = np.sort(np.concatenate([at, self.offsets[1:]]), kind="stable")  # an empty text's end comes after what ends there
        edges = np.concatenate([[0], np.cumsum(self.lines)])
        starts = np.empty(len(ends), np.int64)
        starts[1:] = ends[:-1] + 1
        starts[edges[:-1]] = self.offsets[:-1]
        return _different(byte_hashes(self.data, starts, ends), edges) if rows else np.zeros(0, np.int64)


def _different(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many different hashes there are between each two edges."""
    size = np.diff(edges)
    out = np.zeros(len(size), np.int64)
    for k in np.flatnonzero(size > _LONG).tolist():
        own = np.sort(hashes[edges[k] : edges[k + 1]])
        out[k] = 1 + np.count_nonzero(own[1:] != own[:-1])
    if (short := (size <= _LONG)).any():
        rows = np.repeat(np.where(short, np.arange(len(size)), -1), size)
        hashes, rows = hashes[rows >= 0], rows[rows >= 0]
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        out += np.bincount(rows[new], minlength=len(size))
    return out


def _repeated_words(t: Texts) -> np.ndarray:
    """Fewer than 0.35 of up to 2,000 words are different; beyond, what is asked for grows with the root of the
    number of words, as the words of a text do."""
    if not (t.words >= 16).any():
        return np.zeros(len(t.words), bool)
    return (t.words >= 16) & np.where(t.words <= 2000, t.kinds * 20 < t.words * 7, t.kinds * t.kinds < t.words * 245)


#: True where the rule rejects. All in whole numbers, so that every engine agrees.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "blank": lambda t: t.solid == 0,
    "symbols": lambda t: t.count(_SYMBOL) * 20 > t.solid,
    "exclamations": lambda t: ((marks := t.count(_MARK)) >= 3) & (marks * 20 > t.solid),
    "shouting": lambda t: ((upper := t.count(_UPPER)) >= 10) & (upper * 2 > t.solid),
    "digits": lambda t: t.count(_DIGIT) * 2 > t.solid,
    "repeated_words": _repeated_words,
    "long_words": lambda t: t.solid > t.words * 30,
    "repeated_lines": lambda t: (t.lines >= 6) & (t.line_kinds * 2 < t.lines) if (t.lines >= 6).any() else np.zeros(len(t.lines), bool),
}


def kept(column: pa.Array, order: list[str]) -> np.ndarray:
    """True where no rule rejects."""
    out = ~np.asarray(column.is_null())
    here, texts = np.flatnonzero(out), Texts(column.filter(pa.array(out)))
    for name in order:
        if not len(here):
            break
        rejected = RULES[name](texts)
        if rejected.any():
            out[here[rejected]] = False
            here, texts = here[~rejected], texts.left(~rejected)
    return out


def measured_order(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected of what came to it), in the order of the cascade."""
    names = list(RULES)
    total = df.count()
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.simpleString().split("(")[0].split("<")[0] not in ("map", "variant", "void")]
    share = int(min(1.0, sample_rows / max(1, total)) * (1 << 30))
    rows = df.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(*plain), F.lit(1 << 30)) < share)).select(F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                mask, cost = np.zeros(part.num_rows, np.int64), []
                for k, rule in enumerate(RULES.values()):
                    texts = Texts(part.column("text"))
                    began = time.thread_time()
                    mask |= rule(texts).astype(np.int64) << k
                    cost.append(time.thread_time() - began)
                masks, times = np.unique(mask, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "rule": pa.array([-1] * len(masks) + list(range(len(cost))), pa.int32()), "mask": pa.array([*masks.tolist(), *([0] * len(cost))], pa.int64()),
                    "value": pa.array([*map(float, times), *cost], pa.float64()),
                })

    found = in_batches(rows, work, "rule int, mask bigint, value double").groupBy("rule", "mask").agg(F.sum("value").alias("value")).collect()
    cost = {names[r.rule]: r.value for r in found if r.rule >= 0}
    left = {r.mask: r.value for r in found if r.rule < 0}
    order: list[tuple[str, float, float]] = []
    while len(order) < len(names):
        here = sum(left.values())
        share = {k: sum(n for m, n in left.items() if m >> i & 1) / max(1.0, here) for i, k in enumerate(names) if k not in {o[0] for o in order}}
        best = max(share, key=lambda k: (share[k] / max(cost.get(k, 0.0), 1e-6), -cost.get(k, 0.0)))
        order.append((best, cost.get(best, 0.0), share[best]))
        left = {m: n for m, n in left.items() if not m >> names.index(best) & 1}
    return order


def _order(df: DataFrame, text_col: str, sample_rows: int) -> list[str]:
    reachable(df.sparkSession)
    return [name for name, _, _ in measured_order(df, text_col, sample_rows)]


def quality_flags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and keep."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, order = dict(df.dtypes)["doc_id"], _order(df, "text", sample_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "keep": pa.array(kept(part.column("text"), order))})

    return in_batches(df, work, f"doc_id {kind}, keep boolean")


def filter_quality(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that are kept, with the input's columns."""
    order = _order(df, text_col, sample_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(kept(part.column(text_col), order)))

    return in_batches(df, work, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_flags(table(spark, sf_dir, "documents"))


#: The same rules over a relation ``{src}`` with a column text, as a condition for DuckDB.
SQL_KEEP = r"""(text is not null and not (
  not regexp_matches(text, '[^ \t\r\n]')
  or length(regexp_replace(text, '[^#$%&*|<>{}\\^~_=+@]+', '', 'g')) * 20 > length(regexp_replace(text, '[ \t\r\n]+', '', 'g'))
  or (length(regexp_replace(text, '[^!]+', '', 'g')) >= 3
      and length(regexp_replace(text, '[^!]+', '', 'g')) * 20 > length(regexp_replace(text, '[ \t\r\n]+', '', 'g')))
  or (length(regexp_replace(text, '[^A-Z]+', '', 'g')) >= 10
      and length(regexp_replace(text, '[^A-Z]+', '', 'g')) * 2 > length(regexp_replace(text, '[ \t\r\n]+', '', 'g')))
  or length(regexp_replace(text, '[^0-9]+', '', 'g')) * 2 > length(regexp_replace(text, '[ \t\r\n]+', '', 'g'))
  or (len(regexp_extract_all(text, '[^ \t\r\n]+')) >= 16
      and case when len(regexp_extract_all(text, '[^ \t\r\n]+')) <= 2000
          then len(list_distinct(regexp_extract_all(text, '[^ \t\r\n]+'))) * 20 < len(regexp_extract_all(text, '[^ \t\r\n]+')) * 7
          else len(list_distinct(regexp_extract_all(text, '[^ \t\r\n]+'))) * len(list_distinct(regexp_extract_all(text, '[^ \t\r\n]+')))
            < len(regexp_extract_all(text, '[^ \t\r\n]+')) * 245 end)
  or length(regexp_replace(text, '[ \t\r\n]+', '', 'g')) > len(regexp_extract_all(text, '[^ \t\r\n]+')) * 30
  or (len(string_split(text, chr(10))) >= 6
      and len(list_distinct(string_split(text, chr(10)))) * 2 < len(string_split(text, chr(10))))))"""

SQL = f"select doc_id, {SQL_KEEP} as keep from documents"
