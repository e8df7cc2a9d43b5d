"""The nearest barcode of a segment by edit distance.

A segment shorter than required is invalid; at distance 0 it is correct, at a unique minimum corrected, and at
a tie unclear. There is no greatest distance unless one is asked for.

Three ways with the same result:

* enumerated: segments have up to 8 bases, so all 4**8 possible ones are matched beforehand, by one dynamic
  program over the tree of prefixes, into a table whose size doesn't depend on the data (some MB). It is
  broadcast; each read needs one look-up, and the reads are neither shuffled nor scanned twice. Segments with
  other letters (N) aren't in the table; they are compared in the row, all others skip that branch.
* inline: each code is compared in the row. For sets of a few codes, and for streams.
* distinct: each distinct segment is compared once and joined back. For long segments of large sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.barcodes import BarcodeSet

#: Sets of up to so many codes are compared in the row.
FEW = 4
#: Segments up to this length are enumerated.
LONGEST = 8

_KIND = "struct<ord:int,ed:int,ties:int>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _few(segment: str, codes: list[str]) -> str:
    each = [f"levenshtein({segment}, {_quoted(c)})" for c in codes]
    low = f"least({', '.join(each)})" if len(each) > 1 else each[0]
    ties = " + ".join(f"if({e} = {low}, 1, 0)" for e in each)
    first = " ".join(f"when {e} = {low} then {i}" for i, e in enumerate(each, 1))
    return f"named_struct('ord', case {first} else 0 end, 'ed', {low}, 'ties', {ties})"


def _listed(values: list[str]) -> Column:
    """A literal array: folded once, instead of one expression a value."""
    return F.split(F.lit(" ".join(values)), " ")


def _many(segment: str, codes: list[str]) -> str:
    """One pass over the codes that keeps the least distance, where it was first, and how often."""
    listed = f"split({_quoted(' '.join(codes))}, ' ')"
    found = f"transform({listed}, c -> levenshtein({segment}, c))"
    step = """case when e.ed < best.ed then named_struct('ord', e.ord + 1, 'ed', e.ed, 'ties', 1)
        when e.ed = best.ed then named_struct('ord', best.ord, 'ed', best.ed, 'ties', best.ties + 1) else best end"""
    return f"aggregate(transform({found}, (ed, ord) -> named_struct('ord', ord, 'ed', ed)), named_struct('ord', 0, 'ed', 1000000, 'ties', 0), (best, e) -> {step})"


def best(segment: str, codes: list[str]) -> Column:
    """struct(ord, ed, ties): the first nearest code (from 1), its distance, and how many are as near. segment: the
    name of a column, or SQL; as text, an expression over all codes is handed over at once."""
    return F.expr((_few if len(codes) <= FEW else _many)(segment, codes))


def verdict(segment: str, required: int | str, found: str, barcodes: BarcodeSet, max_ed: int | None = None) -> Column:
    """struct(tag, ord, ed, rt) of what ``best`` found. segment, required, found: columns, by name."""
    short = f"({segment} is null or length({segment}) < {required})"
    told = f"({found}.ed = 0 or {found}.ties = 1)" + (f" and {found}.ed <= {max_ed}" if max_ed is not None else "")
    tag = f"element_at(split({_quoted(' '.join(barcodes.tags))}, ' '), {found}.ord)"
    return F.expr(f"""named_struct(
        'tag', case when not {short} and {told} then {tag} else {_quoted(barcodes.unclear)} end,
        'ord', case when not {short} and {told} then {found}.ord else 0 end,
        'ed', case when {short} then -1 else {found}.ed end,
        'rt', case when {short} then 'invalid' when {found}.ed = 0 then 'correct' when {told} then 'corrected' else 'unclear' end)""")


@lru_cache(maxsize=32)
def enumerate_segments(codes: tuple[str, ...], longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 0 to ``longest``: (ord, ed, ties) of all segments over ACGT in order. A distance row of
    a prefix gives those of its four continuations."""
    bases = np.frombuffer(b"ACGT", np.uint8)
    out = [(np.zeros(4**n, np.int32), np.full(4**n, 1_000_000, np.int32), np.zeros(4**n, np.int32)) for n in range(longest + 1)]
    for i, code in enumerate(codes, 1):
        letters = np.frombuffer(code.encode(), np.uint8)
        row = np.arange(len(code) + 1, dtype=np.int32)[None, :]
        for n in range(longest + 1):
            if n:
                old = np.repeat(row, 4, axis=0)
                row = np.empty_like(old)
                base = np.tile(bases, len(old) // 4)
                row[:, 0] = n
                for k, letter in enumerate(letters):
                    row[:, k + 1] = np.minimum(np.minimum(old[:, k] + (base != letter), old[:, k + 1] + 1), row[:, k] + 1)
            ed, (ords, low, ties) = row[:, -1], out[n]
            nearer = ed < low
            ties[ed == low] += 1
            ties[nearer], ords[nearer] = 1, i
            np.minimum(low, ed, out=low)
    return out


@lru_cache(maxsize=32)
def _rows(codes: tuple[str, ...], lengths: tuple[int, ...]) -> pa.Table:
    tables = enumerate_segments(codes, max(lengths))
    words: list[str] = []
    for n in lengths:
        grid = np.array(np.meshgrid(*[np.frombuffer(b"ACGT", np.uint8)] * n, indexing="ij"), np.uint8).reshape(n, -1).T if n else np.zeros((1, 0), np.uint8)
        flat = np.ascontiguousarray(grid).tobytes().decode()
        words += [flat[i : i + n] for i in range(0, len(flat), n)] if n else [""]
    columns = [np.concatenate([tables[n][k] for n in lengths]) for k in range(3)]
    return pa.table({"segment": words, "ord": columns[0], "ed": columns[1], "ties": columns[2]})


#: The tables that sessions have made, by application, set and lengths: made once, however many plans use them.
_TABLES: dict[tuple, DataFrame] = {}


def segment_table(spark: SparkSession, barcodes: BarcodeSet, lengths: tuple[int, ...]) -> DataFrame:
    """(segment, struct(ord, ed, ties)) of all segments over ACGT of these lengths."""
    key = spark.sparkContext.applicationId, id(spark), tuple(barcodes.codes), tuple(lengths)
    if key not in _TABLES:
        for old in [k for k in _TABLES if k[0] != key[0]]:
            del _TABLES[old]
        rows = spark.createDataFrame(_rows(tuple(barcodes.codes), tuple(lengths)))
        # kept, so that a plan refers to it instead of holding its rows
        _TABLES[key] = rows.select("segment", F.struct("ord", "ed", "ties").cast(_KIND).alias("found")).persist()
    return _TABLES[key]


def match(
    df: DataFrame, segment: Column, required: int | Column, barcodes: BarcodeSet, out: str, lengths: tuple[int, ...] | None = None, way: str = "auto", max_ed: int | None = None
) -> DataFrame:
    """Adds ``out``: struct(tag, ord, ed, rt). lengths: those that segments can have (needed where they are not
    all as long as the longest code)."""
    lengths = lengths or (barcodes.max_length,)
    if way == "auto":
        joined = "inline" if df.isStreaming else "distinct"  # a stream isn't joined with itself
        way = "inline" if len(barcodes.codes) <= FEW else "enumerated" if max(lengths) <= LONGEST else joined
    key, hit, found, least = (f"__{out}_{k}" for k in ("segment", "hit", "found", "required"))
    df = df.withColumns({key: segment} if isinstance(required, int) else {key: segment, least: required})
    if way == "inline":
        df = df.withColumn(found, best(key, barcodes.codes))
    elif way == "enumerated":
        known = segment_table(df.sparkSession, barcodes, lengths).select(F.col("segment").alias(key), F.col("found").alias(hit))
        df = df.join(F.broadcast(known), key, "left")
        df = df.withColumn(found, F.coalesce(F.col(hit), F.when(F.col(key).isNotNull(), best(key, barcodes.codes).cast(_KIND)))).drop(hit)
    else:
        once = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(found, best(key, barcodes.codes).cast(_KIND))
        df = df.join(once, key, "left")
    # what was found is a column of its own, so that its uses don't repeat the search
    return df.withColumn(out, verdict(key, required if isinstance(required, int) else least, found, barcodes, max_ed)).drop(key, found, least)


def exact_then_fuzzy(segment: str, barcodes: BarcodeSet) -> Column:
    """The older way in one row: look the code up; only on a miss compare. tag, and whether it was exact. segment: the
    name of a column, or SQL."""
    exact = F.element_at(F.map_from_arrays(_listed(barcodes.codes), _listed(barcodes.tags)), F.expr(segment))
    found = best(segment, barcodes.codes)
    fuzzy = F.when(found["ties"] == 1, F.element_at(_listed(barcodes.tags), found["ord"])).otherwise(F.lit(barcodes.unclear))
    return F.struct(F.coalesce(exact, fuzzy).alias("tag"), exact.isNotNull().alias("exact"))
