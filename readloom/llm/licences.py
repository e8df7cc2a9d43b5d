"""Operator 7, licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A unit of text is a line, or a block: consecutive lines, each with at least half of its bigrams among those of
the templates (so a licence wrapped over many lines is one unit, and a file that is nothing but a licence as
well). Dice is 2 * common / (size of unit + size of template) over multisets of bigrams; for Dice >= t the
smaller size must be at least t / (2 - t) of the larger, so most units have no candidate template and most
templates are never compared. The unit's count of bigrams known from any template bounds what it can have in
common; what is left is compared exactly. A unit counts for the template it fits best (ties: the first name).

A licence may also lie inside a longer line, or next to another one: for each template, all windows of a text's
words, over lines as well, are held against it. The best window begins and ends with bigrams of the template, and
holds at least t / (2 - t) of them within (2 - t) / t of its size; only where they lie so dense are windows
compared, exactly. Of one template's overlapping windows the best counts, unless more than half of it lies in
windows of other templates that have more bigrams in common with the text, or that are a unit's own.

Result: a row for each document and licence found, with the highest Dice and the line where that unit or window starts
(from 1; ties: the first). Defined results: null and empty texts match nothing; a null id is carried like any
other; repeated rows give repeated results; further columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import in_batches, slices, table
from readloom.llm.grams import ngrams, words
from readloom.llm.templates import TEMPLATES

THRESHOLD = 0.8
#: Cells of the tables by which windows are compared.
CELLS = 1 << 20


@lru_cache(maxsize=4)
def _templates(items: tuple[tuple[str, str], ...]):
    names = [name for name, _ in items]
    hashes, ends, *_ = words(pa.array([text for _, text in items]))
    rows, grams = ngrams(hashes, ends, 2)
    bags = [Counter(grams[rows == i].tolist()) for i in range(len(items))]
    known = np.unique(grams)
    times = np.array([[b[g] for g in known.tolist()] for b in bags], np.int64).reshape(len(bags), len(known))
    return names, bags, np.array([sum(b.values()) for b in bags]), known, times


def _member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def _windows(at: np.ndarray, gram: np.ndarray, row: np.ndarray, times: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(first and last bigram, common, dice) of the windows that fit a template, none overlapping another.
    at, gram, row: place, number and row of the text's bigrams that the template has; times: how often it has each."""
    s = int(times.sum())
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    need, most = max(1, math.ceil(low * s - 1e-9)), math.floor(high * s + 1e-9)
    m = len(at)
    if m < need:
        return []
    reach = np.minimum(np.searchsorted(at, at + most), np.searchsorted(row, row, "right"))  # the end of what a window from here can hold
    starts = np.flatnonzero(reach - np.arange(m) >= need)
    if not starts.size:
        return []
    # a bigram counts only in windows that begin behind its last occurrence but as many as the template has
    order = np.argsort(gram, kind="stable")
    back = times[gram[order]]
    place = np.arange(m)
    first = np.searchsorted(gram[order], gram[order])
    before = np.full(m, -1)
    some = place - back >= first
    before[order[some]] = order[(place - back)[some]]
    found = []
    step = max(1, min(max(64, s), CELLS // most))
    for i in range(0, len(starts), step):
        some = starts[i : i + step]
        a, z = int(some[0]), int(reach[some].max())
        dense = np.minimum(np.bincount(gram[a:z], minlength=len(times)), times).sum() >= need if z - a < 8 * step + most else True
        if not dense:
            continue
        inside = some[:, None] + np.arange(int((reach[some] - some).max()))
        ok = inside < reach[some][:, None]
        inside = np.minimum(inside, m - 1)
        common = np.cumsum(ok & (before[inside] < some[:, None]), axis=1)
        dice = np.where(ok, 2 * common / (at[inside] - at[some][:, None] + 1 + s), 0)
        best = dice.argmax(axis=1)
        take = np.arange(len(some))
        for j in np.flatnonzero(dice[take, best] >= threshold).tolist():
            found.append((-float(dice[j, best[j]]), -int(common[j, best[j]]), int(at[some[j]]), int(at[inside[j, best[j]]])))
    out, taken = [], []
    for d, c, a, z in sorted(found):
        k = bisect.bisect(taken, (a, z))
        if (k == 0 or taken[k - 1][1] < a) and (k == len(taken) or taken[k][0] > z):
            taken.insert(k, (a, z))
            out.append((a, z, -c, -d))
    return out


def matches(texts: pa.Array, items: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[int, str, float, int]]:
    """(row, licence, dice, line) of a batch."""
    names, bags, sizes, known, times = _templates(items)
    hashes, ends, starts, data, offsets = words(texts)
    if len(hashes) < 1:
        return []
    # lines as rows of their own: a line ends at its newline or at the end of its text
    newline = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    line_of = np.searchsorted(cuts, starts, "right") - 1
    row_of_line = np.searchsorted(offsets, cuts, "right") - 1
    line_ends = np.searchsorted(line_of, np.arange(len(cuts) + 1))
    row_first = np.searchsorted(cuts, offsets[:-1])
    line_words = np.diff(line_ends)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    pair = np.zeros(len(hashes), bool)  # the word and the next one, of the same row, are a known bigram
    rows_of_words = row_of_line[line_of]
    both = rows_of_words[1:] == rows_of_words[:-1]
    _, grams = ngrams(hashes, np.array([0, len(hashes)]), 2)
    if len(hashes) > 1:
        pair[:-1] = _member(known, grams[: len(hashes) - 1]) & both
    same_line = np.zeros(len(hashes), bool)
    same_line[:-1] = line_of[1:] == line_of[:-1]
    totals = np.concatenate([[0], np.cumsum(pair & same_line)])
    hits = totals[line_ends[1:]] - totals[line_ends[:-1]]
    size = np.maximum(line_words - 1, 0)
    fits = np.zeros(len(cuts), bool)
    for s in np.unique(sizes):
        fits |= (size >= low * s) & (size <= high * s) & (2 * hits >= threshold * (size + s))
    units = [(i, i + 1) for i in np.flatnonzero(fits & (line_words > 1)).tolist()]
    # blocks: runs of such lines within a row; lines without two words don't break them
    good = (2 * hits >= size) & (hits > 0) | (line_words < 2)
    if good.any():
        start_of_row = np.zeros(len(cuts), bool)
        start_of_row[row_first[row_first < len(cuts)]] = True
        edge = np.flatnonzero(good & (start_of_row | ~np.r_[False, good[:-1]]))
        stop = np.flatnonzero(good & np.r_[start_of_row[1:] | ~good[1:], True]) + 1
        inside = np.concatenate([[0], np.cumsum(pair)])
        for a, b in zip(edge.tolist(), stop.tolist()):
            while a < b and line_words[a] < 2:
                a += 1
            while b > a and line_words[b - 1] < 2:
                b -= 1
            n = line_ends[b] - line_ends[a] - 1 if b > a else 0
            if b - a > 1 and ((sizes * low <= n) & (sizes * high >= n) & (2 * (inside[line_ends[b] - 1] - inside[line_ends[a]]) >= threshold * (n + sizes))).any():
                units.append((a, b))
    best: dict[tuple[int, str], tuple[float, int]] = {}
    whole: dict[str, list[tuple[int, int]]] = {}  # bigrams of the units of each licence
    for a, b in units:
        own = Counter(grams[line_ends[a] : line_ends[b] - 1].tolist())
        n = line_ends[b] - line_ends[a] - 1
        found = (0.0, "")
        for i in np.flatnonzero((sizes * low <= n) & (sizes * high >= n)).tolist():
            dice = 2 * sum((own & bags[i]).values()) / (n + int(sizes[i]))
            if dice >= threshold and (-dice, names[i]) < (-found[0], found[1] or "~"):
                found = (dice, names[i])
        if found[1]:
            row = int(row_of_line[a])
            key, value = (row, found[1]), (-found[0], a - int(row_first[row]) + 1)
            best[key] = min(best.get(key, value), value)
            whole.setdefault(found[1], []).append((int(line_ends[a]), int(line_ends[b]) - 2))
    at = np.flatnonzero(pair)
    number, row_of = np.searchsorted(known, grams[at]), rows_of_words[at]
    inner = []
    for i in np.flatnonzero(sizes > 0).tolist():
        own = np.flatnonzero(times[i][number])
        spans = sorted(whole.get(names[i], []))
        for a, z, common, dice in _windows(at[own], number[own], row_of[own], times[i], threshold):
            k = bisect.bisect(spans, (a, len(hashes))) - 1
            inner.append((not (k >= 0 and spans[k][1] >= z), -common, -dice, names[i], a, z))
    held = np.zeros(len(hashes), bool)
    for _, _, d, name, a, z in sorted(inner):
        if 2 * int(held[a : z + 1].sum()) <= z - a + 1:
            held[a : z + 1] = True
            row = int(rows_of_words[a])
            key, value = (row, name), (d, int(line_of[a]) - int(row_first[row]) + 1)
            best[key] = min(best.get(key, value), value)
    return [(row, name, -d, line) for (row, name), (d, line) in sorted(best.items())]


def licence_scan(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES
) -> DataFrame:
    """doc_id, licence, dice, line."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)["doc_id"]
    items = tuple(sorted(templates.items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = matches(part.column("text"), items, threshold)
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("doc_id").take(pa.array([f[0] for f in found])),
                        "licence": pa.array([f[1] for f in found], pa.string()),
                        "dice": pa.array([f[2] for f in found], pa.float64()),
                        "line": pa.array([f[3] for f in found], pa.int64()),
                    })

    return in_batches(df, work, f"doc_id {kind}, licence string, dice double, line bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
