"""Operator 4, best-fit packing by a configuration linear program over the length histogram.

Documents are packed into bins of ``capacity`` tokens. A document longer than that fills bins of its own, and
its remainder is packed like any other; a bin holds several pieces, no piece is cut further. With n_l pieces of
length l, a pattern is a multiset of lengths that fits a bin, and the program asks for the fewest bins, in
fractions of patterns, that hold all pieces. It is solved by multiplicative weights. A length's weight is what the
optimal duals tend to where bins can be filled, its share of a bin, times a factor that falls exponentially with
how far its pieces are covered already. In every round one knapsack dynamic program prices all patterns: for each
of the lengths that are covered least it gives the best pattern with that length, which gets a share of the bins.
The shares are rounded down to whole bins, the largest remainders up as long as there are pieces; what is left is
solved again, a few times, and at last goes by best fit, longest first, into the fullest bins with room, those of
the program included. Lengths under a 16th of a bin are kept for that: they fill what the patterns leave.

Only the histogram (``capacity`` numbers at most) comes to the driver, whatever the number of documents; so do the
time of the program and the table of pattern runs (some thousands) depend on the capacity alone. Each length's
pieces are numbered: within (length, part), with the parts' counts added up before them, so no task numbers more
than some million; the table of runs then says which bin holds piece k of length l.

Result: (doc_id, piece, start, length, bin, offset): tokens [start, start + length) of the document lie at
[offset, offset + length) of the bin. Defined results: a length is the number of tokens (``bpe``); documents
without one (null and empty texts) get no row; rows with null or repeated ids, of any type, are packed like any
other; ties are settled by hash and id; texts of any length are counted whole; further columns, whatever their
names, are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.bpe import PATTERN, VOCABULARY
from readloom.llm.common import in_batches, reachable, stored, table
from readloom.llm.token_counts import token_counts

CAPACITY = 2048
#: Rounds of multiplicative weights, patterns of a round, and how often what rounding leaves is solved again.
ROUNDS = 30
PATTERNS = 128
PASSES = 4
#: Pieces of a length that one task numbers.
PART_ROWS = 2_000_000
#: The share of a length's pieces that a pattern covers in a round, at most, and how fast weights fall.
_STEP = 0.34
_ETA = 3.0


def pieces(df: DataFrame, capacity: int, id_col: str, text_col: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, piece, start, length)."""
    counted = token_counts(df, id_col, text_col, path, pattern).where("n_tokens > 0")
    last = F.floor((F.col("n_tokens") - 1) / capacity)
    return counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).alias("length")
    )


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By knapsack dynamic programming, for each room from 0 to ``capacity``: the greatest weight that fits, the
    length that is put in last (0 if the room isn't better used than the one below), and the room that is used."""
    dense = np.full(capacity + 1, -np.inf)
    dense[lengths] = weights
    best, choice, low = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), int(lengths.min())
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if c >= low:
            each = dense[low : c + 1] + best[c - low :: -1]
            k = int(each.argmax())
            if each[k] > best[c] + 1e-12:
                best[c], choice[c] = each[k], k + low
    return best, choice, np.maximum.accumulate(np.where(choice > 0, np.arange(capacity + 1), 0))


def best_with(first: np.ndarray, choice: np.ndarray, used: np.ndarray, capacity: int) -> np.ndarray:
    """For each length the lengths of the best pattern with it, a row padded with zeros."""
    columns, room = [first], capacity - first
    while True:
        room = used[room]
        last = choice[room]
        if not last.any():
            return np.stack(columns, 1)
        columns.append(last)
        room = room - last


def shares(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, many: bool) -> list[tuple[dict[int, int], float]]:
    """The program's fractions of bins: patterns as {place of the length: pieces}, with the bins of each."""
    cover, place = np.zeros(len(lengths)), {int(x): i for i, x in enumerate(lengths)}
    found: dict[tuple[int, ...], float] = {}
    # of many lengths bins can be filled, and duals are close to the shares of a bin; of few they are anything, and
    # as a round's patterns share their partners, fewer go in before the weights are brought up to date
    most = PATTERNS if many else max(2, len(lengths) // 16)
    for turn in range(rounds if many else 3 * rounds):
        low = cover.min()
        if low >= 1:
            break
        factor = np.exp(-_ETA * (cover - low))
        _, choice, used = price(lengths * (1 + factor / capacity if many else factor), lengths, capacity)
        # the least covered first; among equals others in each round
        first = np.lexsort((np.arange(len(cover)) * 40503 * (2 * turn + 1) % 65537, np.round(cover, 2)))[:most]
        for row in best_with(lengths[first[cover[first] <= low + 0.5]], choice, used, capacity).tolist():
            pattern: dict[int, int] = {}
            for x in row:
                if x:
                    pattern[place[x]] = pattern.get(place[x], 0) + 1
            here = list(pattern)
            if any(counts[i] < n for i, n in pattern.items()) or any(cover[i] > 1.2 for i in here):
                continue
            step = _STEP * min(counts[i] / n for i, n in pattern.items())
            key = tuple(sorted(x for x in row if x))
            found[key] = found.get(key, 0.0) + step
            for i, n in pattern.items():
                cover[i] += n * step / counts[i]
    return [({place[x]: key.count(x) for x in set(key)}, share) for key, share in sorted(found.items())]


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, passes: int = PASSES) -> list[tuple[np.ndarray, int]]:
    """(pattern, bins) that hold all pieces exactly; patterns as counts by length."""
    left = counts.astype(np.int64).copy()
    runs: dict[tuple[tuple[int, int], ...], int] = {}
    for _ in range(passes):
        here = np.flatnonzero((left > 0) & (lengths * 16 >= capacity))
        if not len(here):
            break
        patterns = shares(lengths[here], left[here], capacity, rounds, len(lengths) * 4 >= capacity)
        whole = [(pattern, int(share)) for pattern, share in sorted(patterns, key=lambda x: -x[1])]
        more = [(pattern, 1) for pattern, share in sorted(patterns, key=lambda x: -(x[1] % 1)) if share % 1]
        for pattern, bins in whole + more:
            bins = min(bins, *(int(left[here[i]]) // n for i, n in pattern.items()))
            if bins > 0:
                key = tuple(sorted((int(here[i]), n) for i, n in pattern.items()))
                runs[key] = runs.get(key, 0) + bins
                for i, n in key:
                    left[i] -= n * bins
    solved = []
    for key, bins in runs.items():
        pattern = np.zeros(len(lengths), np.int64)
        for i, n in key:
            pattern[i] = n
        solved.append((pattern, bins))
    found, plain = best_fit(lengths, left, capacity, solved), best_fit(lengths, counts, capacity)
    return found if sum(b for _, b in found) <= sum(b for _, b in plain) else plain


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: list[tuple[np.ndarray, int]] = ()) -> list[tuple[np.ndarray, int]]:
    """Longest first, into the fullest bins with room, those begun included; equal bins are handled together."""
    open_bins: dict[int, list[list]] = {}  # room: [pattern, bins]
    for pattern, bins in begun:
        open_bins.setdefault(capacity - int((pattern * lengths).sum()), []).append([pattern, bins])
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, left = int(lengths[i]), int(counts[i])
        if not left:
            continue
        for room in sorted(r for r in open_bins if r >= size):
            if not left:
                break
            todo, open_bins[room] = open_bins[room], []
            for pattern, bins in todo:
                each = min(room // size, left)
                take = min(bins, left // each) if each else 0
                if take:
                    more = pattern.copy()
                    more[i] += each
                    open_bins.setdefault(room - each * size, []).append([more, take])
                    left -= take * each
                if bins > take:
                    open_bins[room].append([pattern, bins - take])
        each = capacity // size
        for take, k in ((left // each, each), (1 if left % each else 0, left % each)):
            if take:
                pattern = np.zeros(len(lengths), np.int64)
                pattern[i] = k
                open_bins.setdefault(capacity - k * size, []).append([pattern, take])
    return [(p, b) for room in sorted(open_bins) for p, b in open_bins[room] if b]


def layout(lengths: np.ndarray, runs: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length (first piece, first bin, bins, offset) of its slots: within a slot, piece k of the length
    lies in bin first bin + (k - first piece)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {int(x): [] for x in lengths}
    reached = dict.fromkeys(out, 0)
    start = 0
    for pattern, bins in runs:
        at = 0
        for i in np.flatnonzero(pattern).tolist():
            size = int(lengths[i])
            for _ in range(int(pattern[i])):
                out[size].append((reached[size], start, bins, at))
                reached[size] += bins
                at += size
        start += bins
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def pack_documents(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, part_rows: int = PART_ROWS, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    spark = reachable(df.sparkSession)
    every = stored(pieces(df, capacity, id_col, text_col, path, pattern), "pieces")
    rows = every.groupBy("length").count().toPandas().sort_values("length")
    lengths, counts = rows["length"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
    slots = spark.sparkContext.broadcast(layout(lengths, solve(lengths, counts, capacity, rounds)))
    parts = int(counts.max(initial=1) // part_rows + 1)
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("part")
    every = every.select("*", part)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    firsts = every.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", before.alias("first"))
    row = F.row_number().over(Window.partitionBy("length", "part").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")) - 1
    numbered = every.withColumn("row", row)
    numbered = numbered.withColumn("k", F.col("row").cast("bigint")) if parts == 1 else numbered.join(firsts, ["length", "part"]).withColumn("k", F.col("first") + F.col("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, k = (np.asarray(batch.column(c)) for c in ("length", "k"))
            bins, offsets = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for one in np.unique(size).tolist():
                here = np.flatnonzero(size == one)
                first, start, _, at = slots.value[one]
                slot = np.searchsorted(first, k[here], "right") - 1
                bins[here], offsets[here] = start[slot] + k[here] - first[slot], at[slot]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "piece", "start", "length")} | {"bin": pa.array(bins), "offset": pa.array(offsets)})

    kind = dict(every.dtypes)["doc_id"]
    return in_batches(numbered.select("doc_id", "piece", "start", "length", "k"), work, f"doc_id {kind}, piece bigint, start bigint, length bigint, bin bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
