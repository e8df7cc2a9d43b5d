"""A data source for mates in lockstep: ``spark.read.format('mates')``.

A lane is a set of files, one a mate; a lane is a partition, read from all its files at once, so the positional
join of the mates needs no shuffle and no ordinal column in the files. Gzip can't be split: reading (blocks of
bytes, cut into columns by array operations, no row is touched by itself) is all that one task does for a lane,
and ``operators.demux.spread`` deals the records out for all else.

Options: r1, r2, ... i1: comma-separated paths, as many for each mate as there are lanes, local or with the scheme
of a file system that pyarrow knows (hdfs, s3, gs, ...); range: of records, in each lane. Schema: lane, idx, and a
struct(name, seq, plus, qual) for each mate. idx is lane * 2**40 + the record's ordinal in its lane, so it tells
records of all lanes apart and orders them. Mates of unequal length, a last record of fewer than four lines, damaged
gzip and bytes that are no UTF-8 raise.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.operators.combine import MATES
from readloom.operators.select import parse_range
from readloom.plans.session import reachable

_RECORD = "struct<name:string,seq:string,plus:string,qual:string>"
FIELDS = ("name", "seq", "plus", "qual")
#: Bytes that are read and cut at once, and records of a batch.
BLOCK = 4 << 20
ROWS = 10_000
#: Bits of idx below the lane.
LANE_BITS = 40


def open_bytes(path: str) -> io.BufferedIOBase:
    """Plain or gzip, whatever the name says, on any file system."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        raw = io.BufferedReader(system.open_input_file(inner), 1 << 20)
    else:
        raw = open(path.removeprefix("file://").removeprefix("file:"), "rb", buffering=1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def cut_lines(data: np.ndarray, newlines: np.ndarray) -> pa.LargeStringArray:
    """The lines that end at the newlines (one after the other from the first byte), without them."""
    size = int(newlines[-1]) + 1 if len(newlines) else 0
    keep = np.ones(size, bool)
    keep[newlines] = False
    offsets = np.concatenate([[0], newlines - np.arange(len(newlines))]).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(newlines), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[:size][keep].tobytes()))
    out.validate(full=True)
    return out


def record_blocks(path: str) -> Iterator[list[pa.Array]]:
    """(names, sequences, pluses, qualities), some thousand records at a time."""
    rest = b""
    with open_bytes(path) as f:
        while True:
            block = f.read(BLOCK)
            if not block and rest and not rest.endswith(b"\n"):
                block = b"\n"  # the last line's end may be missing
            data = rest + block
            if not data:
                return
            array = np.frombuffer(data, np.uint8)
            newlines = np.flatnonzero(array == 10)
            newlines = newlines[: len(newlines) // 4 * 4]
            if not block and not len(newlines):
                raise ValueError(f"the last record of {path} isn't complete")
            rest = data[int(newlines[-1]) + 1 :] if len(newlines) else data
            if len(newlines):
                lines = cut_lines(array, newlines)
                yield [lines.take(pa.array(np.arange(k, len(lines), 4))) for k in range(4)]


class Records:
    """The records of one file, to be taken in any number."""

    def __init__(self, path: str):
        self.path, self.blocks, self.held = path, record_blocks(path), []
        self.at = 0

    def ready(self) -> int:
        """Records that can be taken at once; 0 at the end."""
        while not self.held or self.at == len(self.held[0]):
            self.held, self.at = next(self.blocks, None), 0
            if self.held is None:
                self.held = []
                return 0
        return len(self.held[0]) - self.at

    def take(self, n: int) -> list[pa.Array]:
        self.at += n
        return [column.slice(self.at - n, n) for column in self.held]


class Lane(InputPartition):
    def __init__(self, number: int, paths: tuple[str, ...]):
        self.number, self.paths = number, paths


class MatesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.mates = [m for m in MATES if options.get(m)]
        self.lanes = list(zip(*([p.strip() for p in options[m].split(",")] for m in self.mates), strict=True))
        self.span = parse_range(options.get("range", ""))

    def partitions(self) -> list[Lane]:
        return [Lane(i, paths) for i, paths in enumerate(self.lanes)]

    def read(self, partition: Lane) -> Iterator[pa.RecordBatch]:
        first, stop = self.span
        files, at = [Records(p) for p in partition.paths], 0
        while stop is None or at < stop:
            ready = [f.ready() for f in files]
            if not all(ready):
                if any(ready):
                    raise ValueError(f"inconsistent number of sequences in input: {partition.paths}")
                return
            n = min(*ready, ROWS) if stop is None else min(*ready, ROWS, stop - at)
            parts = [f.take(n) for f in files]
            skip = min(n, max(0, first - at))
            if skip < n:
                idx = np.arange(at + skip, at + n) + (partition.number << LANE_BITS)
                out = {"lane": pa.array(np.full(n - skip, partition.number, np.int32)), "idx": pa.array(idx)}
                for mate, columns in zip(self.mates, parts):
                    out[mate] = pa.StructArray.from_arrays([c.slice(skip).cast(pa.string()) for c in columns], list(FIELDS))
                yield pa.RecordBatch.from_pydict(out)
            at += n


class Mates(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mates"

    def schema(self) -> str:
        return "lane int, idx bigint" + "".join(f", {m} {_RECORD}" for m in MATES if self.options.get(m))

    def reader(self, schema) -> MatesReader:
        return MatesReader(dict(self.options))


def read_mates(spark: SparkSession, span: str = "", **paths: str | list[str]):
    """(lane, idx, r1, ...): ``read_mates(spark, r1='a.fastq.gz', r2=[...])``."""
    reachable(spark).dataSource.register(Mates)
    options = {k: v if isinstance(v, str) else ",".join(v) for k, v in paths.items()}
    return spark.read.format("mates").options(range=span, **options).load()
