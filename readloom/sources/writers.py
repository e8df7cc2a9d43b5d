"""Ordered text sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.plans.session import reachable


def record_lines(records: DataFrame) -> DataFrame:
    """(idx, value): the four lines of each record."""
    return records.select("idx", F.concat_ws("\n", "name", "seq", "plus", "qual").alias("value"))


def write_ordered(df: DataFrame, path: str, order: str = "idx", compression: str | None = "gzip", overwrite: bool = False) -> None:
    """Text files in a directory whose names sort as their lines do: a range partitioning and a sort within each.
    An existing path raises unless it may be overwritten."""
    ordered = df.repartitionByRange(order).sortWithinPartitions(order).select("value")
    ordered.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression or "none").option("lineSep", "\n").text(path)


def write_outputs(records: DataFrame, path: str, compression: str | None = "gzip", overwrite: bool = False, level: str = "BEST_SPEED") -> None:
    """Several ordered outputs in one pass, without an exchange: (chunk, idx, output, value), where all rows of a
    chunk are in one partition, as ``operators.demux.spread`` leaves them. Writes output=.../chunk=... folders
    whose names sort as their lines do. level: of gzip, as zlib's names say; compression is most of the work, and
    the fastest level makes files a few percent larger."""
    named = records.withColumn("chunk", F.lpad(F.col("chunk").cast("string"), 16, "0"))
    ordered = named.sortWithinPartitions("output", "chunk", "idx").select("output", "chunk", "value")
    writer = ordered.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("output", "chunk")
    writer.option("compression", compression or "none").option("zlib.compress.level", level).option("lineSep", "\n").text(path)


def join_parts(directory: str, target: str, overwrite: bool = False) -> int:
    """One file from the parts in a folder and the folders in it, on a file system that is mounted here: gzip
    members one after the other are a gzip file. Its bytes."""
    if Path(target).exists() and not overwrite:
        raise FileExistsError(target)
    size = 0
    with open(target, "wb") as out:
        for part in sorted(Path(directory.removeprefix("file:")).rglob("part-*")):
            with open(part, "rb") as f:
                while block := f.read(1 << 20):
                    size += out.write(block)
    return size


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch: its lines as one text, and how many they are."""
    for batch in batches:
        if batch.num_rows:
            text = "\n".join(batch.column(0).to_pylist()) + "\n"
            yield pa.RecordBatch.from_pydict({"block": [text], "n": [batch.num_rows]})


def write_stdout(df: DataFrame, stream) -> int:
    """Lines to the driver's output, a partition at a time, which comes in blocks that the executors join. The number
    of lines. What isn't UTF-8 becomes U+FFFD."""
    reachable(df.sparkSession)
    n = 0
    blocks = df.select(F.make_valid_utf8("value")).mapInArrow(_blocks, "block string, n bigint")
    for row in blocks.toLocalIterator(prefetchPartitions=True):
        stream.write(row.block)
        n += row.n
    return n


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=4) + "\n")
