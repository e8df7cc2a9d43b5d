"""The same demultiplexing over a stream of read sets: matching has no state, so it appends; the logs are
running counts in complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.demux import Barcodes, demultiplex, first_output, second_output
from readloom.operators.logs import classified, clear_log, unclear_log

READ_SETS = "idx bigint" + "".join(f", {m} struct<name:string,seq:string,plus:string,qual:string>" for m in ("r1", "r2", "r3", "r4", "i1"))


def read_set_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Read sets that arrive as Parquet files."""
    return spark.readStream.schema(READ_SETS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def demultiplex_stream(reads: DataFrame, bc: Barcodes, way: str = "auto") -> DataFrame:
    return demultiplex(reads, bc, way)


def write_records(matched: DataFrame, bc: Barcodes, path: str, checkpoint: str, which: str = "r1", **trigger) -> StreamingQuery:
    """Append the tagged reads as Parquet with their ordinals; files of a batch are committed together."""
    rows = (first_output if which == "r1" else second_output)(matched, bc)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_log(matched: DataFrame, plate: bool, name: str, checkpoint: str, kind: str = "clear", **trigger) -> StreamingQuery:
    """Reads per barcode so far, as a table in memory."""
    log = (clear_log if kind == "clear" else unclear_log)(classified(matched, plate))
    return log.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
