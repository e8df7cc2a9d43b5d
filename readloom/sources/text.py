"""Lines with ordinals, and records of four lines."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one file, plain or (by its suffix) compressed. Lines end at a newline only; a carriage
    return is kept. Ordinals come from the position in each split plus the lines of the splits before, which are
    counted first; so a splittable file stays spread over its splits. A damaged file raises."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("id"))
    at = raw.select("value", F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    counts = sorted((r.part, r.n) for r in at.groupBy("part").agg(F.count("*").alias("n")).collect())
    if len(counts) <= 1 and (not counts or counts[0][0] == 0):
        return at.select(F.col("row").alias("line_no"), "value")
    before, firsts = 0, []
    for part, n in counts:
        firsts.append((part, before))
        before += n
    firsts = spark.createDataFrame(firsts, "part int, first bigint")
    return at.join(F.broadcast(firsts), "part").select((F.col("first") + F.col("row")).alias("line_no"), "value")


def lines_of(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line_no, value): the lines of a text column, from 0 in each row."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def characters(df: DataFrame, column: str = "value") -> DataFrame:
    """One row a character."""
    return df.select(F.explode(F.split(column, "")).alias("char")).where("char <> ''")


def stdin_lines(spark: SparkSession, stream: Iterable[str] | None = None) -> DataFrame:
    """(line_no, value) of the driver's standard input; a last line without a newline counts."""
    rows = [(i, line.rstrip("\n")) for i, line in enumerate(stream if stream is not None else sys.stdin)]
    return spark.createDataFrame(rows, "line_no bigint, value string")


FIELDS = ("name", "seq", "plus", "qual")


def records(lines: DataFrame, fields: str = "1111") -> DataFrame:
    """(idx, name, seq, plus, qual) of lines in groups of four; never by looking for '@', which a quality line may
    start with. fields: a mask, the last character for the name. A record that isn't complete raises."""
    keep = [f for f, bit in zip(FIELDS, reversed(fields)) if bit == "1"]
    wide = lines.groupBy(F.floor(F.col("line_no") / 4).cast("bigint").alias("idx")).agg(
        F.count("*").alias("n"), *(F.max(F.when(F.col("line_no") % 4 == FIELDS.index(f), F.col("value"))).alias(f) for f in keep)
    )
    whole = F.when(F.col("n") == 4, F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("an incomplete record: "), F.col("idx").cast("string"))))
    return wide.select(whole.alias("idx"), *keep)


def read_fastq(spark: SparkSession, path: str, fields: str = "1111") -> DataFrame:
    return records(read_lines(spark, path), fields)
