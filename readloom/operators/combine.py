"""Putting files together: one after the other, side by side, and mates by ordinal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.select import select_lines

MATES = ("r1", "r2", "r3", "r4", "i1")


def concatenate(files: list[DataFrame], span: str = "", mask: str = "") -> DataFrame:
    """(file_no, line_no, value): range and mask apply to each file by itself; the same file may occur again."""
    parts = [select_lines(f, span, mask).select(F.lit(i).alias("file_no"), "line_no", "value") for i, f in enumerate(files)]
    return reduce(DataFrame.unionByName, parts)


def paste(files: list[DataFrame], span: str = "", mask: str = "", delimiter: str = "") -> DataFrame:
    """(line_no, value): line i of every file, joined by the delimiter; it ends with the shortest file. The range
    is applied before the join, so only the lines in it are moved."""
    parts = [select_lines(f, span, mask).select("line_no", F.col("value").alias(f"v{i}")) for i, f in enumerate(files)]
    joined = reduce(lambda a, b: a.join(b, "line_no"), parts)
    return joined.select("line_no", F.concat_ws(delimiter, *(f"v{i}" for i in range(len(files)))).alias("value"))


def zip_mates(**mates: DataFrame) -> DataFrame:
    """(idx, r1, r2, ...): the records of all mates with the same ordinal, as structs."""
    parts = [df.select("idx", F.struct("name", "seq", "plus", "qual").alias(k)) for k, df in mates.items()]
    return reduce(lambda a, b: a.join(b, "idx"), parts)


def mate_counts(**mates: DataFrame) -> DataFrame:
    """(mate, n) of each mate, all mates, with or without a plate."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("mate")).groupBy("mate").agg(F.count("*").alias("n")) for k, df in mates.items()))


def check_mates(**mates: DataFrame) -> int:
    """The number of records, which must be the same for all mates."""
    counts = {r.mate: r.n for r in mate_counts(**mates).collect()}
    if len({counts.get(k, 0) for k in mates}) > 1:
        raise ValueError(f"inconsistent number of sequences in input: {counts}")
    return next(iter(counts.values()), 0)


def io_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines and bytes, a newline counted with each line, going in and coming out."""
    size = lambda df, k: df.agg(F.count("*").alias(f"lines_{k}"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias(f"bytes_{k}"))
    return size(before, "in").crossJoin(size(after, "out"))
