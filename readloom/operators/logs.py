"""Reads per barcode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_class(plate_and_stagger_ignored: bool = True) -> Column:
    """unclear if any of A to D couldn't be told, else corrected if any wasn't exact, else correct."""
    kinds = [F.col(f"{k}.rt") for k in "abcd"]
    told = F.lit(True)
    exact = F.lit(True)
    for kind in kinds:
        told = told & ~kind.isin("unclear", "invalid")
        exact = exact & (kind == "correct")
    return F.when(~told, "unclear").when(~exact, "corrected").otherwise("correct")


def log_code(plate: bool) -> Column:
    """As in the header, without the dash."""
    return F.concat(*(F.col(f"{k}.tag") for k in ("a", "c", "b", "d", *(("p",) if plate else ()))))


def classified(matched: DataFrame, plate: bool) -> DataFrame:
    return matched.select(log_code(plate).alias("code"), read_class().alias("rt"))


def clear_log(reads: DataFrame) -> DataFrame:
    """(code, correct, corrected) of (code, rt), by code."""
    counts = reads.where("rt <> 'unclear'").groupBy("code").agg(F.count_if(F.col("rt") == "correct").alias("correct"), F.count_if(F.col("rt") == "corrected").alias("corrected"))
    return counts.orderBy("code")


def unclear_log(reads: DataFrame) -> DataFrame:
    """(code, reads) of (code, rt), by code."""
    return reads.where("rt = 'unclear'").groupBy("code").agg(F.count("*").alias("reads")).orderBy("code")


def log_lines(log: DataFrame, kind: str) -> DataFrame:
    """The lines of a log file, after its header line."""
    return log.select(F.concat_ws("\t", *log.columns).alias("value"))


HEADERS = {"clear": "Barcode \t Correct reads \t Corrected reads", "unclear": "Barcode \t Reads"}
