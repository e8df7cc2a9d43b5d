"""The older, single-threaded programs' semantics, record by record: three variants of headers, fixed clip
sizes, and a length gate instead of one length a segment. Their slips that depend on the record before (a
stagger that stays, streams that lose step) are not reproduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.strings import max_substr, read_name, read_name_with_space
from readloom.operators.demux import Barcodes, rx
from readloom.operators.match import match

GATE = 22
STAGGER = 10
#: Variant to the plate code's length (0: no plate).
VARIANTS = {"8bp": 8, "7bp": 7, "noplate": 0}


def legacy(reads: DataFrame, bc: Barcodes, variant: str = "8bp") -> DataFrame:
    """Adds stagger (digit; 9: the read is too short), tags code_a to code_d and code_p, RX, QX, header, class rt and clip."""
    plate = VARIANTS[variant]
    out = match(reads, max_substr(F.col("r4.seq"), 0, STAGGER), STAGGER, bc.stagger, "s")
    digit = F.when(F.col("s.rt") == "invalid", 9).otherwise(F.substring("s.tag", 2, 1).cast("int"))
    out = out.withColumn("stagger", digit)
    gone = (F.col("stagger") > 2) | (F.length(rx()) < GATE)
    extra = F.when(F.col("stagger") > 2, 0).otherwise(F.col("stagger"))
    cuts = {
        "b": (max_substr(rx(), 7, 6), bc.b, None), "d": (max_substr(rx(), 0, 6), bc.d, None),
        "a": (max_substr(rx(), 13, F.lit(6) + extra), bc.a, (6, 7, 8)), "c": (max_substr(rx(), F.lit(20) + extra, 7), bc.c, tuple(range(8))),
    }
    for k, (segment, one, lengths) in cuts.items():
        out = match(out, segment, 0, one, f"m_{k}", lengths)
    tag = lambda k, one: F.when(gone, one.tags[0][0] + "00").otherwise(F.col(f"m_{k}.tag"))
    out = out.withColumns({f"code_{k}": tag(k, one) for k, (_, one, _) in cuts.items()})
    exact = F.lit(True)
    for k in cuts:
        exact = exact & (F.col(f"m_{k}.rt") == "correct")
    unclear = F.lit(False)
    for k in cuts:
        unclear = unclear | (F.substring(f"code_{k}", 2, 2) == "00")
    out = out.withColumn("rt", F.when(unclear, "unclear").when(gone | ~exact, "corrected").otherwise("correct"))
    if plate:
        out = match(out, max_substr(F.col("i1.seq"), 0, plate), plate, bc.plate, "m_p")
        lost = F.lit("P000" if variant == "8bp" else "P00")
        out = out.withColumn("code_p", F.when(F.col("m_p.ord") > 0, F.col("m_p.tag")).otherwise(lost))
    long = F.col("stagger") <= 2
    out = out.withColumn("rx", F.when(long, rx()).otherwise(F.lit("N" * 28))).withColumn("qx", F.when(long, F.concat("r2.qual", "r3.qual")).otherwise(F.lit("-" * 28)))
    tail = [F.lit("-"), F.col("code_p")] if plate else []
    seq, qual = ([F.lit("+"), F.col(f"i1.{f}")] if plate else [] for f in ("seq", "qual"))
    name = read_name(F.col("r1.name")) if variant == "8bp" else read_name_with_space(F.col("r1.name"))
    tab = [F.lit("\tBX:Z:" if variant == "8bp" else "BX:Z:")]
    codes = [F.col(f"code_{k}") for k in "acbd"]
    return out.withColumns({
        "header": F.concat(name, *tab, *codes, *tail, F.lit("\tRX:Z:"), F.col("rx"), *seq, F.lit("\tQX:Z:"), F.col("qx"), *qual),
        "code": F.concat(*codes, *tail[1:]),
        "clip": legacy_clip(F.col("code_a")),
    })


def legacy_clip(code_a: Column) -> Column:
    """By the number of the A tag: 17 up to 32, 18 up to 64, else (and for 0) 19."""
    number = F.substring(code_a, 2, 2).cast("int")
    return F.when(number.between(1, 32), 17).when(number.between(33, 64), 18).otherwise(19)
