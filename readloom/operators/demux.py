"""Barcode demultiplexing of read sets (idx, r1, r2, r3, r4[, i1]), each mate a struct(name, seq, plus, qual)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.strings import max_substr, read_name
from readloom.operators.match import match
from readloom.sources.barcodes import BarcodeSet, shipped


@dataclass(frozen=True)
class Barcodes:
    """stagger must be in the order of its tags: entry 1 stands for no extra base, entry 2 for one, and so on."""

    a: BarcodeSet
    b: BarcodeSet
    c: BarcodeSet
    d: BarcodeSet
    stagger: BarcodeSet
    plate: BarcodeSet | None = None

    def sets(self) -> dict[str, BarcodeSet]:
        found = {"A": self.a, "B": self.b, "C": self.c, "D": self.d, "stagger": self.stagger}
        return found | ({"plate": self.plate} if self.plate else {})

    @property
    def total_length(self) -> int:
        """Of the four codes with their spacers."""
        return self.d.max_length + 1 + self.b.max_length + self.a.max_length + 1 + self.c.max_length


def shipped_barcodes(plate: str | None = "plate8") -> Barcodes:
    return Barcodes(*(shipped(k) for k in "ABCD"), shipped("stagger").sorted_by_tag(), shipped(plate) if plate else None)


def rx(reads: str = "") -> Column:
    return F.concat(F.col("r2.seq"), F.col("r3.seq"))


def segments(bc: Barcodes, extra: Column) -> dict[str, tuple[Column, int | Column]]:
    """Each segment and the length it needs; extra: bases before A, from the stagger."""
    text, b, d = rx(), bc.b.max_length, bc.d.max_length
    a_length = F.lit(bc.a.min_length) + extra
    out = {
        "s": (max_substr(F.col("r4.seq"), 0, bc.stagger.max_length), bc.stagger.max_length),
        "d": (max_substr(text, 0, d), d),
        "b": (max_substr(text, b + 1, b), b),
        "a": (max_substr(text, b + d + 1, a_length), a_length),
        "c": (max_substr(text, F.lit(b + d + 2) + a_length, bc.c.max_length), bc.c.max_length),
    }
    if bc.plate:
        out["p"] = (max_substr(F.col("i1.seq"), 0, bc.plate.max_length), bc.plate.max_length)
    return out


def extra_bases(s: str = "s") -> Column:
    """0 unless the stagger was told."""
    return F.when(F.col(f"{s}.ord") > 0, F.col(f"{s}.ord") - 1).otherwise(F.lit(0))


def demultiplex(reads: DataFrame, bc: Barcodes, way: str = "auto", max_ed: int | None = None) -> DataFrame:
    """Adds the matches s, a, b, c, d (and p), and the flags any_invalid and any_unclear (in place of columns with
    these names). The stagger is matched first: it moves A and C. way: see ``match``; 'inline' has no join and no
    state."""
    out = match(reads, *segments(bc, F.lit(0))["s"], bc.stagger, "s", way=way, max_ed=max_ed)
    parts = segments(bc, extra_bases())
    lengths = tuple(range(bc.a.min_length, bc.a.min_length + len(bc.stagger.entries)))
    for k, one in (("a", bc.a), ("b", bc.b), ("c", bc.c), ("d", bc.d), *((("p", bc.plate),) if bc.plate else ())):
        out = match(out, *parts[k], one, k, lengths if k == "a" else None, way, max_ed)
    kinds = [F.col(f"{k}.rt") for k in ("s", "a", "b", "c", "d", *(("p",) if bc.plate else ()))]

    def anywhere(rt: str) -> Column:
        first, *more = (kind == rt for kind in kinds)
        for other in more:
            first = first | other
        return first

    return out.withColumns({"any_invalid": anywhere("invalid"), "any_unclear": anywhere("unclear")})


def bx_code(plate: bool) -> Column:
    tags = [F.col(f"{k}.tag") for k in "acbd"]
    return F.concat(*tags, *((F.lit("-"), F.col("p.tag")) if plate else ()))


def header(plate: bool) -> Column:
    """name, BX, RX and QX; the tags in the order A, C, B, D."""
    seq, qual = ([F.col(f"r2.{f}"), F.col(f"r3.{f}"), *((F.lit("+"), F.col(f"i1.{f}")) if plate else ())] for f in ("seq", "qual"))
    return F.concat(read_name(F.col("r1.name")), F.lit("\tBX:Z:"), bx_code(plate), F.lit("\tRX:Z:"), *seq, F.lit("\tQX:Z:"), *qual)


def clip_size(bc: Barcodes) -> Column:
    """stagger, a spacer, and A: its code's length, the longest if it is unclear, nothing if it is invalid."""
    lengths = F.split(F.lit(" ".join(str(len(c)) for c in bc.a.codes)), " ")
    a = F.when(F.col("a.rt") == "unclear", bc.a.max_length).when(F.col("a.rt") == "invalid", 0).otherwise(F.element_at(lengths, F.greatest(F.col("a.ord"), F.lit(1))).cast("int"))
    return F.lit(bc.stagger.max_length + 1) + a


def first_output(matched: DataFrame, bc: Barcodes) -> DataFrame:
    """(idx, name, seq, plus, qual): R1 with the composed header."""
    return matched.select("idx", header(bool(bc.plate)).alias("name"), *(F.col(f"r1.{f}").alias(f) for f in ("seq", "plus", "qual")))


def second_output(matched: DataFrame, bc: Barcodes) -> DataFrame:
    """(idx, name, seq, plus, qual): R4, clipped, with the same header."""
    clip = clip_size(bc)
    return matched.select(
        "idx", header(bool(bc.plate)).alias("name"), max_substr(F.col("r4.seq"), clip).alias("seq"), F.col("r4.plus").alias("plus"),
        max_substr(F.col("r4.qual"), clip).alias("qual"),
    )


#: Records of a chunk, as a power of two: a chunk is matched and written by one task.
CHUNK_BITS = 16


def spread(reads: DataFrame, partitions: int | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """The reads with a column chunk, 2**bits neighbouring records to a chunk, whole chunks dealt to partitions in
    turn: the one exchange between reading and writing, whatever wrote or split the input, and needing no counts."""
    partitions = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.shiftright("idx", bits)
    return reads.withColumn("chunk", chunk).repartitionById(partitions, F.pmod(F.col("chunk"), F.lit(partitions)).cast("int"))


def both_outputs(matched: DataFrame, bc: Barcodes, which: tuple[str, ...] = ("R1", "R2")) -> DataFrame:
    """(chunk, idx, output, value): for each read the lines of its outputs, from one match and one header."""
    clip, head = clip_size(bc), matched.select("*", header(bool(bc.plate)).alias("header"))
    lines = {
        "R1": F.concat_ws("\n", "header", "r1.seq", "r1.plus", "r1.qual"),
        "R2": F.concat_ws("\n", F.col("header"), max_substr(F.col("r4.seq"), clip), F.col("r4.plus"), max_substr(F.col("r4.qual"), clip)),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("output"), lines[k].alias("value")) for k in which)))
    return head.select("chunk", "idx", each.alias("o")).select("chunk", "idx", "o.output", "o.value")


def barcode_stats(bc: Barcodes) -> list[tuple[str, int, int, int]]:
    """(set, entries, least and greatest code length)."""
    return [(k, len(s.entries), s.min_length, s.max_length) for k, s in sorted(bc.sets().items())]
