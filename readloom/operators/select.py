"""Ranges and periodic masks over ordinals."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[int, int | None]


def parse_range(text: str) -> Range:
    """'' all; 'a' from a on; 'a-b' from a to before b; 'a:n' n from a on. What follows the second number is ignored."""
    if text == "":
        return 0, None
    found = re.match(r"(\d+)(?:$|([-:])(\d+))", text)
    if not found:
        raise ValueError(f"can't parse range {text!r}")
    first = int(found[1])
    if found[2] is None:
        return first, None
    return first, int(found[3]) if found[2] == "-" else first + int(found[3])


def in_range(ordinal: Column, span: Range) -> Column:
    """Half open; pushed down to the scan where the ordinal is a column of Parquet."""
    kept = ordinal >= span[0]
    return kept if span[1] is None else kept & (ordinal < span[1])


def select_range(df: DataFrame, text: str, ordinal: str = "line_no") -> DataFrame:
    return df.where(in_range(F.col(ordinal), parse_range(text)))


def parse_mask(text: str) -> str:
    """0s and 1s, 64 at most; the last character stands for the first line of a period. '' keeps everything."""
    if len(text) > 64:
        raise ValueError("mask exceeds 64 bit")
    if not re.fullmatch("[01]*", text):
        raise ValueError(f"can't parse mask {text!r}")
    if text and "1" not in text:
        warnings.warn("empty mask", stacklevel=2)
    return text


def in_mask(ordinal: Column, mask: str, first: int = 0) -> Column:
    """The mask's period starts at ``first``, not at the start of the file."""
    mask = parse_mask(mask)
    if not mask:
        return F.lit(True)
    place = (ordinal - first) % len(mask)
    return F.substring(F.lit(mask), (F.lit(len(mask)) - place).cast("int"), F.lit(1)) == "1"


def select_lines(lines: DataFrame, span: str = "", mask: str = "", ordinal: str = "line_no") -> DataFrame:
    """Both, in a single filter."""
    bounds = parse_range(span)
    return lines.where(in_range(F.col(ordinal), bounds) & in_mask(F.col(ordinal), mask, bounds[0]))
