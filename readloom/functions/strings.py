"""String functions of reads: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_substr(text: Column, pos: int | Column, count: int | Column | None = None) -> Column:
    """From a 0-based position on, at most ``count`` characters; what lies beyond the end is left out."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    count = F.lit(2**31 - 1) if count is None else F.lit(count) if isinstance(count, int) else count
    return F.substring(text, pos + 1, count)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bounded_edit_distance(a: Column, b: Column, bound: int) -> Column:
    """The Levenshtein distance where it is below the bound, else the bound."""
    near = F.levenshtein(a, b, bound - 1) if bound > 0 else F.lit(-1)
    return F.when(near < 0, F.lit(bound)).otherwise(near)


def read_name(name: Column) -> Column:
    """Up to the first space or tab; all of it where there is none."""
    return F.regexp_extract(name, "^[^ \t]*", 0)


def read_name_with_space(name: Column) -> Column:
    """The older form: up to and with the first space; nothing where there is none."""
    return F.substring(name, F.lit(1), F.instr(name, " "))
