"""Barcode sets: ordered (tag, code) entries with a tag for what can't be told."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from readloom.sources.barcode_sets import SHIPPED, UNCLEAR


@dataclass(frozen=True)
class BarcodeSet:
    name: str
    entries: tuple[tuple[str, str], ...]
    unclear: str

    @property
    def tags(self) -> list[str]:
        return [t for t, _ in self.entries]

    @property
    def codes(self) -> list[str]:
        return [c for _, c in self.entries]

    @property
    def min_length(self) -> int:
        """1,000,000 for an empty set, so that any length is smaller."""
        return min(map(len, self.codes), default=1_000_000)

    @property
    def max_length(self) -> int:
        return max(map(len, self.codes), default=0)

    def sorted_by_tag(self) -> BarcodeSet:
        return replace(self, entries=tuple(sorted(self.entries)))

    def with_letter(self, letter: str) -> BarcodeSet:
        """The first character of every tag, and of the unclear one, replaced."""
        return replace(self, entries=tuple((letter + t[1:], c) for t, c in self.entries), unclear=letter + self.unclear[1:])

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, i, t, c) for i, (t, c) in enumerate(self.entries, 1)]
        return spark.createDataFrame(rows, "set string, ord int, tag string, code string")


def guessed_unclear(tag: str) -> str:
    """The first letter of a tag and zeros, as long as the tag."""
    return tag[:1] + "0" * (len(tag) - 1)


def make_set(name: str, entries: list[tuple[str, str]], unclear: str = "") -> BarcodeSet:
    """Tags and codes must be unique: with two equal codes a read could never be told."""
    for what, values in (("tag", [t for t, _ in entries]), ("code", [c for _, c in entries])):
        if len(set(values)) < len(values):
            raise ValueError(f"{name}: a {what} occurs twice")
    return BarcodeSet(name, tuple(entries), unclear or (guessed_unclear(entries[0][0]) if entries else ""))


def shipped(name: str) -> BarcodeSet:
    return make_set(name, SHIPPED[name], UNCLEAR[name])


def read_set(spark: SparkSession, path: str, name: str = "", unclear: str = "") -> BarcodeSet:
    """A file of ``tag<space or tab>code`` lines; blank lines are skipped. These are small, so the driver reads them."""
    lines = [r.value for r in spark.read.option("lineSep", "\n").text(path).collect() if r.value]
    if not lines:
        raise ValueError(f"{path}: is empty")
    entries = []
    for line in lines:
        found = re.match(r"([^ \t]*)[ \t](.*)$", line, re.S)
        if not found:
            raise ValueError(f"{path}: a line without a separator")
        entries.append((found[1], found[2]))
    return make_set(name or path, entries, unclear)


def read_fixed_width(spark: SparkSession, path: str, tag_width: int, name: str = "") -> BarcodeSet:
    """The older form: a tag of fixed width, one separator, the code; of equal codes the first counts."""
    entries: dict[str, str] = {}
    for r in spark.read.option("lineSep", "\n").text(path).collect():
        if r.value:
            entries.setdefault(r.value[tag_width + 1 :], r.value[:tag_width])
    return make_set(name or path, [(t, c) for c, t in entries.items()])
