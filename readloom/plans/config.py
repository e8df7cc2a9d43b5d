"""The JSON configuration of a demultiplexing run: comments allowed, patched by JSON pointers, checked once."""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from readloom.operators.demux import Barcodes
from readloom.operators.select import Range, parse_range
from readloom.sources.barcodes import BarcodeSet, read_set

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def parse_json(text: str) -> dict:
    """JSON with // and /* */ comments."""
    return json.loads(_TOKEN.sub(lambda m: m[0] if m[0][0] == '"' else " ", text))


def patched(config: dict, patch: str | dict) -> dict:
    """The configuration with the values at JSON pointers replaced; missing keys are made. Later patches win."""
    out = copy.deepcopy(config)
    for pointer, value in (json.loads(patch) if isinstance(patch, str) else patch).items():
        if pointer and not pointer.startswith("/"):
            raise ValueError(f"not a JSON pointer: {pointer!r}")
        keys = [k.replace("~1", "/").replace("~0", "~") for k in pointer.split("/")[1:]]
        if not keys:
            out = copy.deepcopy(value)
            continue
        at = out
        for k, after in zip(keys[:-1], keys[1:]):
            if isinstance(at, list):
                at = at[int(k)]
            else:
                at = at.setdefault(k, [] if after == "-" else {})
        last = keys[-1]
        if not isinstance(at, list):
            at[last] = value
        elif last == "-":
            at.append(value)
        else:
            at[int(last)] = value
    return out


def home(path: str) -> str:
    return os.path.expanduser(path) if path.startswith("~/") else path


def _under(root: str, name: str) -> str:
    return os.path.join(home(root), name) if root and not os.path.isabs(home(name)) and "://" not in name else home(name)


@dataclass(frozen=True)
class Plan:
    """A checked configuration."""

    raw: dict
    span: Range
    reads: dict[str, list[str]]
    barcode_files: dict[str, str]
    output: str
    outputs: dict[str, str]

    @property
    def has_plate(self) -> bool:
        return "i1" in self.reads and "plate" in self.barcode_files

    @property
    def range_text(self) -> str:
        first, stop = self.span
        return f"{first}" if stop is None else f"{first}-{stop}"


def checked(raw: dict) -> Plan:
    for key in ("range", "barcodes", "reads", "output"):
        if key not in raw:
            raise ValueError(f"configuration lacks {key!r}")
    span = parse_range(raw["range"])
    if span[1] is not None and span[0] >= span[1]:
        raise ValueError("invalid range")
    bar, reads, out = raw["barcodes"], raw["reads"], raw["output"]
    for key in ("A", "B", "C", "D", "stagger"):
        if key not in bar:
            raise ValueError(f"configuration lacks barcodes/{key}")
    for key in ("R1", "R2", "R3", "R4"):
        if not reads.get(key):
            raise ValueError(f"configuration lacks reads/{key}")
    lanes = lambda x: [x] if isinstance(x, str) else list(x)
    mates = {k.lower(): [_under(reads.get("root", ""), p) for p in lanes(reads[k])] for k in ("R1", "R2", "R3", "R4", "I1") if reads.get(k)}
    if len({len(p) for p in mates.values()}) > 1:
        raise ValueError("all mates need as many files as there are lanes")
    files = {k: _under(bar.get("root", ""), bar[k]["file"]) for k in ("A", "B", "C", "D", "stagger", "plate") if bar.get(k, {}).get("file")}
    return Plan(raw, span, mates, files, home(out.get("root", "")), {k: out[k] for k in ("R1", "R2") if out.get(k)})


def load_barcodes(spark: SparkSession, plan: Plan) -> Barcodes:
    def one(key: str) -> BarcodeSet:
        options = plan.raw["barcodes"][key]
        found = read_set(spark, plan.barcode_files[key], key, options.get("unclear_tag", ""))
        if options.get("code_letter"):
            found = found.with_letter(options["code_letter"])
        return found.sorted_by_tag() if options.get("sort_by_tag") else found

    return Barcodes(one("A"), one("B"), one("C"), one("D"), one("stagger"), one("plate") if plan.has_plate else None)


def describe(plan: Plan, bc: Barcodes) -> str:
    """What a dry run prints."""
    lines = [f"range: {plan.range_text}"]
    lines += [f"barcodes {k}: {len(s.entries)} codes of {s.min_length} to {s.max_length}, unclear {s.unclear}, from {plan.barcode_files[k]}" for k, s in bc.sets().items()]
    lines += [f"reads {k}: {', '.join(p)}" for k, p in plan.reads.items()]
    lines += [f"stagger from r4; code length {bc.total_length}", f"output: {plan.output}", *(f"  {k}: {v}" for k, v in plan.outputs.items())]
    lines.append("R2 clipped" if "R2" in plan.outputs else "no R2 output")
    return "\n".join(lines)


def matched_reads(spark: SparkSession, plan: Plan, bc: Barcodes) -> DataFrame:
    """Read lane by lane, dealt out in chunks, and matched."""
    from readloom.operators.demux import demultiplex, spread
    from readloom.sources.fastq import read_mates

    mates = {k: v for k, v in plan.reads.items() if k != "i1" or plan.has_plate}
    return demultiplex(spread(read_mates(spark, plan.range_text, **mates)), bc)
