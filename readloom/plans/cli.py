"""``python -m readloom demux|cat|paste``."""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from readloom.operators.combine import concatenate, io_stats, paste
from readloom.operators.demux import both_outputs, spread
from readloom.operators.logs import HEADERS, classified, clear_log, log_lines, unclear_log
from readloom.plans.config import checked, describe, load_barcodes, matched_reads, parse_json, patched
from readloom.plans.session import reachable
from readloom.sources.text import read_lines, stdin_lines
from readloom.sources.writers import join_parts, write_json, write_outputs, write_stdout


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom")
    sub = top.add_subparsers(dest="command", required=True)
    demux = sub.add_parser("demux", help="match barcodes and write tagged, clipped reads")
    demux.add_argument("config")
    demux.add_argument("-f", "--force", action="store_true", help="replace an existing output directory")
    demux.add_argument("--replace", action="append", default=[], help="JSON object of JSON pointers and values; may be repeated")
    demux.add_argument("--dry", action="store_true", help="print the plan only")
    demux.add_argument("--logs", action="store_true", help="also write reads per barcode")
    for name in ("cat", "paste"):
        one = sub.add_parser(name)
        one.add_argument("files", nargs="*")
        one.add_argument("-r", dest="range", default="")
        one.add_argument("-m", dest="mask", default="")
        one.add_argument("-o", dest="output")
        one.add_argument("-f", "--force", action="store_true")
        one.add_argument("-v", "--verbose", action="store_true")
        if name == "paste":
            one.add_argument("-d", dest="delimiter", default="")
    return top


def demux(spark: SparkSession, args: argparse.Namespace) -> None:
    out = sys.stdout
    raw = parse_json(Path(args.config).read_text())
    for patch in args.replace:
        raw = patched(raw, patch)
    plan = checked(raw)
    bc = load_barcodes(spark, plan)
    if args.dry:
        print(describe(plan, bc), file=out)
        return
    root = Path(plan.output)
    if root.exists():
        if not args.force:
            raise FileExistsError(f"{root} exists; -f replaces it")
        shutil.rmtree(root)
    matched = matched_reads(spark, plan, bc)
    which = tuple(k for k in ("R1", "R2") if k in plan.outputs)
    if args.logs:  # matched once for the outputs and the logs
        kept = f"{root}/matched"
        matched.write.option("compression", "zstd").parquet(kept)
        matched = spark.read.parquet(kept)
    if which:
        parts = f"{root}/parts"
        write_outputs(both_outputs(spread(matched) if args.logs else matched, bc, which), parts)
        for key in which:
            join_parts(f"{parts}/output={key}", f"{root}/{plan.outputs[key]}")
        shutil.rmtree(parts)
    if args.logs:
        reads = classified(matched, bool(bc.plate))
        for kind, log in (("clear", clear_log), ("unclear", unclear_log)):
            with open(root / f"{kind}BC.log", "w") as f:
                f.write(HEADERS[kind] + "\n")
                write_stdout(log_lines(log(reads), kind), f)
        shutil.rmtree(root / "matched", ignore_errors=True)
    write_json(raw, str(root / "config.json"))


def lines(spark: SparkSession, args: argparse.Namespace) -> None:
    out = sys.stdout
    files = [stdin_lines(spark) if f == "-" else read_lines(spark, f) for f in args.files or ["-"]]
    if args.output and Path(args.output).exists() and not args.force:
        raise FileExistsError(f"{args.output} exists; -f replaces it")
    if args.command == "cat":
        result, order = concatenate(files, args.range, args.mask), ["file_no", "line_no"]
    else:
        result, order = paste(files, args.range, args.mask, args.delimiter), ["line_no"]
    result = result.orderBy(*order)
    if args.output:
        parts = args.output + ".parts"
        gz = args.output.endswith(".gz")
        result.select("value").write.mode("overwrite").option("compression", "gzip" if gz else "none").option("lineSep", "\n").text(parts)
        join_parts(parts, args.output, args.force)
        shutil.rmtree(parts)
    else:
        write_stdout(result, out)
    if args.verbose:
        from functools import reduce

        every = reduce(lambda a, b: a.unionByName(b), (f.select("value") for f in files))
        print(io_stats(every, result).first().asDict(), file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = reachable(spark or SparkSession.builder.appName("readloom").getOrCreate())
    try:
        (demux if args.command == "demux" else lines)(spark, args)
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0
