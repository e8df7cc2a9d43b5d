"""Queries whose work goes through files: each writes files from the synthetic tables, reads them back by the
engine's sources or runs the command line over them, and returns what came out. The SQL never touches a file."""

from __future__ import annotations

import contextlib
import io
import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import max_substr
from readloom.operators import demux, match
from readloom.plans import cli, config
from readloom.plans.session import work_dir
from readloom.plans.sql import CLIP, HEADER, JOINED, LOGGED
from readloom.plans.synthetic import MATCHES, READS, barcode_values, read_sets
from readloom.sources.barcodes import read_fixed_width, read_set, shipped
from readloom.sources.fastq import read_mates
from readloom.sources.text import read_fastq, read_lines, stdin_lines
from readloom.sources.writers import join_parts, record_lines, write_ordered, write_stdout

#: Reads that go through files, and those of the first lane.
READ_COUNT, FIRST_LANE = 1500, 400
#: All mates of a read, in the order of the columns of the SQL.
_MATES = ("r1", "r2", "r3", "r4", "i1")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(F.col("o_orderkey").alias("idx"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return read_sets(spark, _orders(spark, sf).where(F.col("o_orderkey") < READ_COUNT))


def _file(df: DataFrame, path: str, compression: str | None) -> str:
    """One file of the lines in the order of idx."""
    write_ordered(df, f"{path}.parts", compression=compression)
    join_parts(f"{path}.parts", path)
    return path


def _line_file(compression: str | None) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return read_lines(spark, _file(_lines(spark, sf), f"{work_dir(spark)}/lines" + (".gz" if compression else ""), compression))

    return query


def _mate_files(spark: SparkSession, sf: str, folder: str, lanes: bool) -> dict[str, list[str]]:
    sets = _reads(spark, sf)
    parts = [sets.where(F.col("idx") < FIRST_LANE), sets.where(F.col("idx") >= FIRST_LANE)] if lanes else [sets]
    one = lambda df, m: record_lines(df.select("idx", f"{m}.*"))
    return {m: [_file(one(df, m), f"{folder}/{m}_{k}.fastq.gz", "gzip" if m != "r3" else None) for k, df in enumerate(parts)] for m in _MATES}


def _fastq(spark: SparkSession, sf: str) -> DataFrame:
    return read_fastq(spark, _file(record_lines(_reads(spark, sf).select("idx", "r1.*")), f"{work_dir(spark)}/r1.fastq.gz", "gzip"))


def _mates(span: str) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = read_mates(spark, span, **_mate_files(spark, sf, work_dir(spark), True))
        return out.select("lane", "idx", "r1.name", F.col("r1.seq").alias("s1"), F.col("r2.qual").alias("q2"), F.col("r3.plus").alias("p3"), F.col("r4.seq").alias("s4"), F.col("i1.seq").alias("si"))

    return query


def _barcode_file(folder: str, name: str, separator: str = "\t") -> str:
    path = Path(folder) / f"{name}.txt"
    path.write_text("".join(f"{t}{separator}{c}\n" for t, c in shipped(name).entries))
    return str(path)


def _set_file(fixed: bool) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        folder, rows = work_dir(spark), []
        for name in ("A", "plate8"):
            path = _barcode_file(folder, name, " " if fixed else "\t")
            found = read_fixed_width(spark, path, len(shipped(name).tags[0])) if fixed else read_set(spark, path)
            rows += [(name, i, t, c) for i, (t, c) in enumerate(found.entries, 1)]
        return spark.createDataFrame(rows, "set_name string, ord bigint, tag string, code string")

    return query


def _stdin(spark: SparkSession, sf: str) -> DataFrame:
    return stdin_lines(spark, (f"line {i}" + "\n" * (i < 999) for i in range(1000)))


def _stdout(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/stdout"
    with open(path, "w", encoding="utf-8", newline="\n") as out:  # standard output, sent to a file
        n = write_stdout(_lines(spark, sf).orderBy("idx").select("value"), out)
    return read_lines(spark, path).withColumn("n", F.lit(n).cast("bigint"))


def _leaves(value, at: str = "") -> list[tuple[str, str]]:
    if isinstance(value, (dict, list)):
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        return [x for k, v in pairs for x in _leaves(v, f"{at}/{k}")]
    return [(at, json.dumps(value))]


_JSON = '{ // first\n "a": {"b": 1, "c": "x // y"}, /* then\n */ "l": [1, 2, null], "~": "/* no */" }'


def _json(patch: str | None) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        value = config.parse_json(_JSON)
        return spark.createDataFrame(_leaves(config.patched(value, patch) if patch else value), "pointer string, value string")

    return query


def _home(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(p, config.home(p)) for p in ("~/x/y", "/x/~/y", "x", "~x")], "path string, full string")


def _default_length(spark: SparkSession, sf: str) -> DataFrame:
    one = shipped("D")  # no lengths given: all segments are as long as the longest code
    out = match.match(_reads(spark, sf), max_substr(demux.rx(), 0, one.max_length), one.max_length, one, "d")
    return out.select("idx", "d.tag", F.col("d.ord").cast("bigint").alias("ord"), F.col("d.ed").cast("bigint").alias("ed"), "d.rt")


def _configured(spark: SparkSession, sf: str, lanes: bool = False) -> tuple[str, dict, list[str]]:
    folder = work_dir(spark)
    for name in ("A", "B", "C", "D", "stagger", "plate8"):
        _barcode_file(folder, name)
    mates = _mate_files(spark, sf, folder, lanes)
    raw = {
        "range": "", "pool_threads": -1, "output": {"root": f"{folder}/out", "clipping": True, "R1": "R1.fastq.gz", "R2": "R2.fastq.gz"},
        "barcodes": {
            "root": folder, **{k: {"file": f"{k}.txt", "unclear_tag": f"{k}00"} for k in "ABCD"}, "plate": {"file": "plate8.txt", "unclear_tag": shipped("plate8").unclear},
            "stagger": {"file": "stagger.txt", "unclear_tag": shipped("stagger").unclear, "sort_by_tag": True},
        },
        "reads": {m.upper(): p if lanes else p[0] for m, p in mates.items()},
    }
    Path(folder, "run.json").write_text("// a run\n" + json.dumps(raw))
    return folder, raw, ["demux", f"{folder}/run.json"]


def _run(spark: SparkSession, args: list[str]) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = cli.main(args, spark)
    return code, out.getvalue(), err.getvalue()


def _demux_files(lanes: bool) -> Callable:
    """The whole program over whole files: tagged R1, tagged and clipped R2, and both logs."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        folder, _, args = _configured(spark, sf, lanes)
        code, _, err = _run(spark, [*args, "--logs"])
        if code:
            raise RuntimeError(err)
        both = [read_fastq(spark, f"{folder}/out/{k}.fastq.gz").select(F.lit(k).alias("output"), F.col("idx").alias("no"), "name", "seq", "qual") for k in ("R1", "R2")]
        log = lambda k: read_lines(spark, f"{folder}/out/{k}BC.log").where("line_no > 0").select(F.lit(k).alias("output"), (F.col("line_no") - 1).alias("no"), F.col("value").alias("name"), F.lit("").alias("seq"), F.lit("").alias("qual"))
        return both[0].union(both[1]).union(log("clear")).union(log("unclear"))

    return query


def _guards(spark: SparkSession, sf: str) -> DataFrame:
    """What the command line answers: a dry run writes nothing, an existing output isn't replaced unless told, and
    the configuration that was used lies beside the outputs."""
    folder, raw, args = _configured(spark, sf)
    patch = json.dumps({"/range": "10-60", "/output/R2": ""})
    rows = []
    code, out, _ = _run(spark, [*args, "--replace", patch, "--dry"])
    rows.append(("dry", f"{code} {out.split(chr(10))[0]} {os.path.exists(raw['output']['root'])}"))
    rows.append(("first", str(_run(spark, [*args, "--replace", patch])[0])))
    code, _, err = _run(spark, [*args, "--replace", patch])
    rows.append(("again", f"{code} {'exists' in err}"))
    rows.append(("forced", str(_run(spark, [*args, "--replace", patch, "-f"])[0])))
    kept = json.loads(Path(raw["output"]["root"], "config.json").read_text())
    rows.append(("snapshot", f"{kept['range']} [{kept['output']['R2']}] {kept['reads'] == raw['reads']}"))
    rows.append(("files", " ".join(sorted(os.listdir(raw["output"]["root"])))))
    rows.append(("records", str(read_fastq(spark, f"{raw['output']['root']}/R1.fastq.gz").count())))
    return spark.createDataFrame(rows, "what string, answer string")


_LINES_SQL = "select row_number() over (order by o_orderkey) - 1 as line_no, concat_ws('|', o_orderkey, o_orderpriority) as value from orders"
_SOME = f"(select * from orders where o_orderkey < {READ_COUNT})"


def _with(ctes: str, query: str) -> str:
    return f"with {ctes.format(orders=_SOME)} {query}"


def _lane_sql(condition: str = "true") -> str:
    return _with(
        READS + f""", placed as (select *, case when idx < {FIRST_LANE} then 0 else 1 end as lane from reads),
        ranked as (select *, row_number() over (partition by lane order by idx) - 1 as k from placed)""",
        f"select lane, lane * 1099511627776 + k as idx, name, s1, q2, '+' as p3, s4, si from ranked where {condition}",
    )


def _demux_sql() -> str:
    clear = "(select code, count(*) filter (where rt = 'correct') as n, count(*) filter (where rt = 'corrected') as m from logged where rt <> 'unclear' group by code)"
    unclear = "(select code, count(*) as n from logged where rt = 'unclear' group by code)"
    return _with(MATCHES + f", {LOGGED}", f"""
select 'R1' as output, row_number() over (order by r.idx) - 1 as no, {HEADER} as name, s1 as seq, q1 as qual {JOINED}
union all select 'R2', row_number() over (order by r.idx) - 1, {HEADER}, substring(s4, {CLIP} + 1), substring(q4, {CLIP} + 1) {JOINED}
union all select 'clear', row_number() over (order by code) - 1, concat(code, chr(9), n, chr(9), m), '', '' from {clear}
union all select 'unclear', row_number() over (order by code) - 1, concat(code, chr(9), n), '', '' from {unclear}""")


def _values(rows: list[tuple[str, str]], names: str) -> str:
    return "select * from (values " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + f") as t({names})"


_SETS_SQL = f"with bc as ({barcode_values()}) select set_name, cast(ord as bigint) as ord, tag, code from bc where set_name in ('A', 'plate8')"

#: name: (Spark, SQL)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "file_gzip_lines": (_line_file("gzip"), _LINES_SQL),
    "file_plain_lines": (_line_file(None), _LINES_SQL),
    "file_fastq_records": (_fastq, _with(READS, "select row_number() over (order by idx) - 1 as idx, name, s1 as seq, '+' as plus, q1 as qual from reads")),
    "file_mates_of_two_lanes": (_mates(""), _lane_sql()),
    "file_mates_range": (_mates("100-300"), _lane_sql("k >= 100 and k < 300")),
    "file_barcodes": (_set_file(False), _SETS_SQL),
    "file_barcodes_fixed_width": (_set_file(True), _SETS_SQL),
    "stdin_lines": (_stdin, "select i as line_no, concat('line ', i) as value from range(1000) as t(i)"),
    "stdout_lines": (_stdout, f"select *, count(*) over () as n from ({_LINES_SQL})"),
    "config_json": (_json(None), _values([("/a/b", "1"), ("/a/c", '"x // y"'), ("/l/0", "1"), ("/l/1", "2"), ("/l/2", "null"), ("/~", '"/* no */"')], "pointer, value")),
    "config_patches": (
        _json('{"/a/b": 7, "/l/-": 3, "/l/0": "z", "/n/m": true, "/~0": ""}'),
        _values([("/a/b", "7"), ("/a/c", '"x // y"'), ("/l/0", '"z"'), ("/l/1", "2"), ("/l/2", "null"), ("/l/3", "3"), ("/~", '""'), ("/n/m", "true")], "pointer, value"),
    ),
    "config_home": (_home, _values([("~/x/y", os.path.expanduser("~") + "/x/y"), ("/x/~/y", "/x/~/y"), ("x", "x"), ("~x", "~x")], "path, \"full\"")),
    "match_default_length": (_default_length, _with(MATCHES, "select * from d")),
    "demux_files": (_demux_files(False), _demux_sql()),
    "demux_files_of_two_lanes": (_demux_files(True), _demux_sql()),
    "demux_guards": (
        _guards,
        _values([("dry", "0 range: 10-60 False"), ("first", "0"), ("again", "1 True"), ("forced", "0"), ("snapshot", "10-60 [] True"), ("files", "R1.fastq.gz config.json"), ("records", "50")], "what, answer"),
    ),
}
