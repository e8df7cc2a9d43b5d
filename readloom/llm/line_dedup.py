"""Operator 6, line dedup by site-relative frequency.

Pages are grouped by host; for each line, the pages of the host that contain it are divided by all pages of
the host, and lines above a boilerplate ratio are dropped from the host's pages. Every host is judged by the same
rule: more than ``RATIO`` of its pages, and ``LEAST`` pages at least, must contain the line. Pages of equal text
count as one, so that copies of a page aren't boilerplate to each other.

Only 64-bit hashes of the trimmed lines are shuffled (with a seed drawn anew for each run, so that no line can be
made to look like another): once by page, to count equal texts once, and once by line, with partial counts. Of the
lines of a host less than (lines a page)/ratio can exceed the ratio, so the table of boilerplate is small next to
the input; it is written to the shared folder and its size is known before the texts are touched. Up to
``broadcast_bytes`` it goes to all executors and no text is shuffled; beyond, the texts are joined to it by host
with a shuffled hash join, whose hot hosts AQE splits.

The host is a column of the input, or taken from its URLs by ``host_of``.

Defined results: blank lines are never boilerplate and stay; a null text stays null and is no page; pages without
a host (null, or a URL without one) are left as they are; a line repeated within a page counts once; repeated rows
are pages of equal text; a page that loses all its lines stays, with an empty text; texts of any length are taken
whole; further columns, whatever their names, are dropped by ``clean_lines`` and returned untouched by
``dedup_lines``; an empty table gives an empty table.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import fresh, scratch, stored, table

#: A line on more than this share of a host's pages is boilerplate,
RATIO = 0.08
#: if it is on so many pages at least.
LEAST = 3
#: Boilerplate tables up to this size are broadcast.
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _hashes(text: Column, seed: int) -> Column:
    """One hash a line; null for a blank one."""
    def one(line: Column) -> Column:
        bare = F.trim(line, F.lit(" \t\r"))
        return F.when(bare != "", F.xxhash64(F.lit(seed), bare))

    return F.transform(F.split(text, "\n"), one)


def boilerplate(df: DataFrame, ratio: float = RATIO, least: int = LEAST, host_col: str | Column = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(host, hashes of its boilerplate lines)."""
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    pages = df.select(host.alias("host"), F.col(text_col).alias("text")).where("host is not null and text is not null")
    texts = pages.select("host", F.xxhash64(F.lit(seed), "text").alias("page"), F.array_distinct(_hashes(F.col("text"), seed)).alias("lines")).distinct()
    texts = stored(texts.select("host", "lines"), "pages")
    totals = texts.groupBy("host").agg(F.count("*").alias("pages"))
    lines = texts.select("host", F.explode("lines").alias("line")).where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n"))
    return (
        lines.where(F.col("n") >= least)
        .join(totals, "host")
        .where(F.col("n") > F.col("pages") * F.lit(ratio))
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )


def _cleaned(df: DataFrame, ratio: float, least: int, host_col: str | Column, text_col: str, broadcast_bytes: int) -> tuple[DataFrame, str, str]:
    """The input with two more columns, the text that is left and the lines dropped, and their names."""
    seed = secrets.randbits(62)
    at, held, drops, text, dropped = (fresh(df, k) for k in ("host_found", "lines_found", "lines_dropped", "text_left", "n_dropped"))
    with scratch() as keep:
        found = keep(stored(boilerplate(df, ratio, least, host_col, text_col, seed), "boilerplate"))
    found = found.select(F.col("host").alias(at), F.col("lines").alias(held))
    size = found.agg(F.sum(F.size(held) * 8 + F.length(at) + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= broadcast_bytes else found.hint("shuffle_hash")
    joined = df.join(found, (F.col(host_col) if isinstance(host_col, str) else host_col) == F.col(at), "left")
    lines, hashes = F.split(F.col(text_col), "\n"), _hashes(F.col(text_col), seed)
    touched = F.col(held).isNotNull() & F.col(text_col).isNotNull()
    joined = joined.withColumn(drops, F.when(touched, F.transform(hashes, lambda h: F.coalesce(F.array_contains(F.col(held), h), F.lit(False)))))
    some = touched & F.array_contains(F.col(drops), True)
    left = F.filter(lines, lambda _, i: ~F.get(F.col(drops), i))
    joined = joined.withColumn(text, F.when(some, F.concat_ws("\n", left)).otherwise(F.col(text_col)))
    return joined.withColumn(dropped, F.when(some, F.size(F.filter(drops, lambda d: d))).otherwise(F.lit(0)).cast("bigint")), text, dropped


def clean_lines(
    df: DataFrame, ratio: float = RATIO, least: int = LEAST, id_col: str = "doc_id", host_col: str | Column = "source", text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, the text that is left, and the number of lines dropped."""
    df = df.select(F.col(id_col).alias("doc_id"), (F.col(host_col) if isinstance(host_col, str) else host_col).alias("host"), F.col(text_col).alias("text"))
    out, text, dropped = _cleaned(df, ratio, least, "host", "text", broadcast_bytes)
    return out.select("doc_id", F.col(text).alias("text"), F.col(dropped).alias("dropped"))


def dedup_lines(
    df: DataFrame, ratio: float = RATIO, least: int = LEAST, host_col: str | Column = "source", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The input's columns, with the text cleaned and, where it has such a column, n_chars brought up to date."""
    out, text, dropped = _cleaned(df, ratio, least, host_col, text_col, broadcast_bytes)
    new = {text_col: F.col(text)}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(F.col(dropped) > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"))


SQL = f"""
with d as (select row_number() over () as rid, doc_id, source, text from documents),
l as (select rid, source, i, line, trim(line, ' ' || chr(9) || chr(13)) as bare
      from (select rid, source, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from d)),
u as (select source, min(rid) as rid from d where source is not null and text is not null group by source, text),
t as (select source, count(*) as pages from u group by source),
k as (select l.source, l.bare from l join u on l.rid = u.rid join t on l.source = t.source where l.bare <> ''
      group by l.source, l.bare, t.pages having count(distinct l.rid) >= {LEAST} and count(distinct l.rid) > t.pages * {RATIO}::double),
m as (select l.rid, l.i, l.line, k.bare is not null as gone from l left join k on l.source = k.source and l.bare = k.bare),
r as (select rid, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text, count(*) filter (where gone) as dropped from m group by rid)
select d.doc_id, case when d.text is null then null else r.text end as text, coalesce(r.dropped, 0) as dropped from d left join r using (rid)
"""
