"""The engine's queries over the synthetic tables, and each of them as SQL by another way (brute force)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import bounded_edit_distance, edit_distance, max_substr, read_name, read_name_with_space
from readloom.operators import combine, demux, legacy, logs, match, select
from readloom.plans import file_queries
from readloom.plans.sql import BARE_HEADER as _BARE_HEADER
from readloom.plans.sql import CLASS as _CLASS
from readloom.plans.sql import CLIP as _CLIP
from readloom.plans.sql import HEADER as _HEADER
from readloom.plans.sql import JOINED as _JOINED
from readloom.plans.sql import LOGGED as _LOGGED
from readloom.plans.sql import NAME as _NAME
from readloom.plans.synthetic import MATCHES, READS, barcode_values, flat_reads, read_sets
from readloom.sources.barcodes import guessed_unclear, make_set, shipped
from readloom.sources.text import characters, lines_of, records

_BC = demux.shipped_barcodes()
_BARE = demux.shipped_barcodes(None)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders")


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(F.col("o_orderkey").alias("line_no"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus").alias("value"))


def customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("line_no"), F.concat_ws("|", "c_name", "c_mktsegment").alias("value"))


def part_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_brand").alias("value"))


ORDER_LINES = "select o_orderkey as line_no, concat_ws('|', o_orderkey, o_orderpriority, o_orderstatus) as value from orders"
CUSTOMER_LINES = "select c_custkey as line_no, concat_ws('|', c_name, c_mktsegment) as value from customer"
PART_LINES = "select p_partkey as line_no, p_brand as value from part"
LINES = f"o as ({ORDER_LINES}), c as ({CUSTOMER_LINES}), p as ({PART_LINES})"


def reads(spark: SparkSession, sf: str, plate: bool = True) -> DataFrame:
    return read_sets(spark, _orders(spark, sf), plate)


def matched(spark: SparkSession, sf: str, plate: bool = True) -> DataFrame:
    return demux.demultiplex(reads(spark, sf, plate), _BC if plate else _BARE)


def _mate(flat: DataFrame, k: str) -> DataFrame:
    return flat.select("idx", "name", F.col(f"s{k}").alias("seq"), F.lit("+").alias("plus"), F.col(f"q{k}").alias("qual"))


def _match(k: str) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        m = matched(spark, sf)
        return m.select("idx", f"{k}.tag", F.col(f"{k}.ord").cast("bigint").alias("ord"), F.col(f"{k}.ed").cast("bigint").alias("ed"), f"{k}.rt")

    return query


def _match_plate7(spark: SparkSession, sf: str) -> DataFrame:
    one = shipped("plate7")
    out = match.match(reads(spark, sf), max_substr(F.col("i1.seq"), 0, one.max_length), one.max_length, one, "p")
    return out.select("idx", "p.tag", F.col("p.ord").cast("bigint").alias("ord"), F.col("p.ed").cast("bigint").alias("ed"), "p.rt")


def _match_distinct(spark: SparkSession, sf: str) -> DataFrame:
    one = shipped("D")
    lines = _table(spark, sf, "lineitem").select(F.translate(F.md5(F.concat(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    out = match.match(lines, max_substr(F.col("seq"), 0, 6), 6, one, "d", way="distinct")
    return out.groupBy("d.rt").agg(F.count("*").alias("n"), F.sum(F.col("d.ed").cast("bigint")).alias("ed"), F.countDistinct("d.tag").alias("tags"))


def _exact_then_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    found = match.exact_then_fuzzy("substring(concat(r2.seq, r3.seq), 1, 6)", shipped("D"))
    return reads(spark, sf).where(F.length(demux.rx()) >= 6).select("idx", found.alias("m")).select("idx", "m.tag", "m.exact")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    flat = flat_reads(spark, _orders(spark, sf))
    lines = flat.select("idx", F.posexplode(F.array("name", "s1", F.lit("+"), "q1")).alias("k", "value")).select((F.col("idx") * 4 + F.col("k")).alias("line_no"), "value")
    return lines


def _legacy(variant: str) -> Callable:
    plate = {"8bp": "plate8", "7bp": "plate7", "noplate": None}[variant]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = legacy.legacy(reads(spark, sf, bool(plate)), demux.shipped_barcodes(plate), variant)
        return out.select("idx", "header", "code", "rt")

    return query


def _legacy_clip(spark: SparkSession, sf: str) -> DataFrame:
    out = legacy.legacy(reads(spark, sf), _BC)
    return out.select("idx", F.col("clip").cast("bigint").alias("clip"), max_substr(F.col("r4.seq"), F.col("clip")).alias("seq"))


def _consistency(spark: SparkSession, sf: str) -> DataFrame:
    flat = flat_reads(spark, _orders(spark, sf))
    return combine.mate_counts(r1=_mate(flat, "1"), r2=_mate(flat, "2"), r3=_mate(flat, "3"), r4=_mate(flat, "4"), i1=_mate(flat.where("idx < 1000"), "i"))


def _zip(spark: SparkSession, sf: str) -> DataFrame:
    flat = flat_reads(spark, _orders(spark, sf))
    out = combine.zip_mates(r1=_mate(flat, "1"), r2=_mate(flat, "2"), r4=_mate(flat.where("idx % 3 < 2"), "4"))
    return out.select("idx", "r1.name", F.col("r1.seq").alias("s1"), F.col("r2.qual").alias("q2"), F.col("r4.seq").alias("s4"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    out = match.match(reads(spark, sf), *demux.segments(_BC, F.lit(0))["s"], _BC.stagger, "s")
    parts = demux.segments(_BC, demux.extra_bases())
    return out.select("idx", *(parts[k][0].alias(f"seg_{k}") for k in "sabcdp"))


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer")
    return c.select("c_custkey", edit_distance(F.col("c_name"), F.col("c_mktsegment")).cast("bigint").alias("ed"), bounded_edit_distance(F.col("c_name"), F.col("c_mktsegment"), 17).cast("bigint").alias("near"))


def _outputs(which: str) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return (demux.first_output if which == "r1" else demux.second_output)(matched(spark, sf), _BC)

    return query


def _sets(change: Callable) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        from functools import reduce

        return reduce(DataFrame.union, (change(shipped(k)).to_df(spark) for k in ("A", "stagger", "plate8"))).select("set", F.col("ord").cast("bigint").alias("ord"), "tag", "code")

    return query


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(demux.barcode_stats(_BC), "set string, n bigint, min_length bigint, max_length bigint")


def _guess(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, make_set(k, list(shipped(k).entries)).unclear, guessed_unclear(shipped(k).tags[0])) for k in ("A", "B", "C", "D", "plate8")], "set string, unclear string, guessed string")


def _total_length(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_BC.total_length,)], "total bigint")


def _with(ctes: str, query: str) -> str:
    return f"with {ctes.format(orders='orders')} {query}"


def _legacy_sql(variant: str) -> str:
    """One record at a time, with every code compared to every segment."""
    from readloom.plans.synthetic import match_ctes

    plate, size = {"8bp": ("plate8", 8), "7bp": ("plate7", 7), "noplate": (None, 0)}[variant]
    ctes = ",".join([
        READS, match_ctes("ls", "substring(s4, 1, 10)", "10", "stagger"),
        " lm as (select r.*, concat(s2, s3) as rx, cast(case when ls.rt = 'invalid' then 9 else cast(substring(ls.tag, 2, 1) as int) end as int) as st from reads r join ls on ls.idx = r.idx)",
        " lg as (select lm.*, case when st > 2 then 0 else st end as ex, st > 2 or length(rx) < 22 as gone from lm)",
        match_ctes("ld", "substring(rx, 1, 6)", "0", "D", "lg"), match_ctes("lb", "substring(rx, 8, 6)", "0", "B", "lg"),
        match_ctes("la", "substring(rx, 14, 6 + ex)", "0", "A", "lg"), match_ctes("lc", "substring(rx, 21 + ex, 7)", "0", "C", "lg"),
        *([match_ctes("lp", f"substring(si, 1, {size})", str(size), plate, "lg")] if plate else []),
    ])
    tags = {k: f"case when gone then '{k.upper()}00' else l{k}.tag end" for k in "abcd"}
    lost = "P000" if variant == "8bp" else "P00"
    tail = f", '-', case when lp.ord > 0 then lp.tag else '{lost}' end" if plate else ""
    code_tail = tail.replace(", '-'", "")
    name = _NAME if variant == "8bp" else "substring(name, 1, instr(name, ' '))"
    tab = "chr(9), 'BX:Z:'" if variant == "8bp" else "'BX:Z:'"
    seq, qual = (f", '+', {x}" if plate else "" for x in ("si", "qi"))
    body = f"{tags['a']}, {tags['c']}, {tags['b']}, {tags['d']}"
    return _with(ctes, f"""
select lg.idx, concat({name}, {tab}, {body}{tail}, chr(9), 'RX:Z:', case when st > 2 then repeat('N', 28) else rx end{seq}, chr(9), 'QX:Z:', case when st > 2 then repeat('-', 28) else concat(q2, q3) end{qual}) as header,
  concat({body}{code_tail}) as code,
  case when gone or least(la.ord, lb.ord, lc.ord, ld.ord) = 0 then 'unclear' when greatest(la.ed, lb.ed, lc.ed, ld.ed) > 0 then 'corrected' else 'correct' end as rt,
  s4, {tags['a']} as tag_a
from lg join la on la.idx = lg.idx join lb on lb.idx = lg.idx join lc on lc.idx = lg.idx join ld on ld.idx = lg.idx {'join lp on lp.idx = lg.idx' if plate else ''}""")


def _set_sql(tag: str = "tag", code: str = "code", order: str = "ord") -> str:
    listed = "case when set_name = 'stagger' then 4 - ord else ord end"  # as in its file: the last tag first
    return f"with bc as ({barcode_values()}), f as (select set_name as \"set\", cast({listed} as bigint) as ord, tag, code from bc where set_name in ('A', 'stagger', 'plate8')) select \"set\", {order} as ord, {tag} as tag, code from f"


#: name: (Spark, SQL)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "line_range": (lambda s, d: select.select_range(order_lines(s, d), "100-350"), f"select * from ({ORDER_LINES}) where line_no >= 100 and line_no < 350"),
    "line_range_count": (lambda s, d: select.select_range(order_lines(s, d), "200:75"), f"select * from ({ORDER_LINES}) where line_no >= 200 and line_no < 275"),
    "mask_0010": (lambda s, d: select.select_lines(order_lines(s, d), mask="0010"), f"select * from ({ORDER_LINES}) where line_no % 4 = 1"),
    "mask_0001": (lambda s, d: select.select_lines(order_lines(s, d), mask="0001"), f"select * from ({ORDER_LINES}) where line_no % 4 = 0"),
    "mask_phase_offset": (lambda s, d: select.select_lines(order_lines(s, d), "7-905", "10010"), f"select * from ({ORDER_LINES}) where line_no >= 7 and line_no < 905 and (line_no - 7) % 5 in (1, 4)"),
    "cat_union": (lambda s, d: combine.concatenate([order_lines(s, d), customer_lines(s, d), order_lines(s, d)]), f"with {LINES} select 0 as file_no, * from o union all select 1, * from c union all select 2, * from o"),
    "cat_range_per_file": (
        lambda s, d: combine.concatenate([order_lines(s, d), part_lines(s, d)], "5-100", "01"),
        f"with {LINES} select 0 as file_no, * from o where line_no between 5 and 99 and line_no % 2 = 1 union all select 1, * from p where line_no between 5 and 99 and line_no % 2 = 1",
    ),
    "paste_zip": (lambda s, d: combine.paste([order_lines(s, d), order_lines(s, d)]), f"select line_no, concat(value, value) as value from ({ORDER_LINES})"),
    "paste_shortest": (
        lambda s, d: combine.paste([order_lines(s, d), customer_lines(s, d), part_lines(s, d)], "10"),
        f"with {LINES} select o.line_no, concat(o.value, c.value, p.value) as value from o join c using (line_no) join p using (line_no) where line_no >= 10",
    ),
    "paste_delim": (
        lambda s, d: combine.paste([part_lines(s, d), customer_lines(s, d)], "3:500", "110", "\t"),
        f"with {LINES} select p.line_no, concat(p.value, chr(9), c.value) as value from p join c using (line_no) where line_no >= 3 and line_no < 503 and (line_no - 3) % 3 in (1, 2)",
    ),
    "text_lines": (lambda s, d: lines_of(_table(s, d, "documents"), "text", "doc_id"), "select doc_id, i - 1 as line_no, string_split(text, chr(10))[i] as value from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)"),
    "characters": (lambda s, d: characters(part_lines(s, d)).groupBy("char").agg(F.count("*").alias("n")), f"select char, count(*) as n from (select unnest(string_split(value, '')) as char from ({PART_LINES})) where char <> '' group by char"),
    "fastq_records": (lambda s, d: records(_records(s, d)), _with(READS, "select idx, name, s1 as seq, '+' as plus, q1 as qual from reads")),
    "field_mask": (lambda s, d: records(_records(s, d), "0011"), _with(READS, "select idx, name, s1 as seq from reads")),
    "record_range": (lambda s, d: select.select_range(records(_records(s, d)), "120:40", "idx"), _with(READS, "select idx, name, s1 as seq, '+' as plus, q1 as qual from reads where idx >= 120 and idx < 160")),
    "read_name_trim": (
        lambda s, d: flat_reads(s, _orders(s, d)).select("idx", read_name(F.col("name")).alias("short"), read_name_with_space(F.col("name")).alias("older")),
        _with(READS, "select idx, regexp_replace(name, '[ \t].*$', '') as short, case when contains(name, ' ') then concat(split_part(name, ' ', 1), ' ') else '' end as older from reads"),
    ),
    "mate_zip": (_zip, _with(READS, "select idx, name, s1, q2, s4 from reads where idx % 3 < 2")),
    "mate_consistency": (_consistency, _with(READS, "select mate, count(*) as n from reads cross join (values ('r1'), ('r2'), ('r3'), ('r4'), ('i1')) as m(mate) where mate <> 'i1' or idx < 1000 group by mate")),
    "segment_geometry": (
        _segments,
        _with(MATCHES, "select idx, substring(s4, 1, 10) as seg_s, substring(rx, 14, 6 + extra) as seg_a, substring(rx, 8, 6) as seg_b, substring(rx, 21 + extra, 7) as seg_c, substring(rx, 1, 6) as seg_d, substring(si, 1, 8) as seg_p from moved"),
    ),
    "edit_distance": (lambda s, d: _distances(s, d).select("c_custkey", "ed"), "select c_custkey, levenshtein(c_name, c_mktsegment) as ed from customer"),
    "edit_distance_bounded": (lambda s, d: _distances(s, d).select("c_custkey", "near"), "select c_custkey, least(levenshtein(c_name, c_mktsegment), 17) as near from customer"),
    "match_stagger": (_match("s"), _with(MATCHES, "select * from s")),
    "match_a": (_match("a"), _with(MATCHES, "select * from a")),
    "match_b": (_match("b"), _with(MATCHES, "select * from b")),
    "match_c": (_match("c"), _with(MATCHES, "select * from c")),
    "match_d": (_match("d"), _with(MATCHES, "select * from d")),
    "match_plate8": (_match("p"), _with(MATCHES, "select * from p")),
    "match_plate7": (_match_plate7, _with(MATCHES, "select * from p7")),
    "match_distinct": (
        _match_distinct,
        f"""with bc as ({barcode_values()}), l as (select substring(translate(md5(concat(l_orderkey, l_linenumber)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) as seg from lineitem),
        e as (select d.seg, b.tag, levenshtein(d.seg, b.code) as ed from (select distinct seg from l) d cross join bc b where set_name = 'D'),
        m as (select seg, min(ed) as ed from e group by seg), h as (select m.seg, m.ed, count(*) as ties, min(e.tag) as tag from m join e on e.seg = m.seg and e.ed = m.ed group by m.seg, m.ed),
        v as (select ed, case when ed = 0 then 'correct' when ties = 1 then 'corrected' else 'unclear' end as rt, case when ed = 0 or ties = 1 then tag else 'D00' end as tag from l join h using (seg))
        select rt, count(*) as n, cast(sum(ed) as bigint) as ed, count(distinct tag) as tags from v group by rt""",
    ),
    "exact_then_fuzzy": (_exact_then_fuzzy, _with(MATCHES, "select idx, tag, ed = 0 as exact from d where rt <> 'invalid'")),
    "read_class": (lambda s, d: matched(s, d).select("idx", logs.read_class().alias("rt")), _with(MATCHES, f"select r.idx, {_CLASS} as rt {_JOINED}")),
    "any_flags": (
        lambda s, d: matched(s, d).select("idx", "any_invalid", "any_unclear"),
        _with(MATCHES, f"select r.idx, 'invalid' in (s.rt, a.rt, b.rt, c.rt, d.rt, p.rt) as any_invalid, 'unclear' in (s.rt, a.rt, b.rt, c.rt, d.rt, p.rt) as any_unclear {_JOINED}"),
    ),
    "bx_header": (lambda s, d: matched(s, d).select("idx", demux.header(True).alias("header")), _with(MATCHES, f"select r.idx, {_HEADER} as header {_JOINED}")),
    "bx_header_noplate": (lambda s, d: matched(s, d, False).select("idx", demux.header(False).alias("header")), _with(MATCHES, f"select r.idx, {_BARE_HEADER} as header {_JOINED}")),
    "rx_qx_tags": (
        lambda s, d: reads(s, d).select("idx", F.concat("r2.seq", "r3.seq", F.lit("+"), "i1.seq").alias("rx"), F.concat("r2.qual", "r3.qual", F.lit("+"), "i1.qual").alias("qx")),
        _with(READS, "select idx, concat(s2, s3, '+', si) as rx, concat(q2, q3, '+', qi) as qx from reads"),
    ),
    "clip_size": (lambda s, d: matched(s, d).select("idx", demux.clip_size(_BC).cast("bigint").alias("clip")), _with(MATCHES, f"select r.idx, {_CLIP} as clip {_JOINED}")),
    "clip_r2": (
        lambda s, d: demux.second_output(matched(s, d), _BC).select("idx", "seq", "qual"),
        _with(MATCHES, f"select r.idx, substring(s4, {_CLIP} + 1) as seq, substring(q4, {_CLIP} + 1) as qual {_JOINED}"),
    ),
    "r1_output": (_outputs("r1"), _with(MATCHES, f"select r.idx, {_HEADER} as name, s1 as seq, '+' as plus, q1 as qual {_JOINED}")),
    "r2_output": (_outputs("r2"), _with(MATCHES, f"select r.idx, {_HEADER} as name, substring(s4, {_CLIP} + 1) as seq, '+' as plus, substring(q4, {_CLIP} + 1) as qual {_JOINED}")),
    "clear_log": (
        lambda s, d: logs.clear_log(logs.classified(matched(s, d), True)),
        _with(MATCHES + f", {_LOGGED}", "select code, count(*) filter (where rt = 'correct') as correct, count(*) filter (where rt = 'corrected') as corrected from logged where rt <> 'unclear' group by code"),
    ),
    "unclear_log": (lambda s, d: logs.unclear_log(logs.classified(matched(s, d), True)), _with(MATCHES + f", {_LOGGED}", "select code, count(*) as reads from logged where rt = 'unclear' group by code")),
    "barcode_stats": (
        _stats,
        f"with bc as ({barcode_values()}) select case set_name when 'plate8' then 'plate' else set_name end as \"set\", count(*) as n, min(length(code)) as min_length, max(length(code)) as max_length from bc where set_name <> 'plate7' group by set_name",
    ),
    "code_total_length": (_total_length, f"with bc as ({barcode_values()}) select cast(sum(n) + 2 as bigint) as total from (select max(length(code)) as n from bc where set_name in ('A', 'B', 'C', 'D') group by set_name)"),
    "sort_by_tag": (_sets(lambda b: b.sorted_by_tag()), _set_sql(order="row_number() over (partition by \"set\" order by tag)")),
    "reset_code_letter": (_sets(lambda b: b.with_letter("X")), _set_sql(tag="concat('X', substring(tag, 2))")),
    "unclear_tag_heuristic": (_guess, f"with bc as ({barcode_values()}) select set_name as \"set\", concat(substring(tag, 1, 1), repeat('0', length(tag) - 1)) as unclear, concat(substring(tag, 1, 1), repeat('0', length(tag) - 1)) as guessed from bc where ord = 1 and set_name in ('A', 'B', 'C', 'D', 'plate8')"),
    "io_stats": (
        lambda s, d: combine.io_stats(order_lines(s, d), select.select_lines(order_lines(s, d), mask="0010")),
        f"with {LINES} select count(*) as lines_in, cast(sum(strlen(value) + 1) as bigint) as bytes_in, count(*) filter (where line_no % 4 = 1) as lines_out, cast(sum(strlen(value) + 1) filter (where line_no % 4 = 1) as bigint) as bytes_out from o",
    ),
    "legacy_header_8bp": (_legacy("8bp"), f"select idx, header, code, rt from ({_legacy_sql('8bp')})"),
    "legacy_header_7bp": (_legacy("7bp"), f"select idx, header, code, rt from ({_legacy_sql('7bp')})"),
    "legacy_header_noplate": (_legacy("noplate"), f"select idx, header, code, rt from ({_legacy_sql('noplate')})"),
    "legacy_clip": (
        _legacy_clip,
        f"select idx, clip, substring(s4, clip + 1) as seq from (select *, case when n between 1 and 32 then 17 when n between 33 and 64 then 18 else 19 end as clip from (select *, cast(substring(tag_a, 2, 2) as int) as n from ({_legacy_sql('8bp')})))",
    ),
    "legacy_read_limit": (lambda s, d: select.select_range(reads(s, d), "0:100", "idx").select("idx", "r1.seq"), _with(READS, "select idx, s1 as seq from reads where idx < 100")),
} | file_queries.QUERIES
