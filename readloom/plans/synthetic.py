"""Read sets made from the orders table, by SQL that Spark and DuckDB both run: barcodes picked by the key, with
substitutions, deletions, unknown bases, short reads and random ones at fixed shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.barcodes import shipped

SETS = ("A", "B", "C", "D", "stagger", "plate8", "plate7")


def barcode_values() -> str:
    """select set_name, ord, tag, code; stagger sorted by tag."""
    rows = []
    for name in SETS:
        one = shipped(name).sorted_by_tag() if name == "stagger" else shipped(name)
        rows += [f"('{name}', {i}, '{t}', '{c}')" for i, (t, c) in enumerate(one.entries, 1)]
    return f"select * from (values {', '.join(rows)}) as t(set_name, ord, tag, code)"


def _random(salt: str) -> str:
    return f"translate(md5(concat(idx, '{salt}')), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _changed(text: str, at: str, by: str = "'ACGT', 'CGTA'") -> str:
    return f"concat(substring({text}, 1, {at} - 1), translate(substring({text}, {at}, 1), {by}), substring({text}, {at} + 1))"


#: CTEs that end in reads(idx, name, s1, q1, s2, q2, s3, q3, s4, q4, si, qi). {{orders}} is the table.
READS = f"""
bc as ({barcode_values()}),
base as (select o_orderkey as idx from {{orders}}),
made as (
  select idx, {_random('r1')} as x1, {_random('rx')} as xr, concat({_random('r4')}, {_random('r4b')}) as x4,
    concat(d.code, 'T', b.code, a.code, 'G', c.code, substring({_random('end')}, 1, 5)) as rx0, concat(s.code, 'C', a.code) as p4, p.code as p0
  from base
  join bc a on a.set_name = 'A' and a.ord = 32 * (idx % 3) + 1 + (idx * 5) % 32
  join bc b on b.set_name = 'B' and b.ord = 1 + (idx * 7) % 96
  join bc c on c.set_name = 'C' and c.ord = 1 + (idx * 11) % 96
  join bc d on d.set_name = 'D' and d.ord = 1 + (idx * 13) % 96
  join bc s on s.set_name = 'stagger' and s.ord = 1 + idx % 3
  join bc p on p.set_name = 'plate8' and p.ord = 1 + (idx * 5) % 3),
hit as (
  select idx, x1, p0, concat(p4, x4) as r40,
    case when idx % 19 = 0 then xr when idx % 7 = 0 then {_changed('rx0', '(1 + idx % 26)')}
      when idx % 13 = 0 then concat(substring(rx0, 1, idx % 26), substring(rx0, idx % 26 + 2)) when idx % 17 = 0 then {_changed('rx0', '(1 + idx % 26)', "'ACGT', 'NNNN'")} else rx0 end as rx1
  from made),
cut as (
  select idx, x1 as s1, case when idx % 50 = 0 then substring(rx1, 1, 20) else rx1 end as rx,
    case when idx % 60 = 1 then substring(r40, 1, 8) when idx % 5 = 0 then {_changed('r40', '(1 + idx % 10)')} else r40 end as s4,
    case when idx % 70 = 2 then substring(p0, 1, 5) when idx % 11 = 0 then {_changed('p0', '(1 + idx % 8)')} else p0 end as si
  from hit),
reads as (
  select idx, case when idx % 9 = 0 then concat('@R', idx) when idx % 9 = 1 then concat('@R', idx, chr(9), 'x') else concat('@R', idx, ' 1:N:0') end as name,
    s1, translate(s1, 'ACGT', 'F:,@') as q1, substring(rx, 1, 13) as s2, translate(substring(rx, 1, 13), 'ACGTN', 'F:,@!') as q2,
    substring(rx, 14) as s3, translate(substring(rx, 14), 'ACGTN', 'F:,@!') as q3, s4, translate(s4, 'ACGT', 'F:,@') as q4, si, translate(si, 'ACGT', 'F:,@') as qi
  from cut)
"""


def flat_reads(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The keys are few bytes and what is made of them is many: they are dealt to all cores first."""
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = orders.select("o_orderkey").repartition(cores)
    return spark.sql("with " + READS + " select * from reads", orders=orders)


def read_sets(spark: SparkSession, orders: DataFrame, plate: bool = True) -> DataFrame:
    """(idx, r1, r2, r3, r4[, i1])."""
    flat = flat_reads(spark, orders)
    of = lambda mate, k: F.struct("name", F.col(f"s{k}").alias("seq"), F.lit("+").alias("plus"), F.col(f"q{k}").alias("qual")).alias(mate)
    return flat.select("idx", *(of(f"r{k}", k) for k in range(1, 5)), *([of("i1", "i")] if plate else []))


def match_ctes(name: str, segment: str, required: str, barcodes: str, source: str = "reads") -> str:
    """CTEs that end in {name}(idx, tag, ord, ed, rt): by brute force, every segment against every code."""
    unclear = shipped(barcodes).unclear
    return f"""
{name}_seg as (select idx, {segment} as seg, {required} as req from {source}),
{name}_all as (select d.seg, b.ord, levenshtein(d.seg, b.code) as ed from (select distinct seg from {name}_seg) d cross join bc b where b.set_name = '{barcodes}'),
{name}_low as (select seg, min(ed) as ed from {name}_all group by seg),
{name}_hit as (select l.seg, l.ed, count(*) as ties, min(x.ord) as ord from {name}_low l join {name}_all x on x.seg = l.seg and x.ed = l.ed group by l.seg, l.ed),
{name} as (
  select s.idx, coalesce(t.tag, '{unclear}') as tag, cast(coalesce(t.ord, 0) as bigint) as ord, cast(case when length(s.seg) < s.req then -1 else h.ed end as bigint) as ed,
    case when length(s.seg) < s.req then 'invalid' when h.ed = 0 then 'correct' when h.ties = 1 then 'corrected' else 'unclear' end as rt
  from {name}_seg s join {name}_hit h on h.seg = s.seg
  left join bc t on t.set_name = '{barcodes}' and t.ord = h.ord and (h.ed = 0 or h.ties = 1) and length(s.seg) >= s.req)"""


#: reads, all matches, and moved(idx, ..., extra): the reads with the bases before A.
MATCHES = ",".join([
    READS, match_ctes("s", "substring(s4, 1, 10)", "10", "stagger"),
    " moved as (select r.*, concat(s2, s3) as rx, cast(case when s.ord > 0 then s.ord - 1 else 0 end as int) as extra from reads r join s on s.idx = r.idx)",
    match_ctes("d", "substring(rx, 1, 6)", "6", "D", "moved"), match_ctes("b", "substring(rx, 8, 6)", "6", "B", "moved"),
    match_ctes("a", "substring(rx, 14, 6 + extra)", "6 + extra", "A", "moved"), match_ctes("c", "substring(rx, 21 + extra, 7)", "7", "C", "moved"),
    match_ctes("p", "substring(si, 1, 8)", "8", "plate8"), match_ctes("p7", "substring(si, 1, 7)", "7", "plate7"),
])
