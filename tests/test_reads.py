import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import bounded_edit_distance, max_substr, read_name, read_name_with_space
from readloom.operators import combine, demux, legacy, logs, match, select
from readloom.plans import cli, config
from readloom.plans.file_queries import QUERIES
from readloom.plans.synthetic import read_sets
from readloom.sources import barcodes, fastq, text, writers
from readloom.streaming import demux as streaming

SF = "/root/testdata/sf0.001"
SETS = ("A", "B", "C", "D", "stagger", "plate7", "plate8")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def nearest(segment, required, one):
    if len(segment) < required:
        return one.unclear, 0, -1, "invalid"
    eds = [levenshtein(segment, c) for c in one.codes]
    low = min(eds)
    if low and eds.count(low) > 1:
        return one.unclear, 0, low, "unclear"
    return one.tags[eds.index(low)], eds.index(low) + 1, low, "corrected" if low else "correct"


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("way", ["auto", "inline", "distinct"])
def test_match_equals_brute_force(spark, name, way):
    random.seed(len(name) + len(way))
    one = barcodes.shipped(name)
    lengths = tuple(range(one.min_length, one.max_length + 1))
    segments = ["".join(random.choices("ACGT", k=random.choice(lengths))) for _ in range(60)] + one.codes[:20] + ["", "AC", "N" * one.max_length, "ACGN" * 2, one.codes[0][:-1] + "N"]
    df = spark.createDataFrame(list(enumerate(segments)), "i int, seg string")
    got = {r.i: tuple(r.m) for r in match.match(df, F.col("seg"), one.min_length, one, "m", lengths, way).collect()}
    assert got == {i: nearest(s, one.min_length, one) for i, s in enumerate(segments)}


def test_match_null_and_limit(spark):
    one = barcodes.shipped("D")
    df = spark.createDataFrame([(1, None), (2, "TTTTTT")], "i int, seg string")
    for way in ("enumerated", "inline", "distinct"):
        rows = {r.i: r.m for r in match.match(df, F.col("seg"), 6, one, "m", way=way, max_ed=0).collect()}
        assert rows[1].rt == "invalid" and rows[1].tag == "D00" and rows[2].rt in ("unclear", "correct")


def test_scalars(spark):
    df = spark.createDataFrame([("ACGT", "@n x y"), ("", "@n\tx y"), ("ACGTACGT", "@n")], "s string, n string")
    rows = df.select(max_substr(F.col("s"), 3, 4).alias("a"), max_substr(F.col("s"), 9).alias("b"), read_name(F.col("n")).alias("c"), read_name_with_space(F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("T", "", "@n", "@n "), ("", "", "@n", "@n\tx "), ("TACGT"[:4], "", "@n", "")]
    pairs = spark.createDataFrame([("kitten", "sitting"), ("a", "a"), ("", "abc")], "a string, b string")
    assert [r[0] for r in pairs.select(bounded_edit_distance(F.col("a"), F.col("b"), 3)).collect()] == [3, 0, 3]
    assert [r[0] for r in pairs.select(bounded_edit_distance(F.col("a"), F.col("b"), 0)).collect()] == [0, 0, 0]


def test_ranges_and_masks(spark):
    assert select.parse_range("") == (0, None) and select.parse_range("7") == (7, None) and select.parse_range("2-5") == (2, 5) and select.parse_range("2:5x") == (2, 7)
    for bad in ("x", "10-", "1,2", "-3"):
        with pytest.raises(ValueError, match="can't parse range"):
            select.parse_range(bad)
    for bad in ("012", "1" * 65):
        with pytest.raises(ValueError, match="mask"):
            select.parse_mask(bad)
    with pytest.warns(UserWarning, match="empty mask"):
        select.parse_mask("000")
    lines = spark.createDataFrame([(i, str(i)) for i in range(20)], "line_no bigint, value string")
    pick = lambda *a: sorted(r.line_no for r in select.select_lines(lines, *a).collect())
    assert pick("3", "0010") == [4, 8, 12, 16] and pick("5-2") == [] and pick("19-50") == [19] and pick("30") == [] and pick("", "1") == list(range(20))


def test_barcode_files(spark, tmp_path):
    def file(content):
        path = tmp_path / f"{random.random()}.txt"
        path.write_text(content)
        return str(path)

    one = barcodes.read_set(spark, file("A01\tACGT\n\nA02 AC GT\n"))
    assert one.entries == (("A01", "ACGT"), ("A02", "AC GT")) and one.unclear == "A00" and (one.min_length, one.max_length) == (4, 5)
    for content, why in (("", "empty"), ("A01ACGT\n", "separator"), ("A01\tAC\nA02\tAC\n", "code occurs twice"), ("A01\tAC\nA01\tAG\n", "tag occurs twice")):
        with pytest.raises(ValueError, match=why):
            barcodes.read_set(spark, file(content))
    assert barcodes.read_fixed_width(spark, file("A01 ACGT\nA02 CCCC\nA03 ACGT\n"), 3).entries == (("A01", "ACGT"), ("A02", "CCCC"))
    assert barcodes.make_set("x", []).min_length == 1_000_000 and one.with_letter("Q").tags == ["Q01", "Q02"]


def test_lines_keep_carriage_returns_and_order(spark, tmp_path):
    rows = [f"line {i}\r" if i % 3 else "" for i in range(5000)] + ["last"]
    (tmp_path / "a.txt").write_bytes("\n".join(rows).encode())
    with gzip.open(tmp_path / "a.txt.gz", "wb") as f:
        f.write("\n".join(rows).encode() + b"\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        for name in ("a.txt", "a.txt.gz"):
            got = [r.value for r in text.read_lines(spark, str(tmp_path / name)).orderBy("line_no").collect()]
            assert got == rows, name
        assert text.read_lines(spark, str(tmp_path / "a.txt")).select("line_no").distinct().count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.gz").write_bytes((tmp_path / "a.txt.gz").read_bytes()[:2000])
    with pytest.raises(Exception):  # noqa: B017
        text.read_lines(spark, str(tmp_path / "bad.gz")).collect()


def fastq_file(path, records, packed):
    content = "".join("\n".join(r) + "\n" for r in records)
    if packed:
        with gzip.open(path, "wt") as f:
            f.write(content)
    else:
        path.write_text(content)
    return str(path)


@pytest.fixture
def mates(spark, tmp_path):
    sets = read_sets(spark, spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 200")).orderBy("idx").collect()
    return {m: fastq_file(tmp_path / f"{m}.fastq.gz", [tuple(s[m]) for s in sets], m != "r3") for m in ("r1", "r2", "r3", "r4", "i1")}, sets


def test_fastq_sources(spark, mates, tmp_path):
    paths, sets = mates
    got = fastq.read_mates(spark, **paths).orderBy("idx").collect()
    assert [(r.idx, r.r1, r.r4, r.i1) for r in got] == [(s.idx, s.r1, s.r4, s.i1) for s in sets]
    assert [r.idx for r in fastq.read_mates(spark, "10:5", **paths).collect()] == [10, 11, 12, 13, 14]
    assert fastq.read_mates(spark, "900", **paths).count() == 0
    one = text.read_fastq(spark, paths["r4"]).orderBy("idx").collect()
    assert [tuple(r)[1:] for r in one] == [tuple(s.r4) for s in sets]  # qualities that start with @ as well
    short = fastq_file(tmp_path / "short.fastq", [("@a", "A", "+", "F")], False)
    with pytest.raises(Exception, match="inconsistent number"):
        fastq.read_mates(spark, r1=paths["r1"], r2=short).count()
    lanes = fastq.read_mates(spark, r1=[paths["r1"], short], r2=[paths["r2"], short])
    assert lanes.where("lane = 1").count() == 1 and lanes.rdd.getNumPartitions() == 2
    with pytest.raises(ValueError, match="inconsistent"):
        combine.check_mates(r1=text.read_fastq(spark, paths["r1"]), r4=text.read_fastq(spark, short))
    assert combine.check_mates(r1=text.read_fastq(spark, paths["r1"]), r4=text.read_fastq(spark, paths["r4"])) == 200


def test_short_reads(spark):
    """Invalid A clips the stagger and spacer only, unclear A the longest; a short stagger counts as none."""
    a, b, c, d = (barcodes.shipped(k).codes[0] for k in "ABCD")
    s0 = "ATGTGTATAA"
    rec = lambda seq: ("@r 1", seq, "+", "@" * len(seq))
    full = d + "T" + b + a + "G" + c
    rows = [
        (0, rec("ACGT"), rec(full[:13]), rec(full[13:]), rec(s0 + "C" + a + "TTTT"), rec("GCGATCTA")),
        (1, rec("ACGT"), rec(full[:13]), rec(full[13:15]), rec(s0 + "C" + a + "TTTT"), rec("GCG")),
        (2, rec("ACGT"), rec(full[:13]), rec(full[13:]), rec(s0[:8]), rec("GCGATCTA")),
        (3, rec(""), rec(""), rec(""), rec(""), rec("")),
    ]
    reads = spark.createDataFrame(rows, streaming.READ_SETS)
    bc = demux.shipped_barcodes()
    out = {r.idx: r for r in demux.demultiplex(reads, bc).withColumn("clip", demux.clip_size(bc)).collect()}
    assert (out[0].a.rt, out[0].clip, out[0].any_invalid) == ("correct", 17, False)
    assert (out[1].a.rt, out[1].c.rt, out[1].p.tag, out[1].clip) == ("invalid", "invalid", "P000", 11)
    assert (out[2].s.rt, out[2].a.rt, out[2].any_invalid) == ("invalid", "correct", True)
    second = {r.idx: r for r in demux.second_output(demux.demultiplex(reads, bc), bc).collect()}
    assert second[0].seq == "TTTT" and second[2].seq == "" and second[3].name == "@r\tBX:Z:A00C00B00D00-P000\tRX:Z:+\tQX:Z:+"
    old = {r.idx: r for r in legacy.legacy(reads, bc).collect()}
    assert old[2].stagger == 9 and old[2].rx == "N" * 28 and old[1].code == "A00C00B00D00P000" and old[0].clip == 17 and old[3].clip == 19


def test_older_and_newer_agree_on_whole_reads(spark):
    sets = read_sets(spark, spark.read.parquet(f"{SF}/orders.parquet")).where("length(r2.seq) + length(r3.seq) >= 29 and length(r4.seq) >= 10 and length(i1.seq) >= 8")
    bc = demux.shipped_barcodes()
    new = {r.idx: r.name for r in demux.first_output(demux.demultiplex(sets, bc), bc).collect()}
    assert len(new) > 500 and new == {r.idx: r.header for r in legacy.legacy(sets, bc).collect()}


def test_stream_equals_batch(spark, tmp_path):
    bc = demux.shipped_barcodes()
    sets = read_sets(spark, spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300"))
    sets.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = demux.demultiplex(spark.read.parquet(str(tmp_path / "in")), bc)
    for way in ("auto", "inline"):
        stream = streaming.demultiplex_stream(streaming.read_set_stream(spark, str(tmp_path / "in"), 1), bc, way)
        streaming.write_records(stream, bc, str(tmp_path / f"out-{way}"), str(tmp_path / f"mark-{way}")).awaitTermination()
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(spark.read.parquet(str(tmp_path / f"out-{way}"))) == key(demux.first_output(batch, bc))
    stream = streaming.demultiplex_stream(streaming.read_set_stream(spark, str(tmp_path / "in"), 1), bc)
    streaming.write_log(stream, True, "clear_so_far", str(tmp_path / "mark-log")).awaitTermination()
    assert spark.table("clear_so_far").collect() == logs.clear_log(logs.classified(batch, True)).collect()


def barcode_files(tmp_path):
    for k in SETS:
        (tmp_path / f"{k}.txt").write_text("".join(f"{t}\t{c}\n" for t, c in barcodes.shipped(k).entries))


def test_command_line(spark, mates, tmp_path, capsys):
    paths, sets = mates
    barcode_files(tmp_path)
    raw = {
        "range": "", "pool_threads": -1,
        "barcodes": {"root": str(tmp_path), **{k: {"file": f"{k}.txt", "unclear_tag": f"{k}00"} for k in "ABCD"}, "plate": {"file": "plate8.txt", "unclear_tag": "P000"}, "stagger": {"file": "stagger.txt", "unclear_tag": "S00", "sort_by_tag": True}},
        "reads": {"root": str(tmp_path), **{m.upper(): f"{m}.fastq.gz" for m in paths}}, "output": {"root": str(tmp_path / "none"), "clipping": True, "R1": "R1.fastq.gz", "R2": "R2.fastq.gz"},
    }
    (tmp_path / "c.json").write_text("// a run\n" + json.dumps(raw).replace('"range": ""', '/* all */ "range": "20-180"'))
    args = ["demux", str(tmp_path / "c.json"), "--replace", json.dumps({"/output/root": str(tmp_path / "out")})]
    assert cli.main([*args, "--dry"], spark) == 0 and "code length 29" in capsys.readouterr().out
    assert cli.main([*args, "--logs"], spark) == 0
    bc = demux.shipped_barcodes()
    want = demux.demultiplex(spark.createDataFrame(sets[20:180], spark.createDataFrame(sets).schema), bc)
    for name, rows in (("R1", demux.first_output(want, bc)), ("R2", demux.second_output(want, bc))):
        with gzip.open(tmp_path / "out" / f"{name}.fastq.gz", "rt") as f:
            assert f.read().split("\n")[:-1] == [x for r in rows.orderBy("idx").collect() for x in r[1:]]
    assert json.loads((tmp_path / "out" / "config.json").read_text())["output"]["root"] == str(tmp_path / "out")
    log = (tmp_path / "out" / "clearBC.log").read_text().split("\n")
    assert log[0] == "Barcode \t Correct reads \t Corrected reads" and log[1:-1] == [f"{r.code}\t{r.correct}\t{r.corrected}" for r in logs.clear_log(logs.classified(want, True)).collect()]
    assert cli.main(args, spark) == 1 and "exists" in capsys.readouterr().err
    only = json.dumps({"/output/R2": "", "/range": "0:3"})
    assert cli.main([*args, "-f", "--replace", only], spark) == 0 and not (tmp_path / "out" / "R2.fastq.gz").exists()


def test_lines_command(spark, tmp_path, capsys):
    (tmp_path / "x").write_text("a\nb\nc\nd\n")
    with gzip.open(tmp_path / "y.gz", "wt") as f:
        f.write("1\n2\n3")
    x, y = str(tmp_path / "x"), str(tmp_path / "y.gz")
    assert cli.main(["cat", "-r", "1", x, y, x], spark) == 0 and capsys.readouterr().out == "b\nc\nd\n2\n3\nb\nc\nd\n"
    assert cli.main(["paste", "-d", "-", x, y], spark) == 0 and capsys.readouterr().out == "a-1\nb-2\nc-3\n"
    assert cli.main(["paste", x, y], spark) == 0 and capsys.readouterr().out == "a1\nb2\nc3\n"
    out = str(tmp_path / "z.gz")
    assert cli.main(["cat", "-m", "01", "-v", "-o", out, x, y], spark) == 0
    with gzip.open(out, "rt") as f:
        assert f.read() == "a\nc\n1\n3\n"
    assert cli.main(["cat", "-o", out, x], spark) == 1 and cli.main(["cat", "-f", "-o", out, x], spark) == 0 and cli.main(["cat", "-r", "z", x], spark) == 1


def test_config_patches():
    base = {"a": {"b": 1}, "l": [1, 2]}
    assert config.patched(base, '{"/a/b": 2, "/c/d~1e/f": 3, "/l/0": 9, "/l/-": 4}') == {"a": {"b": 2}, "l": [9, 2, 4], "c": {"d/e": {"f": 3}}}
    assert base == {"a": {"b": 1}, "l": [1, 2]} and config.parse_json('{"a": "x // y" /* z */}') == {"a": "x // y"}
    for bad in ({}, {"range": "5-5", "barcodes": {}, "reads": {}, "output": {}}):
        with pytest.raises(ValueError):
            config.checked(bad)


def test_stdin_and_parts(spark, tmp_path):
    rows = text.stdin_lines(spark, ["a\n", "b"])
    assert [r.value for r in rows.orderBy("line_no").collect()] == ["a", "b"]
    writers.write_ordered(rows.withColumnRenamed("line_no", "idx"), str(tmp_path / "w"))
    with pytest.raises(Exception, match="already exists"):
        writers.write_ordered(rows.withColumnRenamed("line_no", "idx"), str(tmp_path / "w"))


def test_stdout_comes_in_blocks(spark, tmp_path):
    """In order and whole, partitions without lines too, and in far fewer pieces than lines; bytes that are no text don't stop it."""
    class Pieces(list):
        write = list.append

    out = Pieces()
    lines = spark.range(5000, numPartitions=7).select(F.col("id").alias("idx"), F.concat(F.lit("l\u00e9"), F.col("id").cast("string")).alias("value"))
    assert writers.write_stdout(lines.where("idx not between 1000 and 3999").orderBy("idx").select("value"), out) == 2000
    assert "".join(out) == "".join(f"l\u00e9{i}\n" for i in range(5000) if not 1000 <= i < 4000) and len(out) < 50
    assert writers.write_stdout(lines.where("idx < 0").select("value"), out) == 0
    (tmp_path / "x").write_bytes(b"a\xffb\r\n\n\xe2\x82\nc")
    out = Pieces()
    assert writers.write_stdout(text.read_lines(spark, str(tmp_path / "x")).select("value"), out) == 4 and "".join(out) == "a\ufffdb\r\n\n\ufffd\nc\n"


def test_stdout_query_keeps_no_lines_in_the_driver(spark, tmp_path):
    import tracemalloc

    n = 100_000
    spark.range(n).select(((F.col("id") * 7919) % n).alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0).select(F.col("id").alias("o_orderkey"), F.lit("").alias("o_orderpriority")).write.parquet(f"{tmp_path}/none/orders.parquet")
    tracemalloc.start()
    try:
        got = QUERIES["stdout_lines"][0](spark, str(tmp_path))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 << 20  # the lines are 1.5 MB; as a string and rows in the driver they took 26
    whole = F.col("value") == F.concat_ws("|", F.col("line_no").cast("string"), F.lit("1-URGENT"))
    assert got.where(whole & (F.col("n") == n)).agg(F.count("*"), F.count_distinct("line_no"), F.min("line_no"), F.max("line_no")).first() == (n, n, 0, n - 1)
    assert got.count() == n and QUERIES["stdout_lines"][0](spark, f"{tmp_path}/none").count() == 0


def test_lanes_stay_in_step(spark, mates, tmp_path, monkeypatch):
    """Two lanes, blocks and chunks of a few records: ordinals tell all records apart, R1 and R2 keep the same order."""
    from readloom.operators.demux import both_outputs, demultiplex, first_output, second_output, shipped_barcodes, spread
    from readloom.sources.writers import join_parts, write_outputs

    paths, sets = mates
    monkeypatch.setattr(fastq, "BLOCK", 1000)
    two = fastq.read_mates(spark, **{k: [p, p] for k, p in paths.items()})
    assert two.select("idx").distinct().count() == 2 * len(sets)
    bc = shipped_barcodes()
    write_outputs(both_outputs(demultiplex(spread(two, 3, 5), bc), bc), str(tmp_path / "out"))
    matched = demultiplex(two, bc)
    lines = {}
    for key, rows in (("R1", first_output), ("R2", second_output)):
        join_parts(f"{tmp_path}/out/output={key}", f"{tmp_path}/{key}.gz")
        with gzip.open(f"{tmp_path}/{key}.gz", "rt", newline="\n") as f:
            lines[key] = f.read()
        want = rows(matched, bc).orderBy("idx").collect()
        assert lines[key] == "".join(f"{r.name}\n{r.seq}\n{r.plus}\n{r.qual}\n" for r in want)
    headers = [lines[k].split("\n")[::4] for k in ("R1", "R2")]
    assert headers[0] == headers[1] and len(headers[0]) == 2 * len(sets) + 1


@pytest.mark.parametrize("packed", [False, True])
def test_incomplete_records_raise(spark, tmp_path, packed):
    good = [(f"@r{i}", "ACGT", "+", "FFFF") for i in range(50)]
    whole = fastq_file(tmp_path / "a", good, packed)
    (tmp_path / "b").write_text("\n".join("\n".join(r) for r in good))  # without the last newline
    assert [r.r2.name for r in fastq.read_mates(spark, r1=whole, r2=str(tmp_path / "b")).collect()] == [g[0] for g in good]
    cut = fastq_file(tmp_path / "c", [*good, ("@x", "AC")], packed)
    for paths in ({"r1": cut}, {"r1": whole, "r2": cut}):
        with pytest.raises(Exception, match="isn't complete|inconsistent"):
            fastq.read_mates(spark, **paths).collect()
    with pytest.raises(Exception, match="incomplete record"):
        text.records(text.read_lines(spark, str(tmp_path / "a")) if not packed else spark.createDataFrame([(0, "x")], "line_no bigint, value string")).union(
            text.records(spark.createDataFrame([(0, "@a"), (1, "C")], "line_no bigint, value string"))
        ).collect()
    (tmp_path / "d").write_bytes(b"@a\n\xff\xfe\n+\nFF\n")
    with pytest.raises(Exception, match="UTF"):
        fastq.read_mates(spark, r1=str(tmp_path / "d")).collect()
    (tmp_path / "e").write_bytes(b"")
    assert not fastq.read_mates(spark, r1=str(tmp_path / "e")).collect()


def test_streams_of_long_codes(spark, tmp_path):
    """Codes too long to be enumerated are compared in the row where the reads are a stream."""
    from readloom.operators.match import match
    from readloom.sources.barcodes import make_set

    rng = random.Random(4)
    codes = ["".join(rng.choices("ACGT", k=10)) for _ in range(12)]
    one = make_set("X", [(f"X{i:02}", c) for i, c in enumerate(codes, 1)])
    rows = [(i, codes[i % 12][:-1] + rng.choice("ACGTN")) for i in range(40)]
    spark.createDataFrame(rows, "idx bigint, seg string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx bigint, seg string").parquet(str(tmp_path / "in"))
    out = match(stream, F.col("seg"), 10, one, "x").select("idx", "x.tag", "x.rt")
    out.writeStream.format("memory").queryName("long_codes").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    want = match(spark.read.parquet(str(tmp_path / "in")), F.col("seg"), 10, one, "x", way="distinct").select("idx", "x.tag", "x.rt")
    assert sorted(map(tuple, spark.table("long_codes").collect())) == sorted(map(tuple, want.collect()))
