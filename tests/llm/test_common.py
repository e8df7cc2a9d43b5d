from pathlib import Path
from types import SimpleNamespace

import pytest

from readloom.llm import common, line_dedup, ngram_join


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://one:7077", "yarn", "local-cluster[3,2,1024]"):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x", getConf=lambda: conf))
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(fake)


def test_tables_of_steps_that_are_done_are_removed(spark, docs):
    root = Path(common.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()}
    out = ngram_join.dedup(docs)
    assert {p.name.rpartition("-")[0] for p in root.iterdir() if p.name not in before} == {"copies"} and out.count() > 0
    before = {p.name for p in root.iterdir()}
    line_dedup.dedup_lines(docs).count()
    assert {p.name.rpartition("-")[0] for p in root.iterdir() if p.name not in before} == {"boilerplate"}


def test_scratch_keeps_what_it_is_given(spark):
    root, one = Path(common.shared_dir(spark).removeprefix("file://")), spark.range(3)
    with common.scratch() as keep:
        a = keep(common.stored(one, "kept-a"))
        with common.scratch() as inner:
            b = inner(common.stored(one, "kept-b"))
            common.stored(one, "gone-c")
        assert any(p.name.startswith("kept-b") for p in root.iterdir()) and not any(p.name.startswith("gone-c") for p in root.iterdir())
        assert b.count() == 3
    assert a.count() == 3 and not any(p.name.startswith("kept-b") for p in root.iterdir())


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "gone int, GONE_ int, x int")
    assert common.fresh(df, "gone") == "gone__" and common.fresh(df, "y") == "y"
