import pytest

import corpus_pipeline
from readloom.llm import language, line_dedup, ngram_join, packing, quality, token_counts
from readloom.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, sql):
    """Each stage against what its operator's SQL or brute force says of the stage's input."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), name))
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert ids[1] == sorted(r[0] for r in sql(docs, f"select doc_id from documents where {quality.SQL_KEEP}")[1])
    filters = language.fit(seen[1])
    rows = seen[1].collect()
    assert ids[2] == sorted(r.doc_id for r, keep in zip(rows, language._verdicts(filters, [r.text for r in rows])[2]) if keep)
    want = {r[0]: r[1] for r in sql(seen[2], f"select doc_id, text from ({line_dedup.SQL})")[1]}
    assert {r.doc_id: r.text for r in seen[3].collect()} == want
    pairs = sql(seen[3], ngram_join.SQL)[1]
    root = {i: i for i in ids[3]}
    for _ in root:
        for a, b, _ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert ids[4] == sorted(set(root.values()))
    assert {r.doc_id: r.n for r in seen[5].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == {
        r.doc_id: r.n_tokens for r in token_counts.token_counts(seen[4]).collect() if r.n_tokens
    }
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, seen[5].select("doc_id", "piece", "length").collect()))


def test_stages_with_odd_and_no_rows(spark, odd, none):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, SF), name)
    assert packing.pack_documents(none).columns == df.columns


def test_registered():
    entry = pytest.importorskip("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
