"""String ids and columns with the names that operators use themselves."""

import pytest

from readloom.llm import bpe, language, licences, line_dedup, packing, quality, token_counts

NAMES = ["keep", "text_left", "lines_found", "host_found", "n_dropped", "lines_dropped", "piece", "start", "length", "bin", "k", "part", "row", "n_tokens", "rule", "mask", "value", "predicted", "score", "gone", "id"]


@pytest.fixture(scope="module")
def named(spark, docs):
    rows = docs.where("doc_id < 60").selectExpr("concat('d', doc_id) as doc_id", "text", "lang", "source", "n_chars", *(f"{i} as {n}" for i, n in enumerate(NAMES)), "map('a', 1) as m")
    return rows.union(rows.limit(1)).union(rows.where("doc_id = 'd1'").selectExpr("null", "null", "null", "null", "null", *NAMES, "null"))


def test_operators_that_return_ids(named, docs):
    plain = docs.where("doc_id < 60")
    of = lambda rows, *names: {(str(r[0]).lstrip("d"), *(r[n] for n in names)) for r in rows if r[0] is not None}
    filters = language.fit(named)
    for op, names in (
        (token_counts.token_counts, ("n_tokens",)), (quality.quality_flags, ("keep",)), (lambda d: line_dedup.clean_lines(d, least=2), ()), (licences.licence_scan, ("licence", "line")),
        (lambda d: language.identify(d, filters), ("predicted", "keep")), (bpe.encode, ()), (lambda d: packing.pack_documents(d, 64), ("piece", "length")),
    ):
        assert of(op(named).collect(), *names) == of(op(plain).collect(), *names)


def test_filters_keep_the_columns(named):
    filters = language.fit(named)
    for op in (quality.filter_quality, lambda d: language.filter_language(d, filters), line_dedup.dedup_lines):
        out = op(named)
        rows = out.collect()
        assert out.columns == named.columns and rows
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)
