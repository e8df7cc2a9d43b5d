import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, further columns with names the operators use themselves."""
    rows = [
        (1, None, None, None, None, "x", 1), (None, "The cat sat on the mat.", "en", None, 23, None, 2), (2, "", "en", "a", 0, "x", 3), (3, " \n\t ", "en", "a", 4, "x", 4),
        (4, "One", None, "a", 3, "x", 5), (5, "word " * 30000, "en", "a", 150000, "x", 6), (6, "z" * 20000, "en", "a", 20000, "x", 7),
        (7, "Same text here now.", "en", "b", 19, "x", 8), (7, "Same text here now.", "en", "b", 19, "x", 8), (8, "Same text here now.", None, "b", 19, "y", 9),
        (9, "中文 текст ñandú 😀 \u0085 it's", "xx", "b", 20, "y", 9),
    ]
    return spark.createDataFrame(rows, DOCS + ", keep string, line bigint")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def sql(tmp_path):
    """Run an oracle's SQL over one table."""

    def run(df, query: str, name: str = "documents"):
        path = str(tmp_path / f"{name}.parquet")
        df.coalesce(1).write.mode("overwrite").parquet(path)
        con = duckdb.connect()
        con.sql(f"create view {name} as select * from '{path}/*.parquet'")
        rel = con.sql(query)
        return rel.columns, rel.fetchall()

    return run


def plain(value):
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.fixture
def same(sql):
    """Spark's rows equal the oracle's, as bags."""

    def check(got, source, query):
        columns, want = sql(source, query)
        rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(rows, key=key) == sorted((plain(r) for r in want), key=key)
        return rows

    return check
