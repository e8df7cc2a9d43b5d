"""Operator 1, token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts are held as ragged numpy arrays (a flat array of symbols and the lengths of
its rows). In each round every row applies its lowest-rank pair, all rows at the same time; a row with no
mergeable pair left has as many tokens as it has symbols, and the counts of a text's rows are summed. A
pre-token is merged once, and its count kept for later batches of the same worker (see ``bpe``).

Defined results: a null text has a null count, an empty one 0; ids, nulls in other columns and repeated rows
pass through; further columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.bpe import PATTERN, VOCABULARY, shipped, vocabulary_of
from readloom.llm.common import in_batches, slices, table


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id and n_tokens."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, shared = dict(df.dtypes)["doc_id"], shipped(df.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                at, ends = v.entries_of(texts)
                counts = np.diff(np.concatenate([[0], np.cumsum(v.count[at])])[ends])
                counts = pa.array(counts, pa.int64(), mask=np.asarray(texts.is_null()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": counts})

    return in_batches(df, work, f"doc_id {kind}, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
