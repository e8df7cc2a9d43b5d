"""The queries of this package, by name."""

from __future__ import annotations

from readloom.llm import bpe, language, licences, line_dedup, neighbours, ngram_join, packing, quality, token_counts, token_store


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_token_blocks": token_store.query,
        "op3_quality_rules": quality.query,
        "op4_packing": packing.query,
        "op5_language_id": language.query,
        "op6_line_dedup": line_dedup.query,
        "op7_licence_scan": licences.query,
        "op8_bpe": bpe.query,
        "op9_neighbours": neighbours.query,
        "op10_ngram_join": ngram_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.SQL, "op6_line_dedup": line_dedup.SQL, "op10_ngram_join": ngram_join.SQL_CLASSES}
