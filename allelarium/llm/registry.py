"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from allelarium.llm import chat_format, decontaminate, line_dedup, ngram_jaccard, periodic_runs, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, sharding, token_counts, toxicity, vector_codes

_MODULES = (sentencepiece_codec, token_counts, quality_classifier, quality_rules, line_dedup, sharding, chat_format, ngram_jaccard, decontaminate, toxicity, secret_scan, periodic_runs, vector_codes)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
