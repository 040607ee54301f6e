"""Queries and their DuckDB forms: one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing, embedding_dedup, language_id, pii, simhash_dedup, source_mixing, substring_dedup, token_counts, topk_search, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_language_id": language_id.query,
    "op4_topk_search": topk_search.query,
    "op5_simhash_dedup": simhash_dedup.query,
    "op6_url_filters": url_filters.query,
    "op7_pii": pii.query,
    "op8_token_counts": token_counts.query,
    "op9_source_mixing": source_mixing.query,
    "op10_best_fit_packing": best_fit_packing.query,
}

#: Forms that DuckDB can run; the other queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_topk_search": topk_search.ORACLE_SQL,
    "op6_url_filters": url_filters.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op9_source_mixing": source_mixing.ORACLE_SQL,
}
