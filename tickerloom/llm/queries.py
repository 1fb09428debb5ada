"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import bpe, chat_format, code_compression, embedding_dedup, exact_dedup, fingerprints, jaccard_join, language_id, line_dedup, packing, secret_scan, token_alignment, warc

MODULES = (bpe, jaccard_join, exact_dedup, language_id, secret_scan, warc, line_dedup, chat_format, fingerprints, packing, code_compression, token_alignment, embedding_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
