"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, chat_format, exact_dedup, fingerprints, language_id, line_dedup, mixing, near_dup, nearest, snapshot_diff, substring_dedup, token_files, whitening

MODULES = (chat_format, mixing, language_id, bpe, substring_dedup, nearest, token_files, exact_dedup, line_dedup, near_dup, snapshot_diff, fingerprints, whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
