"""All registered queries, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis_queries, block_queries, compare_queries, edit_queries, glyph_queries, layout_queries, mark_queries, page_queries, replay_queries, text_queries, unit_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for part in (compare_queries, page_queries, text_queries, analysis_queries, unit_queries, layout_queries, block_queries, edit_queries, replay_queries, glyph_queries, mark_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
