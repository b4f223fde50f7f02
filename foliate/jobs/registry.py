"""Queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliate.operators.textindex import TextIndex, build
from foliate.session import table

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "usage_tool_aggregates"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_INDEXES: dict[tuple, TextIndex] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) as a query."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def indexed(spark: SparkSession, folder: str, parts: dict[str, str]) -> TextIndex:
    """The text index of a folder's documents, built by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, folder, *parts.items())
    if key not in _INDEXES:
        _INDEXES[key] = build(table(spark, folder, "documents"), "doc_id", parts)
    return _INDEXES[key]


def _load() -> None:
    """Imports the modules that register queries."""
    from foliate.jobs import backlog_queries, graph_queries, history_queries, note_queries, ranking_queries, search_queries, table_queries, time_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
