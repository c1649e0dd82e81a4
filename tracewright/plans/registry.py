"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from . import episode_queries, grader_queries, join_queries, metric_queries, phase_queries, plugin_queries, record_queries, source_queries, state_queries, stream_queries, text_queries, training_queries, tree_queries

MODULES = (phase_queries, metric_queries, tree_queries, text_queries, join_queries, state_queries, training_queries, record_queries, grader_queries, episode_queries, stream_queries, source_queries, plugin_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
