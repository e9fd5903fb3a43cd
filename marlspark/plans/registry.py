"""All registered queries of the engine, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = ["relational_queries", "corpus_queries", "search_queries", "analytics_queries", "graph_queries", "text_queries", "topic_queries", "stream_queries", "report_queries", "page_queries", "claim_queries", "standing_queries", "place_queries", "answer_queries"]
_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with the SQL of its result where SQL can state it."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"marlspark.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
