"""Decorator and lists of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from .testgraph import Tables, sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
EXAMPLES: dict[str, tuple[Callable, str]] = {}


def query(body: str | None = None, *parts: str):
    """Register a function of Tables; ``body`` is its SQL over the named pieces of the graph."""

    def register(fn):
        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if body is not None:
            ORACLES[fn.__name__] = sql(body, *parts) if parts else body
        return fn

    return register


def example(body: str):
    """Keep a function of Tables that works on a small typed project, with its expected rows as SQL: run by tests only, as
    registered queries read the given tables."""

    def register(fn):
        EXAMPLES[fn.__name__] = (lambda spark, sf_dir: fn(Tables(spark, sf_dir)), body)
        return fn

    return register


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from . import queries_aggregates, queries_changes, queries_cypher, queries_extract, queries_indexes, queries_joins, queries_paths, queries_scans, queries_service, queries_streams, queries_values, queries_writes  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
