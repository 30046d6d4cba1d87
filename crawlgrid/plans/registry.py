"""Query registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable

from crawlgrid.plans.oracle_views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    its DuckDB oracle over the driver tables (views from ``oracle_views``)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from crawlgrid.plans import (q_reads, q_functions, q_dispatch, q_logs,  # noqa: F401
                                 q_lifecycle, q_sinks, q_streams, q_plugins)
