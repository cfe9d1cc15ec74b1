"""Registry of named queries: a Spark builder and (where exact) its DuckDB oracle.

Every builder takes ``(spark, sf_dir)`` and reads the driver tables, so its
work grows with them. Oracle SQL reads the same tables through the ``panel``
common table (see ``panelrisk.sources.fixture.FIXTURE_PANEL_SQL``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelrisk.sources.fixture import with_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, panel: bool = True):
    """Register a query builder; ``sql`` is its oracle (``None`` → rows-only)."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_panel(sql) if panel else sql.strip()
        return fn

    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from panelrisk.queries import (  # noqa: F401
        q_panel,
        q_features,
        q_splits,
        q_metrics,
        q_ranking,
        q_forecast,
        q_models,
        q_flows,
        q_io,
        q_streaming,
    )
