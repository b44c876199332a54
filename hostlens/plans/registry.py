"""Query registry: key -> (Spark plan builder, DuckDB oracle SQL or None).

Plan modules register their queries with ``@query(key, oracle=...)``;
``__spark_entry__`` exposes the registry to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from hostlens.plans import (  # noqa: F401
        core, passthrough, geo, accounts, turns, text, search,
    )
