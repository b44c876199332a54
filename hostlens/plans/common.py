"""Shared helpers for plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostlens.operators.guard import guarded_sql
from hostlens.session import EngineSession
from hostlens.sources.standins import STANDIN_VIEWS, oracle_with
from hostlens.sources.tables import RAW_TABLES, register_all


def session(spark: SparkSession, sf_dir: str, materialise: bool = False, land: bool = True) -> EngineSession:
    """Register the tables of ``sf_dir`` and open an engine session over them.
    The registered queries use a result once, so it stays lazy.  Queries that do
    not read ``host`` say ``land=False``, and it is not built for them."""
    register_all(spark, sf_dir, land)
    return EngineSession(spark, host=spark.table("host"), taxonomy=spark.table("taxonomy"), materialise=materialise,
                         views=(*RAW_TABLES, *STANDIN_VIEWS))


def guarded(spark: SparkSession, sf_dir: str, sql: str, land: bool = True) -> DataFrame:
    """Run user SQL through the guard (no emptiness job at plan time)."""
    return guarded_sql(session(spark, sf_dir, land=land), sql, check_empty=False)


def oracle(sql: str, *views: str) -> str:
    """Oracle text: the domain views the query needs as CTEs, then ``sql``.

    A ``sql`` that starts with its own ``WITH`` is merged into one clause."""
    if not views:
        return sql
    head = oracle_with(*views)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return head.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head.rstrip() + ",\n" + body[5:]
    return head + body
