"""Registered queries: one Spark callable and (when SQL can state it) one DuckDB oracle
statement per operator key of SURVEY section 2.

Every query reads the driver's tables through ``shelfpulse.sources.views`` so its
work grows with the data.  The windows are L1 = year 2000 (current) and
L2 = year 1999 (comparison).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfpulse.checks.sqlbits import L1, L2

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register a Spark query under ``key`` with its oracle SQL."""
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from shelfpulse.checks import (q_core, q_drill, q_grains, q_keywords, q_metrics, q_ops, q_ops2,  # noqa: F401
                                   q_recs, q_report, q_state, q_stores, q_summaries, q_tiers)
    for key, sql in q_report.ORACLE_EXTRA.items():
        ORACLE.setdefault(key, sql)
    ORACLE.setdefault("what_happened", q_summaries.WHAT_HAPPENED_SQL)
    ORACLE.setdefault("gain_summary", q_summaries.GAIN_SUMMARY_SQL)
    for key, sql in q_recs.ORACLE_EXTRA.items():
        ORACLE.setdefault(key, sql)


__all__ = ["QUERIES", "ORACLE", "register", "load_all", "L1", "L2"]
