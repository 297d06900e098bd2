"""Registered queries: versioned tables and state folded day by day."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.registry import register
from shelfpulse.session import checkpoint_dir
from shelfpulse.sources.tables import scan_table
from shelfpulse.sources.versioned import VersionedTable, first_seen_between, fold_days, uploaded_till
from shelfpulse.sources.views import Views

KEYS = ["account", "gc_platform", "product_id"]
SEEN = """
seen AS (SELECT account, gc_platform, product_id, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen,
         count(*) AS n_rows FROM pid_metrics WHERE snapshot_date IS NOT NULL GROUP BY 1, 2, 3)"""


def _table(spark, name):
    return VersionedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/versioned/{name}-{uuid.uuid4().hex}")


def _folded(spark, sf):
    """The SKU state, folded in two steps: days up to the middle of 1996, then all later ones."""
    def build():
        facts = Views.shared(spark, sf).pid_metrics().select(*KEYS, "snapshot_date")
        table = _table(spark, "seen")
        fold_days(table, facts.where(F.col("snapshot_date") <= F.lit("1996-06-30").cast("date")), KEYS, "snapshot_date")
        return fold_days(table, facts, KEYS, "snapshot_date")
    return Views.shared(spark, sf).memo(("folded", "sku"), build)


@register("first_seen_folded", with_views(SEEN + "\nSELECT * FROM seen", ("pid_metrics",)))
def q_first_seen_folded(spark, sf):
    return _folded(spark, sf)


@register("first_seen_between_folded", with_views(
    SEEN + "\nSELECT * FROM seen WHERE first_seen BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", ("pid_metrics",)))
def q_first_seen_between_folded(spark, sf):
    return first_seen_between(_folded(spark, sf), "1997-01-01", "1999-12-31")


@register("uploaded_till_folded", with_views(
    "SELECT account, gc_platform, max(snapshot_date) AS last_updated FROM pid_metrics GROUP BY 1, 2", ("pid_metrics",)))
def q_uploaded_till_folded(spark, sf):
    return uploaded_till(_folded(spark, sf))


@register("sink_versioned", """
SELECT n_nationkey, n_name, NULL AS note FROM nation WHERE n_regionkey < 3
UNION ALL SELECT n_nationkey, n_name, 'late' FROM nation WHERE n_regionkey >= 3""")
def q_sink_versioned(spark, sf):
    """Overwrite, overwrite by a query over the table itself, then append with a new column."""
    nation = scan_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    table = _table(spark, "nation")
    table.overwrite(nation)
    table.overwrite(table.read().where("n_regionkey < 3").drop("n_regionkey"))
    table.append(nation.where("n_regionkey >= 3").select("n_nationkey", "n_name", F.lit("late").alias("note")))
    return table.read()
