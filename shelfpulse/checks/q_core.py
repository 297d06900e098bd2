"""Registered queries: periods, market share, impacts, brand metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import capped, in_periods, label
from shelfpulse.operators import periods as P
from shelfpulse.plans import metrics as M
from shelfpulse.sources.views import Views

MS_KEYS = "account, gc_platform, bgr, gc_city, brand"



def share_of(part: str, whole: str) -> str:
    """Percent of the whole to one place; nothing sold at all gives 0."""
    percent = f"round(CAST({part} AS DOUBLE) * 100 / CAST({whole} AS DOUBLE), 1)"
    return f"CASE WHEN {whole} <> 0 THEN {percent} WHEN {whole} = 0 THEN 0.0 END"


SOLD = "sum(CASE is_own_brand WHEN 1 THEN reported_offtake_mrp ELSE normalized_offtake END)"

MARKET_SHARE_SQL_CTES = f"""
msd AS (SELECT product_id, lower(bgr) AS dim_bgr FROM product_dim),
msf AS (
  SELECT {label('m.snapshot_date')} AS date_period, m.account, lower(m.gc_platform) AS gc_platform,
    msd.dim_bgr AS bgr, m.gc_city, m.brand, m.is_own_brand, m.reported_offtake_mrp, m.normalized_offtake
  FROM pid_metrics m LEFT JOIN msd ON m.product_id = msd.product_id
  WHERE {capped('m.snapshot_date', 'm.platform_offtake_uploaded_till')}
),
msbrand AS (
  SELECT date_period, {MS_KEYS}, {SOLD} AS sold, sum(normalized_offtake) AS part
  FROM msf WHERE date_period IS NOT NULL GROUP BY ALL
),
mscity AS (
  SELECT *, sum(part) OVER city AS whole FROM msbrand
  WINDOW city AS (PARTITION BY date_period, account, gc_platform, bgr, gc_city)
),
msagg AS (
  SELECT date_period, {MS_KEYS}, CAST(sold AS DOUBLE) AS actual_sum, CAST(whole AS DOUBLE) AS category_size,
    {share_of('part', 'whole')} AS market_share
  FROM mscity
),
msflags AS (SELECT DISTINCT account, gc_platform, brand, is_own_brand FROM msf WHERE date_period IS NOT NULL),
ms AS (
  SELECT msagg.*, msflags.is_own_brand FROM msagg
  LEFT JOIN msflags ON msagg.account = msflags.account AND msagg.gc_platform = msflags.gc_platform AND msagg.brand = msflags.brand
)"""


def market_share_df(spark, sf):
    v = Views.shared(spark, sf)
    return M.market_share(v.pid_slice(L1, L2), v.product_dim(), L1, L2)


@register("market_share", with_views(MARKET_SHARE_SQL_CTES + "\nSELECT * FROM ms",
                                     ("pid_metrics", "product_dim")))
def q_market_share(spark, sf):
    return market_share_df(spark, sf)


CAT_MS_CTES = f"""
cmf AS (
  SELECT {label('snapshot_date', 'dr2')} AS date_period, account, gc_platform, bgr, brand, is_own_brand,
    reported_offtake_mrp, normalized_offtake
  FROM pid_metrics
  WHERE {capped()} AND is_own_brand IN (0, 1)
),
cmbrand AS (
  SELECT date_period, account, gc_platform, bgr, brand, is_own_brand, {SOLD} AS sold, sum(normalized_offtake) AS part
  FROM cmf GROUP BY ALL
),
cmwhole AS (
  SELECT *, sum(part) OVER category AS whole FROM cmbrand
  WINDOW category AS (PARTITION BY date_period, account, gc_platform, bgr)
),
cms AS (
  SELECT date_period, account, lower(gc_platform) AS gc_platform, lower(bgr) AS bgr, brand, is_own_brand,
    CAST(sold AS DOUBLE) AS actual_sum, CAST(whole AS DOUBLE) AS category_size, {share_of('part', 'whole')} AS market_share
  FROM cmwhole
)"""


def category_share_df(spark, sf):
    v = Views.shared(spark, sf)
    return M.market_share_category(v.pid_slice(L1, L2), L1, L2)


@register("market_share_category", with_views(CAT_MS_CTES + "\nSELECT * FROM cms"))
def q_market_share_category(spark, sf):
    return category_share_df(spark, sf)


# ---------------------------------------------------------------- impacts
IMPACT_COLS = ("size_dr1, share_dr1, actual_sales_dr1, size_dr2, share_dr2, actual_sales_dr2, "
               "pct_change, sales_impact")


def impact_sql(src: str, keys: str, where: str = "TRUE") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
    SELECT {sel},
      a.category_size AS size_dr1, a.market_share AS share_dr1, a.actual_sum AS actual_sales_dr1,
      b.category_size AS size_dr2, b.market_share AS share_dr2, b.actual_sum AS actual_sales_dr2,
      a.market_share - b.market_share AS pct_change,
      CAST(CAST(a.market_share - b.market_share AS DECIMAL(6,1)) * CAST(a.category_size AS DECIMAL(20,4)) * 0.01::DECIMAL(3,2) AS DOUBLE) AS sales_impact
    FROM (SELECT * FROM {src} WHERE date_period = 'dr1' AND {where}) a
    JOIN (SELECT * FROM {src} WHERE date_period = 'dr2' AND {where}) b ON {on}"""


@register("share_impact_city_brand", with_views(
    MARKET_SHARE_SQL_CTES + impact_sql("ms", MS_KEYS, "is_own_brand = 1"),
    ("pid_metrics", "product_dim")))
def q_share_impact_city_brand(spark, sf):
    ms = market_share_df(spark, sf).where(F.col("is_own_brand") == 1)
    return P.share_impact(ms, ["account", "gc_platform", "bgr", "gc_city", "brand"])


@register("share_impact_category", with_views(
    CAT_MS_CTES + impact_sql("cms", "account, gc_platform, bgr, brand", "is_own_brand = 1")))
def q_share_impact_category(spark, sf):
    ms = category_share_df(spark, sf).where(F.col("is_own_brand") == 1)
    return P.share_impact(ms, ["account", "gc_platform", "bgr", "brand"])


@register("share_impact_competitors", with_views(
    MARKET_SHARE_SQL_CTES + impact_sql("ms", MS_KEYS, "is_own_brand = 0"),
    ("pid_metrics", "product_dim")))
def q_share_impact_comp(spark, sf):
    ms = market_share_df(spark, sf).where(F.col("is_own_brand") == 0)
    return P.share_impact(ms, ["account", "gc_platform", "bgr", "gc_city", "brand"])


# ---------------------------------------------------------------- period ops
@register("period_label", with_views(f"""
SELECT {label()} AS date_period, count(*)::BIGINT AS n_rows,
  CAST(SUM(normalized_offtake) AS DOUBLE) AS offtake
FROM pid_metrics GROUP BY 1"""))
def q_period_label(spark, sf):
    v = Views.shared(spark, sf)
    d = P.label_period(v.pid_metrics(), "snapshot_date", L1, L2, "dr1")
    return d.groupBy("date_period").agg(F.count("*").cast("bigint").alias("n_rows"),
                                        F.sum("normalized_offtake").cast("double").alias("offtake"))


# overlapping windows make the L2-first rule visible
OV1 = ("2000-01-01", "2000-12-31")
OV2 = ("2000-07-01", "2001-06-30")


@register("period_label_l2_first", with_views(f"""
SELECT {label('snapshot_date', 'dr2', OV1, OV2)} AS date_period, count(*)::BIGINT AS n_rows
FROM pid_metrics GROUP BY 1"""))
def q_period_label_l2_first(spark, sf):
    v = Views.shared(spark, sf)
    d = P.label_period(v.pid_metrics(), "snapshot_date", OV1, OV2, "dr2")
    return d.groupBy("date_period").agg(F.count("*").cast("bigint").alias("n_rows"))


@register("period_filter", with_views(f"""
SELECT gc_platform, count(*)::BIGINT AS n_rows, min(snapshot_date) AS first_day, max(snapshot_date) AS last_day
FROM pid_metrics WHERE {in_periods()} GROUP BY gc_platform"""))
def q_period_filter(spark, sf):
    v = Views.shared(spark, sf)
    d = P.filter_periods(v.pid_metrics(), "snapshot_date", L1, L2)
    return d.groupBy("gc_platform").agg(F.count("*").cast("bigint").alias("n_rows"),
                                        F.min("snapshot_date").alias("first_day"),
                                        F.max("snapshot_date").alias("last_day"))


@register("period_filter_capped", with_views(f"""
SELECT {label()} AS date_period, gc_platform, count(*)::BIGINT AS n_rows,
  min(snapshot_date) AS first_day, max(snapshot_date) AS last_day
FROM pid_metrics WHERE {capped()} GROUP BY 1, 2"""))
def q_period_filter_capped(spark, sf):
    v = Views.shared(spark, sf)
    d = P.filter_periods_capped(v.pid_metrics(), "snapshot_date", L1, L2)
    d = P.label_period(d, "snapshot_date", L1, L2)
    return d.groupBy("date_period", "gc_platform").agg(
        F.count("*").cast("bigint").alias("n_rows"),
        F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day"))
