"""Registered queries: drill-down (H9) with quantile price tiers (SQL-expressible)."""

from __future__ import annotations


from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_core import CAT_MS_CTES, MARKET_SHARE_SQL_CTES, MS_KEYS, impact_sql
from shelfpulse.checks.q_keywords import keyword_totals
from shelfpulse.checks.q_metrics import BM_CITY, CITY_KEYS, METRICS, NAMES, SKU_COMPARE_CTES, change_sql, sku_metrics
from shelfpulse.checks.q_tiers import KMEANS_CTES, PPU_CTES, recursive
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.plans import drilldown as D
from shelfpulse.plans import keywords as K
from shelfpulse.plans import metrics as M
from shelfpulse.plans import stores as ST
from shelfpulse.plans import tiers as TR
from shelfpulse.sources.views import Views

CAT = "account, gc_platform, bgr, brand"
IMP = "size_dr1, share_dr1, actual_sales_dr1, size_dr2, share_dr2, actual_sales_dr2, pct_change"


def on(a, b, keys):
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def drill_ctes(direction: str, tiers: str = PPU_CTES) -> str:
    cat_cut, city_cut = D.CUTS[direction]
    side = "impact_loss" if direction == "down" else "impact_gain"
    cmp_ = "<" if direction == "down" else ">"
    order = "ASC" if direction == "down" else "DESC"
    return (MARKET_SHARE_SQL_CTES + ",\n" + CAT_MS_CTES.strip() + ",\n" + tiers.strip() + ",\n"
            + BM_CITY.strip() + ",\n" + SKU_COMPARE_CTES.strip() + f""",
bmch AS ({change_sql("bm", CITY_KEYS + ["is_own_brand"], METRICS, NAMES, False)}),
own_imp AS (SELECT *, 1 AS is_own_brand FROM ({impact_sql("ms", MS_KEYS, "is_own_brand = 1")}) x
            WHERE gc_city IS DISTINCT FROM 'Others'),
comp_imp AS (SELECT *, 0 AS is_own_brand FROM ({impact_sql("ms", MS_KEYS, "is_own_brand = 0")}) x
            WHERE gc_city IS DISTINCT FROM 'Others'),
cat_imp AS ({impact_sql("cms", CAT, "is_own_brand = 1")}),
split AS (
  SELECT {CAT}, is_own_brand,
    CAST(SUM(CASE WHEN sales_impact < 0 THEN CAST(sales_impact AS DECIMAL(38,7)) END) AS DOUBLE) AS impact_loss,
    CAST(SUM(CASE WHEN sales_impact > 0 THEN CAST(sales_impact AS DECIMAL(38,7)) END) AS DOUBLE) AS impact_gain
  FROM own_imp WHERE account IS NOT NULL AND gc_platform IS NOT NULL AND bgr IS NOT NULL AND brand IS NOT NULL
  GROUP BY {CAT}, is_own_brand
),
cand AS (
  SELECT s.account, s.gc_platform, s.bgr, s.brand, s.is_own_brand, s.{side} AS sales_impact,
    {', '.join('c.' + x.strip() for x in IMP.split(','))}
  FROM split s LEFT JOIN cat_imp c ON {on('s', 'c', CAT)}
  WHERE s.{side} IS NOT NULL
),
drivers AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY account, gc_platform ORDER BY sales_impact {order} NULLS LAST,
      bgr ASC NULLS LAST, brand ASC NULLS LAST) AS rank
    FROM cand WHERE sales_impact {cmp_} {cat_cut}) WHERE rank <= 2
),
cities AS (
  SELECT * FROM (
    SELECT o.*, row_number() OVER (PARTITION BY {', '.join('o.' + x.strip() for x in CAT.split(','))}
      ORDER BY o.sales_impact {order} NULLS LAST, o.gc_city ASC NULLS LAST) AS city_rank
    FROM own_imp o
    WHERE o.sales_impact {cmp_} {city_cut}
      AND EXISTS (SELECT 1 FROM drivers d WHERE {on('o', 'd', CAT)})) WHERE city_rank <= 3
),
brand_rows AS (
  SELECT c.* EXCLUDE (city_rank), t.ppu_category, t.wt_ppu,
    {', '.join('m.' + x for x in ['wt_osa_dr1', 'wt_osa_in_ls_dr1', 'wt_discounting_dr1', 'sov_dr1', 'ad_sov_dr1', 'organic_sov_dr1', 'change_wt_osa', 'change_wt_osa_listing', 'change_wt_discounting', 'change_sov', 'change_adsov', 'change_ogsov'])}
  FROM cities c
  LEFT JOIN tiers t ON {on('c', 't', CAT)}
  LEFT JOIN bmch m ON {on('c', 'm', MS_KEYS)} AND c.is_own_brand = m.is_own_brand
  WHERE c.city_rank = 1
),
comp AS (
  SELECT ci.*, t.ppu_category FROM comp_imp ci LEFT JOIN tiers t ON {on('ci', 't', CAT)}
  WHERE ci.pct_change > 0
),
lv AS (
  SELECT * FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.account, c.gc_platform, c.bgr, c.gc_city, c.ppu_category
      ORDER BY c.pct_change DESC NULLS LAST, c.brand ASC NULLS LAST) AS comp_rank, 1 AS level
    FROM comp c WHERE EXISTS (SELECT 1 FROM brand_rows b WHERE b.account = c.account AND b.gc_platform = c.gc_platform
      AND b.bgr = c.bgr AND b.gc_city = c.gc_city AND b.ppu_category = c.ppu_category)) WHERE comp_rank <= 2
  UNION ALL
  SELECT * FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.account, c.gc_platform, c.bgr, c.gc_city
      ORDER BY c.pct_change DESC NULLS LAST, c.brand ASC NULLS LAST) AS comp_rank, 2 AS level
    FROM comp c WHERE EXISTS (SELECT 1 FROM brand_rows b WHERE b.account = c.account AND b.gc_platform = c.gc_platform
      AND b.bgr = c.bgr AND b.gc_city = c.gc_city)) WHERE comp_rank <= 2
  UNION ALL
  SELECT * FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.account, c.gc_platform, c.bgr
      ORDER BY c.pct_change DESC NULLS LAST, c.brand ASC NULLS LAST) AS comp_rank, 3 AS level
    FROM comp c) WHERE comp_rank <= 2
),
comps AS (SELECT * EXCLUDE (minlv) FROM (SELECT *, min(level) OVER (PARTITION BY account) AS minlv FROM lv) WHERE level = minlv),
own_sku AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.account, s.gc_platform, s.bgr, s.gc_city, s.brand
      ORDER BY s.change_market_share {order} NULLS LAST, s.product_id ASC NULLS LAST) AS rn
    FROM sc s WHERE EXISTS (SELECT 1 FROM brand_rows b WHERE {on('s', 'b', MS_KEYS)})) WHERE rn = 1
)""")


def store_aggregate(v):
    """Writes the store x SKU aggregate once per session."""
    return lambda g: v.materialize(("store_agg", L1, L2), lambda: g)


def inputs(v):
    """Memoised metric frames over the window slice (built once per session)."""
    pm, dim = v.pid_slice(L1, L2), v.product_dim()
    return {
        "ms": lambda: v.materialize(("ms", L1, L2), lambda: M.market_share(pm, dim, L1, L2)),
        "cms": lambda: v.materialize(("cms", L1, L2), lambda: M.market_share_category(pm, L1, L2)),
        "tiers": lambda: v.materialize(("tiers_q", L1), lambda: TR.price_tiers(pm, dim, L1, method="quantile")),
        "tiers_km": lambda: v.materialize(("tiers_km", L1), lambda: TR.price_tiers(pm, dim, L1, method="auto")),
        "ch": lambda: v.materialize(("bm_change", L1, L2), lambda: M.brand_metrics_change(
            M.brand_metrics(pm, dim, L1, L2))),
        "sku": lambda: v.materialize(("sku_cmp", L1, L2), lambda: M.sku_compare(sku_metrics(v))),
        "kwt": lambda: v.materialize(("kwt", L1, L2), lambda: keyword_totals(v)),
        "kws": lambda: v.materialize(("kw_scores", L1, L2), lambda: K.keyword_scores(keyword_totals(v))),
        "contrib": lambda: v.materialize(("contribution", L1), lambda: K.contribution(pm, L1)),
        "psl": lambda: v.materialize(("psl_rows", L1, L2), lambda: ST.psl_by_store(
            ST.sku_store_osa(v.window_slice("locality_metrics", L1, L2), L1, L2, once=store_aggregate(v)),
            v.window_slice("psl_daily_locality", L1, L2), v.own_sku_base(), L1)),
        "catm": lambda: v.materialize(("catm", L1, L2), lambda: M.category_metrics(pm, dim, L1, L2)),
    }


TIER_FREE = ("own", "comp", "cat_imp", "drivers", "cities")       # frames that read no price tier


def frames(spark, sf, direction, views=None, tiers="quantile"):
    """Drill-down frames; ``tiers`` says whether brands are compared within quantile or
    k-means price tiers."""
    v = views or Views.shared(spark, sf)

    def build():
        i = inputs(v)
        return D.drilldown(i["ms"], i["cms"], i["tiers" if tiers == "quantile" else "tiers_km"], i["ch"], i["sku"],
                           direction, wrap=lambda k, df: v.materialize(
                               ("drill", direction, k) if k in TIER_FREE else ("drill", direction, tiers, k), lambda: df))
    return v.memo(("drill", direction, tiers), build)


def _reg(key, direction, part, sql_select=None, tiers="quantile"):
    views = ("pid_metrics", "product_dim")
    if tiers == "kmeans":
        sql = recursive(with_views(drill_ctes(direction, KMEANS_CTES) + "\n" + sql_select, views))
    else:
        sql = None if sql_select is None else with_views(drill_ctes(direction) + "\n" + sql_select, views)

    @register(key, sql)
    def q(spark, sf):
        return frames(spark, sf, direction, tiers=tiers)[part]
    q.__name__ = f"q_{key}"
    return q


_reg("worst_categories", "down", "drivers", "SELECT * FROM drivers")
_reg("best_categories", "up", "drivers", "SELECT * FROM drivers")
_reg("worst_cities", "down", "cities", "SELECT * FROM cities")
_reg("best_cities", "up", "cities", "SELECT * FROM cities")
_reg("drilldown_down", "down", "brand_rows", "SELECT * FROM brand_rows")
_reg("drilldown_up", "up", "brand_rows", "SELECT * FROM brand_rows")
_reg("rising_competitors", "down", "competitors", "SELECT * FROM comps")
_reg("driver_sku", "down", "own_sku", "SELECT * FROM own_sku")
_reg("rising_competitors_up", "up", "competitors", "SELECT * FROM comps")
_reg("driver_sku_up", "up", "own_sku", "SELECT * FROM own_sku")

COMP_SKU_SQL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.account, s.gc_platform, s.bgr, s.gc_city, s.brand
    ORDER BY s.change_market_share DESC NULLS LAST, s.product_id ASC NULLS LAST) AS rn
  FROM sc s WHERE EXISTS (SELECT 1 FROM comps b WHERE {on('s', 'b', MS_KEYS)})) WHERE rn = 1"""
_reg("competitor_sku", "down", "comp_sku", COMP_SKU_SQL)
_reg("competitor_sku_up", "up", "comp_sku", COMP_SKU_SQL)
_reg("drilldown_down_kmeans", "down", "brand_rows", "SELECT * FROM brand_rows", tiers="kmeans")
_reg("rising_competitors_kmeans", "down", "competitors", "SELECT * FROM comps", tiers="kmeans")


def drivers_sql(direction: str, suffix: str) -> str:
    """The category-driver CTEs of one direction under suffixed names (to sit
    next to the other direction's CTEs in one statement)."""
    cat_cut = D.CUTS[direction][0]
    side = "impact_loss" if direction == "down" else "impact_gain"
    cmp_ = "<" if direction == "down" else ">"
    order = "ASC" if direction == "down" else "DESC"
    return f""",
cand{suffix} AS (
  SELECT s.account, s.gc_platform, s.bgr, s.brand, s.is_own_brand, s.{side} AS sales_impact,
    {', '.join('c.' + x.strip() for x in IMP.split(','))}
  FROM split s LEFT JOIN cat_imp c ON {on('s', 'c', CAT)}
  WHERE s.{side} IS NOT NULL
),
drivers{suffix} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY account, gc_platform ORDER BY sales_impact {order} NULLS LAST,
      bgr ASC NULLS LAST, brand ASC NULLS LAST) AS rank
    FROM cand{suffix} WHERE sales_impact {cmp_} {cat_cut}) WHERE rank <= 2
)"""
