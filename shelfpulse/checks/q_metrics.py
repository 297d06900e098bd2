"""Registered queries: brand / category / SKU metrics and grammage (H4-H6, H8)."""

from __future__ import annotations

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_core import CAT_MS_CTES
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import capped, in_periods, label, null_greatest, weight
from shelfpulse.plans import metrics as M
from shelfpulse.sources.views import Views

W = weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
QW = null_greatest("estimated_qty_sold", "1")


def brand_metrics_ctes(keys: list[str], tkeys: list[str], lab: str = label()) -> str:
    k = ", ".join(keys)
    tk = ", ".join(tkeys)
    on = lambda a, b, ks: " AND ".join(f"{a}.{x} = {b}.{x}" for x in ks)
    kp = [x for x in keys]
    return f"""
valid AS (SELECT DISTINCT product_id FROM product_dim WHERE is_platform_bundle IS NULL),
src AS (
  SELECT m.*, {lab} AS date_period, lower(m.bgr) AS lbgr FROM pid_metrics m WHERE {in_periods('m.snapshot_date')}
),
src2 AS (SELECT * EXCLUDE (bgr, lbgr), lbgr AS bgr FROM src),
wt AS (
  SELECT {k}, date_period,
    SUM(total_available * {W}) AS total_wt_available,
    SUM(total_listed * {W}) AS total_wt_listed,
    SUM(total_scrapes * {W}) AS total_wt_scrapes
  FROM src2 s WHERE s.product_id IN (SELECT product_id FROM valid)
  GROUP BY {k}, date_period
),
bp AS (
  SELECT {k}, date_period, SUM(mrp * {QW}) AS wt_mrp, SUM(price * {QW}) AS wt_price
  FROM src2 WHERE asp_flag = 1 GROUP BY {k}, date_period
),
mbi AS (
  SELECT {k}, date_period, round(SUM(total_impressions), 0) AS ti, round(SUM(ad_impressions), 0) AS ai,
    round(SUM(total_impressions) - SUM(ad_impressions), 0) AS oi
  FROM src2 GROUP BY {k}, date_period
),
mi AS (
  SELECT {tk}, date_period, round(SUM(total_impressions), 0) AS ti, round(SUM(ad_impressions), 0) AS ai,
    round(SUM(total_impressions) - SUM(ad_impressions), 0) AS oi
  FROM src2 GROUP BY {tk}, date_period
),
bs AS (
  SELECT {', '.join('mbi.' + x for x in kp)}, mbi.date_period,
    coalesce(round(CAST(mbi.ti AS DOUBLE) / nullif(CAST(mi.ti AS DOUBLE), 0), 3) * 100.0, 0) AS sov,
    coalesce(round(CAST(mbi.ai AS DOUBLE) / nullif(CAST(mi.ai AS DOUBLE), 0), 3) * 100.0, 0) AS ad_sov,
    coalesce(round(CAST(mbi.oi AS DOUBLE) / nullif(CAST(mi.oi AS DOUBLE), 0), 3) * 100.0, 0) AS organic_sov
  FROM mbi JOIN mi ON {on('mbi', 'mi', tkeys + ['date_period'])}
),
merged AS (
  SELECT wt.*, bp.wt_mrp, bp.wt_price, bs.sov, bs.ad_sov, bs.organic_sov
  FROM wt
  LEFT JOIN bp ON {on('wt', 'bp', keys + ['date_period'])}
  LEFT JOIN bs ON {on('wt', 'bs', keys + ['date_period'])}
),
bi AS (SELECT DISTINCT account, gc_platform, brand, is_own_brand FROM src2),
bm AS (
  SELECT {', '.join('merged.' + x for x in keys)}, merged.date_period, bi.is_own_brand,
    round(100.0 * CAST(total_wt_available AS DOUBLE) / nullif(CAST(total_wt_scrapes AS DOUBLE), 0), 1) AS wt_osa,
    round(100.0 * CAST(total_wt_available AS DOUBLE) / nullif(CAST(total_wt_listed AS DOUBLE), 0), 1) AS wt_osa_in_ls,
    round(100.0 * CAST(wt_mrp - wt_price AS DOUBLE) / nullif(CAST(wt_mrp AS DOUBLE), 0), 1) AS wt_discounting,
    sov, ad_sov, organic_sov
  FROM merged LEFT JOIN bi ON merged.account = bi.account AND merged.gc_platform = bi.gc_platform AND merged.brand = bi.brand
)"""


CITY_KEYS = ["account", "gc_platform", "bgr", "gc_city", "brand"]
CAT_KEYS = ["account", "gc_platform", "bgr", "brand"]
BM_CITY = brand_metrics_ctes(CITY_KEYS, ["account", "gc_platform", "bgr", "gc_city"])
BM_CAT = brand_metrics_ctes(CAT_KEYS, ["account", "gc_platform", "bgr"])
METRICS = ["wt_osa", "wt_osa_in_ls", "wt_discounting", "sov", "ad_sov", "organic_sov"]
NAMES = {"organic_sov": "ogsov", "ad_sov": "adsov", "wt_osa_in_ls": "wt_osa_listing"}


def change_sql(src: str, keys: list[str], metrics: list[str], names: dict, rounded: bool) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    cols = [f"a.{k}" for k in keys] + [f"a.{m} AS {m}_dr1" for m in metrics]
    for m in metrics:
        d = f"CAST(a.{m} AS DOUBLE) - CAST(b.{m} AS DOUBLE)"
        cols.append(f"{'round_even((' + d + ') * 10.0, 0) / 10.0' if rounded else d} AS change_{names.get(m, m)}")
    return (f"SELECT {', '.join(cols)} FROM (SELECT * FROM {src} WHERE date_period = 'dr1') a "
            f"LEFT JOIN (SELECT * FROM {src} WHERE date_period = 'dr2') b ON {on}")


def _views(spark, sf):
    return Views.shared(spark, sf)


@register("brand_metrics", with_views(BM_CITY + "\nSELECT * FROM bm", ("pid_metrics", "product_dim")))
def q_brand_metrics(spark, sf):
    v = _views(spark, sf)
    return M.brand_metrics(v.pid_slice(L1, L2), v.product_dim(), L1, L2)


@register("brand_metrics_change", with_views(
    BM_CITY + ",\nch AS (" + change_sql("bm", CITY_KEYS + ["is_own_brand"], METRICS, NAMES, False)
    + ")\nSELECT * FROM ch", ("pid_metrics", "product_dim")))
def q_brand_metrics_change(spark, sf):
    v = _views(spark, sf)
    return M.brand_metrics_change(M.brand_metrics(v.pid_slice(L1, L2), v.product_dim(), L1, L2))


CATEGORY_METRICS_SQL = with_views(
    BM_CAT + ",\nch AS (" + change_sql("bm", CAT_KEYS + ["is_own_brand"], METRICS, NAMES, False)
    + "),\n" + CAT_MS_CTES.strip() + ",\nsh AS (" + change_sql("cms", CAT_KEYS, ["market_share"], {}, True)
    + ")\nSELECT ch.*, sh.market_share_dr1, sh.change_market_share FROM ch LEFT JOIN sh ON "
    + " AND ".join(f"ch.{k} = sh.{k}" for k in CAT_KEYS), ("pid_metrics", "product_dim"))


@register("category_metrics", CATEGORY_METRICS_SQL)
def q_category_metrics(spark, sf):
    v = _views(spark, sf)
    return M.category_metrics(v.pid_slice(L1, L2), v.product_dim(), L1, L2)


PPU_W = null_greatest("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
PM_KEYS = ["account", "gc_platform", "product_id", "title", "grammage", "bgr", "gc_city", "brand"]
PM_CTES = f"""
pmf AS (
  SELECT * EXCLUDE (bgr, grammage), lower(bgr) AS bgr, original_grammage AS grammage,
    {label('snapshot_date', 'dr2')} AS date_period
  FROM pid_metrics WHERE {capped()} AND is_own_brand IN (0, 1)
),
pmg AS (
  SELECT {', '.join(PM_KEYS)}, date_period,
    CAST(SUM(reported_offtake_mrp) AS DOUBLE) AS offtake_mrp,
    CAST(SUM(reported_offtake_sp) AS DOUBLE) AS offtake_sp,
    CAST(AVG(CASE WHEN asp_flag = 1 THEN price END) AS DOUBLE) AS sp,
    CAST(AVG(CASE WHEN asp_flag = 1 THEN mrp END) AS DOUBLE) AS mrp,
    CAST(SUM(reported_offtake_qty) AS DOUBLE) AS units,
    SUM(total_listed) AS l, SUM(total_scrapes) AS s,
    SUM(total_available * {W}) AS wa, SUM(total_scrapes * {W}) AS ws, SUM(total_listed * {W}) AS wl,
    SUM(CASE WHEN asp_flag = 1 THEN mrp * {QW} END) AS wmrp,
    SUM(CASE WHEN asp_flag = 1 THEN price * {QW} END) AS wprice,
    SUM(normalized_offtake) AS no_, SUM(total_impressions) AS ti, SUM(organic_impressions) AS oi,
    SUM(ad_impressions) AS ai,
    SUM(CASE WHEN ppu_flag = 1 THEN price_per_100_units * {PPU_W} END) AS pn,
    SUM(CASE WHEN ppu_flag = 1 THEN {PPU_W} END) AS pd
  FROM pmf GROUP BY {', '.join(PM_KEYS)}, date_period
),
pm AS (
  SELECT {', '.join(PM_KEYS)}, date_period, offtake_mrp, offtake_sp, sp, mrp, units,
    100 * CAST(l AS DOUBLE) / NULLIF(CAST(s AS DOUBLE), 0) AS ds_listing,
    CAST(wa AS DOUBLE) * 100.0 / NULLIF(CAST(ws AS DOUBLE), 0) AS wt_osa,
    CAST(wa AS DOUBLE) * 100.0 / NULLIF(CAST(wl AS DOUBLE), 0) AS wt_osa_in_ls,
    (CAST(wmrp AS DOUBLE) - CAST(wprice AS DOUBLE)) * 100.0 / NULLIF(CAST(wmrp AS DOUBLE), 0) AS wt_discounting,
    CAST(no_ AS DOUBLE) / NULLIF(CAST(SUM(no_) OVER w AS DOUBLE), 0) * 100.0 AS market_share,
    CAST(ti AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(ti) OVER w AS DOUBLE), 0) AS sov,
    CAST(oi AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(oi) OVER w AS DOUBLE), 0) AS organic_sov,
    CAST(ai AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(ai) OVER w AS DOUBLE), 0) AS ad_sov,
    CAST(pn AS DOUBLE) / NULLIF(CAST(pd AS DOUBLE), 0) AS wt_ppu
  FROM pmg
  WINDOW w AS (PARTITION BY account, gc_platform, bgr, gc_city, date_period)
)"""


def sku_metrics(v):
    """Product metrics on the SKU aggregate, which is written once per session."""
    return M.product_metrics(v.pid_slice(L1, L2), None, L1, L2,
                             once=lambda g: v.materialize(("sku_agg", L1, L2), lambda: g))


@register("product_metrics", with_views(PM_CTES + "\nSELECT * FROM pm"))
def q_product_metrics(spark, sf):
    return sku_metrics(_views(spark, sf))


SKU_KEYS = ["account", "gc_platform", "bgr", "gc_city", "brand", "product_id", "title"]
SKU_M = ["ds_listing", "wt_osa", "wt_osa_in_ls", "wt_discounting", "sov", "ad_sov",
         "organic_sov", "market_share"]
SKU_COMPARE_CTES = PM_CTES + ",\nsc AS (" + change_sql("pm", SKU_KEYS, SKU_M, {}, True) + ")"


@register("compare_periods", with_views(SKU_COMPARE_CTES + "\nSELECT * FROM sc"))
def q_compare_periods(spark, sf):
    return M.sku_compare(sku_metrics(_views(spark, sf)))


GRAMMAGE_CTES = f"""
gr AS (
  SELECT m.account, lower(m.gc_platform) AS gc_platform, lower(d.bgr) AS bgr, m.brand, m.product_id,
    AVG(d.grammage) AS grammage
  FROM pid_metrics m LEFT JOIN product_dim d ON m.product_id = d.product_id
  WHERE {capped('m.snapshot_date', 'm.platform_offtake_uploaded_till')}
  GROUP BY 1, 2, 3, 4, 5
)"""


@register("grammage", with_views(GRAMMAGE_CTES + "\nSELECT * FROM gr", ("pid_metrics", "product_dim")))
def q_grammage(spark, sf):
    v = _views(spark, sf)
    return M.grammage(v.pid_slice(L1, L2), v.product_dim(), L1, L2)
