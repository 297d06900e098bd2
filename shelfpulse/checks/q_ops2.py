"""Registered queries: aggregates, top-k and scalar functions of SURVEY 2.4-2.8."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_core import MARKET_SHARE_SQL_CTES, MS_KEYS, impact_sql
from shelfpulse.checks.q_metrics import BM_CITY, CITY_KEYS, METRICS, NAMES, SKU_COMPARE_CTES, change_sql, sku_metrics
from shelfpulse.checks.q_tiers import PPU_CTES
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import between, in_periods, label, null_greatest
from shelfpulse.functions import exprs as X
from shelfpulse.functions import text as T
from shelfpulse.operators import aggregates as A
from shelfpulse.operators import topk as TK
from shelfpulse.operators.periods import label_period, share_impact
from shelfpulse.operators.selection import group_quantiles
from shelfpulse.plans import metrics as M
from shelfpulse.plans import tiers as TR
from shelfpulse.sources import tables as S
from shelfpulse.sources.views import Views

CITY = ["account", "gc_platform", "bgr", "gc_city", "brand"]


def _ms(spark, sf):
    v = Views.shared(spark, sf)
    return M.market_share(v.pid_slice(L1, L2), v.product_dim(), L1, L2)


def _own_imp(spark, sf):
    return share_impact(_ms(spark, sf).where(F.col("is_own_brand") == 1), CITY)


OWN_IMP = MARKET_SHARE_SQL_CTES + ",\noi AS (" + impact_sql("ms", MS_KEYS, "is_own_brand = 1") + ")"
MSV = ("pid_metrics", "product_dim")


@register("uploaded_till", with_views("""
SELECT account, lower(gc_platform) AS gc_platform, max(snapshot_date) AS last_updated
FROM pid_metrics GROUP BY 1, 2"""))
def q_uploaded_till(spark, sf):
    return A.uploaded_till(Views.shared(spark, sf).pid_metrics())


@register("offtake_sum", with_views(f"""
SELECT {label()} AS date_period, account, gc_platform, bgr,
  CAST(SUM(reported_offtake_mrp) AS DOUBLE) AS reported_offtake_mrp,
  CAST(SUM(normalized_offtake) AS DOUBLE) AS normalized_offtake
FROM pid_metrics WHERE {in_periods()} GROUP BY 1, 2, 3, 4"""))
def q_offtake_sum(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    d = label_period(pm.where(F.col("snapshot_date").between(L2[0], L1[1])), "snapshot_date", L1, L2)
    d = d.where(F.col("date_period").isNotNull())
    return A.sum_by(d, ["date_period", "account", "gc_platform", "bgr"],
                    ["reported_offtake_mrp", "normalized_offtake"])


QW = null_greatest("estimated_qty_sold", "1")


@register("weighted_discount", with_views(f"""
SELECT account, gc_platform, bgr,
  round(100.0 * CAST(SUM(CASE WHEN asp_flag = 1 THEN mrp * {QW} END) - SUM(CASE WHEN asp_flag = 1 THEN price * {QW} END) AS DOUBLE)
    / NULLIF(CAST(SUM(CASE WHEN asp_flag = 1 THEN mrp * {QW} END) AS DOUBLE), 0), 1) AS wt_discounting
FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY 1, 2, 3"""))
def q_weighted_discount(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics().where(F.col("snapshot_date").between(L1[0], L1[1]))
    return pm.groupBy("account", "gc_platform", "bgr").agg(A.weighted_discount().alias("wt_discounting"))


@register("wt_ppu", with_views(PPU_CTES + "\nSELECT account, gc_platform, bgr, brand, wt_ppu, is_own_brand FROM ppu", ("pid_metrics", "product_dim")))
def q_wt_ppu(spark, sf):
    v = Views.shared(spark, sf)
    return TR.brand_ppu(v.pid_slice(L1, L2), v.product_dim(), L1)


@register("distinct_dims", with_views("SELECT DISTINCT gc_platform, bgr, gc_city FROM pid_metrics"))
def q_distinct_dims(spark, sf):
    return A.distinct_dims(Views.shared(spark, sf).pid_metrics(), ["gc_platform", "bgr", "gc_city"])


@register("impact_split", with_views(OWN_IMP + """
SELECT account, gc_platform, bgr, brand,
  CAST(SUM(CASE WHEN sales_impact < 0 THEN CAST(sales_impact AS DECIMAL(38,7)) END) AS DOUBLE) AS impact_loss,
  CAST(SUM(CASE WHEN sales_impact > 0 THEN CAST(sales_impact AS DECIMAL(38,7)) END) AS DOUBLE) AS impact_gain
FROM oi GROUP BY 1, 2, 3, 4""", MSV))
def q_impact_split(spark, sf):
    return A.impact_split(_own_imp(spark, sf), ["account", "gc_platform", "bgr", "brand"])


@register("pivot_period", with_views(MARKET_SHARE_SQL_CTES + """
SELECT account, gc_platform, bgr, gc_city, brand,
  AVG(CASE WHEN date_period = 'dr1' THEN market_share END) AS dr1,
  AVG(CASE WHEN date_period = 'dr2' THEN market_share END) AS dr2
FROM ms WHERE account IS NOT NULL AND gc_platform IS NOT NULL AND bgr IS NOT NULL AND gc_city IS NOT NULL
  AND brand IS NOT NULL GROUP BY 1, 2, 3, 4, 5""", MSV))
def q_pivot_period(spark, sf):
    return A.pivot_periods(_ms(spark, sf), CITY, "market_share")


@register("pivot_sum_fill", with_views(MARKET_SHARE_SQL_CTES + """,
p AS (
  SELECT account, gc_platform,
    coalesce(CAST(SUM(CASE WHEN date_period = 'dr1' THEN CAST(actual_sum AS DECIMAL(38,6)) END) AS DOUBLE), 0.0) AS dr1,
    coalesce(CAST(SUM(CASE WHEN date_period = 'dr2' THEN CAST(actual_sum AS DECIMAL(38,6)) END) AS DOUBLE), 0.0) AS dr2
  FROM ms GROUP BY 1, 2
)
SELECT *, dr1 - dr2 AS change FROM p""", MSV))
def q_pivot_sum_fill(spark, sf):
    ms = _ms(spark, sf).withColumn("actual_sum", F.col("actual_sum").cast("decimal(38,6)"))
    p = A.pivot_periods(ms, ["account", "gc_platform"], "actual_sum", how="sum", fill=0.0)
    return p.withColumn("change", F.col("dr1") - F.col("dr2"))


@register("top_geo", with_views(OWN_IMP + """,
r AS (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr, brand
       ORDER BY sales_impact ASC NULLS LAST, gc_city ASC NULLS LAST) AS rn FROM oi)
SELECT account, gc_platform, bgr, brand,
  string_agg(gc_city, ',' ORDER BY rn) FILTER (WHERE rn = 1 OR gc_city IS DISTINCT FROM first_city) AS top_gc_city
FROM (SELECT *, first_value(gc_city) OVER (PARTITION BY account, gc_platform, bgr, brand ORDER BY rn) AS first_city FROM r)
WHERE rn <= 2 GROUP BY 1, 2, 3, 4""", MSV))
def q_top_geo(spark, sf):
    return A.top_names(_own_imp(spark, sf), ["account", "gc_platform", "bgr", "brand"], "gc_city",
                       [F.col("sales_impact").asc_nulls_last(), F.col("gc_city").asc_nulls_last()], k=2)


@register("target_osa", with_views(f"""
SELECT account, gc_platform, bgr, gc_city,
  coalesce(max(CASE WHEN is_own_brand = 0 AND asp_flag = 1 THEN mrp END), max(CASE WHEN is_own_brand = 0 THEN mrp END)) AS target
FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY 1, 2, 3, 4"""))
def q_target_osa(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics().where(F.col("snapshot_date").between(L1[0], L1[1]))
    return A.max_in_set(pm, ["account", "gc_platform", "bgr", "gc_city"], "mrp",
                        (F.col("is_own_brand") == 0) & (F.col("asp_flag") == 1),
                        F.col("is_own_brand") == 0)


@register("two_stage_topk", with_views(SKU_COMPARE_CTES + """,
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr, gc_city
        ORDER BY market_share_dr1 DESC NULLS LAST, product_id ASC NULLS LAST, brand ASC NULLS LAST) AS stage1_rank FROM sc)
       WHERE stage1_rank <= 4)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr, gc_city
        ORDER BY change_market_share DESC NULLS LAST, product_id ASC NULLS LAST, brand ASC NULLS LAST) AS stage2_rank FROM s1)
WHERE stage2_rank <= 1"""))
def q_two_stage_topk(spark, sf):
    sc = M.sku_compare(sku_metrics(Views.shared(spark, sf)))
    tie = [F.col("product_id").asc_nulls_last(), F.col("brand").asc_nulls_last()]
    return TK.two_stage_top(sc, ["account", "gc_platform", "bgr", "gc_city"],
                            [F.col("market_share_dr1").desc_nulls_last(), *tie], 4,
                            [F.col("change_market_share").desc_nulls_last(), *tie], 1)


@register("max_abs_sku", with_views(SKU_COMPARE_CTES + """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr, gc_city, brand
  ORDER BY abs(change_market_share) DESC NULLS LAST, product_id ASC NULLS LAST) AS rn FROM sc) WHERE rn = 1"""))
def q_max_abs_sku(spark, sf):
    sc = M.sku_compare(sku_metrics(Views.shared(spark, sf)))
    return TK.max_abs_row(sc, CITY, "change_market_share", ["product_id"])


@register("limit_ordered", with_views(OWN_IMP + """
SELECT * FROM oi ORDER BY sales_impact ASC, account, gc_platform, bgr, gc_city, brand LIMIT 20""", MSV))
def q_limit_ordered(spark, sf):
    # a top-20 report of the worst city x brand impacts (the limit is the feature)
    return TK.limit_ordered(_own_imp(spark, sf),
                            [F.col("sales_impact").asc_nulls_last(), *[F.col(k).asc() for k in CITY]], 20)


@register("top_metrics", with_views(BM_CITY + ",\nch AS (" + change_sql("bm", CITY_KEYS + ["is_own_brand"], METRICS, NAMES, False) + ")" + """
SELECT account, gc_platform, bgr, gc_city, brand, is_own_brand,
  list_transform(t, lambda x: x.metric) AS top_metrics, list_transform(t, lambda x: x.value) AS top_values
FROM (SELECT *, list_slice(list_sort(list_filter([{'g': CASE WHEN CAST(change_wt_osa AS DOUBLE) * -1.0 > 0 THEN 0 ELSE 1 END, 'o': CASE WHEN CAST(change_wt_osa AS DOUBLE) * -1.0 > 0 THEN -(CAST(change_wt_osa AS DOUBLE) * -1.0) ELSE -abs(CAST(change_wt_osa AS DOUBLE)) END, 'metric': 'change_wt_osa', 'value': CAST(change_wt_osa AS DOUBLE)}, {'g': CASE WHEN CAST(change_wt_osa_listing AS DOUBLE) * -1.0 > 0 THEN 0 ELSE 1 END, 'o': CASE WHEN CAST(change_wt_osa_listing AS DOUBLE) * -1.0 > 0 THEN -(CAST(change_wt_osa_listing AS DOUBLE) * -1.0) ELSE -abs(CAST(change_wt_osa_listing AS DOUBLE)) END, 'metric': 'change_wt_osa_listing', 'value': CAST(change_wt_osa_listing AS DOUBLE)}, {'g': CASE WHEN CAST(change_wt_discounting AS DOUBLE) * -1.0 > 0 THEN 0 ELSE 1 END, 'o': CASE WHEN CAST(change_wt_discounting AS DOUBLE) * -1.0 > 0 THEN -(CAST(change_wt_discounting AS DOUBLE) * -1.0) ELSE -abs(CAST(change_wt_discounting AS DOUBLE)) END, 'metric': 'change_wt_discounting', 'value': CAST(change_wt_discounting AS DOUBLE)}, {'g': CASE WHEN CAST(change_sov AS DOUBLE) * -1.0 > 0 THEN 0 ELSE 1 END, 'o': CASE WHEN CAST(change_sov AS DOUBLE) * -1.0 > 0 THEN -(CAST(change_sov AS DOUBLE) * -1.0) ELSE -abs(CAST(change_sov AS DOUBLE)) END, 'metric': 'change_sov', 'value': CAST(change_sov AS DOUBLE)}, {'g': CASE WHEN CAST(change_adsov AS DOUBLE) * -1.0 > 0 THEN 0 ELSE 1 END, 'o': CASE WHEN CAST(change_adsov AS DOUBLE) * -1.0 > 0 THEN -(CAST(change_adsov AS DOUBLE) * -1.0) ELSE -abs(CAST(change_adsov AS DOUBLE)) END, 'metric': 'change_adsov', 'value': CAST(change_adsov AS DOUBLE)}, {'g': CASE WHEN CAST(change_ogsov AS DOUBLE) * -1.0 > 0 THEN 0 ELSE 1 END, 'o': CASE WHEN CAST(change_ogsov AS DOUBLE) * -1.0 > 0 THEN -(CAST(change_ogsov AS DOUBLE) * -1.0) ELSE -abs(CAST(change_ogsov AS DOUBLE)) END, 'metric': 'change_ogsov', 'value': CAST(change_ogsov AS DOUBLE)}], lambda x: x.value IS NOT NULL)), 1, 2) AS t FROM ch)""", ("pid_metrics", "product_dim")))
def q_top_metrics(spark, sf):
    v = Views.shared(spark, sf)
    ch = M.brand_metrics_change(M.brand_metrics(v.pid_slice(L1, L2), v.product_dim(), L1, L2))
    cols = ["change_wt_osa", "change_wt_osa_listing", "change_wt_discounting", "change_sov",
            "change_adsov", "change_ogsov"]
    return TK.top_metrics(ch, ["account", "gc_platform", "bgr", "gc_city", "brand", "is_own_brand"],
                          cols, k=2, sign=-1)


# ------------------------------------------------------------------ text
@register("format_amount", with_views(OWN_IMP + """
SELECT account, gc_platform, bgr, gc_city, brand,
  CASE WHEN abs(sales_impact) >= 1e7 THEN '₹' || printf('%.1f', round(abs(sales_impact) / 1e7, 1)) || ' Cr '
       ELSE '₹' || printf('%.1f', round(abs(sales_impact) / 1e5, 1)) || ' L' END AS amount_text
FROM oi""", MSV))
def q_format_amount(spark, sf):
    return _own_imp(spark, sf).select(*CITY, T.fmt_amount(F.abs("sales_impact")).alias("amount_text"))


@register("format_change", with_views(OWN_IMP + """
SELECT account, gc_platform, bgr, gc_city, brand,
  CASE WHEN sales_impact > 0 THEN '(↑ ' ELSE '(↓ ' END ||
  CASE WHEN abs(sales_impact) >= 1e7 THEN '₹' || printf('%.1f', round(abs(sales_impact) / 1e7, 1)) || ' Cr '
       ELSE '₹' || printf('%.1f', round(abs(sales_impact) / 1e5, 1)) || ' L' END || ')' AS change_text
FROM oi""", MSV))
def q_format_change(spark, sf):
    return _own_imp(spark, sf).select(*CITY, T.fmt_change("sales_impact").alias("change_text"))


@register("format_pct", with_views(OWN_IMP + """
SELECT account, gc_platform, bgr, gc_city, brand,
  'MS ' || printf('%.1f', round(share_dr1, 1)) || '% (' || CASE WHEN pct_change > 0 THEN '↑' ELSE '↓' END
    || printf('%.1f', round(abs(pct_change), 1)) || '%)' AS share_text
FROM oi""", MSV))
def q_format_pct(spark, sf):
    return _own_imp(spark, sf).select(*CITY, T.fmt_pct("share_dr1", "pct_change", "MS").alias("share_text"))


@register("month_names", with_views("""
SELECT DISTINCT strftime(snapshot_date, '%B') AS month_name, strftime(snapshot_date, '%b') AS month_short,
  month(snapshot_date) AS month_no
FROM pid_metrics"""))
def q_month_names(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    return pm.select(T.month_name("snapshot_date").alias("month_name"),
                     T.month_name("snapshot_date", short=True).alias("month_short"),
                     F.month("snapshot_date").alias("month_no")).distinct()


@register("json_field", """
SELECT event_type, json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def q_json_field(spark, sf):
    e = S.scan_table(spark, sf, "events")
    return (e.select("event_type", T.json_field("props", "$.k").alias("k"))
            .groupBy("event_type", "k").agg(F.count("*").cast("bigint").alias("n")))


@register("json_flags", """
SELECT event_id, coalesce(json_extract_string(props, '$.redshift.database'), '') AS name,
  coalesce(list_filter(try_cast(json_extract(props, '$.dbt.variables') AS STRUCT(name VARCHAR, value BOOLEAN)[]), lambda x: x.name = 'build_normalized_offtake_blinkit')[-1].value, false) AS build_blinkit,
  coalesce(list_filter(try_cast(json_extract(props, '$.dbt.variables') AS STRUCT(name VARCHAR, value BOOLEAN)[]), lambda x: x.name = 'build_normalized_offtake_instamart')[-1].value, false) AS build_instamart,
  coalesce(list_filter(try_cast(json_extract(props, '$.dbt.variables') AS STRUCT(name VARCHAR, value BOOLEAN)[]), lambda x: x.name = 'build_normalized_offtake_zepto')[-1].value, false) AS build_zepto
FROM events""")
def q_json_flags(spark, sf):
    e = S.scan_table(spark, sf, "events")
    return e.select("event_id", *T.json_flags("props"))


@register("json_flags_accounts", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) END AS name,
  c_custkey % 5 <> 0 AND c_nationkey % 2 = 0 AS build_blinkit, false AS build_instamart,
  c_custkey % 5 <> 0 AS build_zepto
FROM customer""")
def q_json_flags_accounts(spark, sf):
    """Job configs built from every customer; each fifth one is broken JSON."""
    c = S.scan_table(spark, sf, "customer")
    config = F.format_string(
        '{"redshift": {"database": "%s"}, "dbt": {"variables": ['
        '{"name": "build_normalized_offtake_zepto", "value": false}, '
        '{"name": "build_normalized_offtake_blinkit", "value": %s}, '
        '{"name": "build_normalized_offtake_zepto", "value": true}]}}',
        F.lower("c_mktsegment"), (F.col("c_nationkey") % 2 == 0).cast("string"))
    d = c.withColumn("config", F.when(F.col("c_custkey") % 5 == 0, F.lit("{")).otherwise(config))
    return d.select("c_custkey", *T.json_flags("config"))


@register("account_domain", """
SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', 1) AS domain,
  upper(substr(split_part(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', 1), 1, 1))
    || lower(substr(split_part(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', 1), 2)) AS brand_name
FROM pages""")
def q_account_domain(spark, sf):
    p = S.scan_table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return p.select("page_id", T.domain_of(host).alias("domain"),
                    T.capitalise(T.domain_of(host)).alias("brand_name"))


@register("winsor_log", with_views("""
ppu_src AS (SELECT account, gc_platform, bgr, brand, CAST(avg(price_per_100_units) AS DOUBLE) AS ppu
            FROM pid_metrics GROUP BY 1, 2, 3, 4),
q AS (SELECT account, gc_platform, bgr, quantile_cont(ppu, 0.05) AS lo, quantile_cont(ppu, 0.95) AS hi
      FROM ppu_src GROUP BY 1, 2, 3)
SELECT s.account, s.gc_platform, s.bgr, s.brand,
  round(ln(1 + greatest(q.lo, least(s.ppu, q.hi))), 6) AS log_ppu,
  CAST(ceil(s.ppu / 5) * 5 AS DOUBLE) AS ppu_ceil5
FROM ppu_src s JOIN q ON s.account = q.account AND s.gc_platform = q.gc_platform AND s.bgr = q.bgr"""))
def q_winsor_log(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    src = (pm.groupBy("account", "gc_platform", "bgr", "brand")
           .agg(F.avg("price_per_100_units").cast("double").alias("ppu")))
    q = group_quantiles(src, ["account", "gc_platform", "bgr"], "ppu", [0.05, 0.95])
    j = src.join(q, ["account", "gc_platform", "bgr"])
    return j.select("account", "gc_platform", "bgr", "brand",
                    F.round(F.log1p(X.clip("ppu", "q_0_05", "q_0_95")), 6).alias("log_ppu"),
                    X.ceil_to("ppu", 5).cast("double").alias("ppu_ceil5"))
