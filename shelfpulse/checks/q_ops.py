"""Registered queries: single operators of SURVEY 2.1-2.3 on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_core import CAT_MS_CTES, MARKET_SHARE_SQL_CTES, impact_sql
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import between, weight
from shelfpulse.functions import exprs as X
from shelfpulse.operators import aggregates as A
from shelfpulse.operators import joins as J
from shelfpulse.operators import periods as P
from shelfpulse.plans import metrics as M
from shelfpulse.sources import tables as S
from shelfpulse.sources.views import Views

# The platforms of the spine (lower-cased market segments of the test mapping).
PLATFORMS = ("automobile", "building", "furniture", "household", "machinery")



@register("scan_table", "SELECT * FROM part")
def q_scan_table(spark, sf):
    return S.scan_table(spark, sf, "part")


@register("platform_union", with_views("""
SELECT gc_platform, count(*)::BIGINT AS n_rows, CAST(SUM(normalized_offtake) AS DOUBLE) AS offtake
FROM pid_metrics GROUP BY gc_platform"""))
def q_platform_union(spark, sf):
    """All platforms in one scan of the platform and month layout."""
    u = Views.shared(spark, sf).platform_months()
    return u.groupBy("gc_platform").agg(F.count("*").cast("bigint").alias("n_rows"),
                                        F.sum("normalized_offtake").cast("double").alias("offtake"))


@register("multi_account_share", with_views(MARKET_SHARE_SQL_CTES + "\nSELECT * FROM ms",
                                            ("pid_metrics", "product_dim"), by_priority=True))
def q_multi_account_share(spark, sf):
    v = Views.shared(spark, sf, "by_priority")
    return M.market_share(v.pid_slice(L1, L2), v.product_dim(), L1, L2)


@register("key_normalise", """
SELECT lower(trim(c_mktsegment)) AS segment, count(*)::BIGINT AS n FROM customer GROUP BY 1""")
def q_key_normalise(spark, sf):
    c = S.scan_table(spark, sf, "customer")
    return (c.select(X.norm_key("c_mktsegment").alias("segment"))
            .groupBy("segment").agg(F.count("*").cast("bigint").alias("n")))


@register("slug_text", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9 ]', '', 'g') AS slug FROM pages")
def q_slug_text(spark, sf):
    p = S.scan_table(spark, sf, "pages")
    return p.select("page_id", X.slug("url").alias("slug"))


@register("drop_bucket", with_views(
    MARKET_SHARE_SQL_CTES + ",\nimp AS (" + impact_sql("ms", "account, gc_platform, bgr, gc_city, brand",
                                                       "is_own_brand = 1")
    + ")\nSELECT * FROM imp WHERE gc_city IS DISTINCT FROM 'AFRICA'", ("pid_metrics", "product_dim")))
def q_drop_bucket(spark, sf):
    v = Views.shared(spark, sf)
    ms = M.market_share(v.pid_slice(L1, L2), v.product_dim(), L1, L2).where(F.col("is_own_brand") == 1)
    imp = P.share_impact(ms, ["account", "gc_platform", "bgr", "gc_city", "brand"])
    # the reference drops the 'Others' bucket; 'AFRICA' is a bucket present in the test data
    return imp.where(~F.col("gc_city").eqNullSafe("AFRICA"))


@register("own_comp_split", with_views(f"""
SELECT is_own_brand, count(*)::BIGINT AS n_rows, CAST(SUM(normalized_offtake) AS DOUBLE) AS offtake
FROM pid_metrics WHERE is_own_brand IN (0, 1) AND {between('snapshot_date', *L1)} GROUP BY is_own_brand"""))
def q_own_comp_split(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    f = pm.where(F.col("is_own_brand").isin(0, 1) & F.col("snapshot_date").between(L1[0], L1[1]))
    return f.groupBy("is_own_brand").agg(F.count("*").cast("bigint").alias("n_rows"),
                                         F.sum("normalized_offtake").cast("double").alias("offtake"))


W = weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")


@register("weighted_osa", with_views(f"""
SELECT account, gc_platform, bgr, gc_city,
  round(100.0 * CAST(SUM(total_available * {W}) AS DOUBLE) / NULLIF(CAST(SUM(total_scrapes * {W}) AS DOUBLE), 0), 1) AS wt_osa,
  round(100.0 * CAST(SUM(total_available * {W}) AS DOUBLE) / NULLIF(CAST(SUM(total_listed * {W}) AS DOUBLE), 0), 1) AS wt_osa_in_ls
FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY account, gc_platform, bgr, gc_city"""))
def q_weighted_osa(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    f = pm.where(F.col("snapshot_date").between(L1[0], L1[1]))
    w = A.osa_weight()
    return f.groupBy("account", "gc_platform", "bgr", "gc_city").agg(
        A.weighted_ratio("total_available", "total_scrapes", w).alias("wt_osa"),
        A.weighted_ratio("total_available", "total_listed", w).alias("wt_osa_in_ls"))


@register("coerce_number", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num,
  TRY_CAST(event_type AS DOUBLE) AS type_num FROM events""")
def q_coerce_number(spark, sf):
    e = S.scan_table(spark, sf, "events")
    return e.select("event_id", X.coerce_number(F.get_json_object("props", "$.k")).alias("k_num"),
                    X.coerce_number("event_type").alias("type_num"))


@register("non_blank", """
SELECT role, count(*)::BIGINT AS n FROM conversations
WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY role""")
def q_non_blank(spark, sf):
    c = S.scan_table(spark, sf, "conversations")
    return c.where(~X.is_blank("text")).groupBy("role").agg(F.count("*").cast("bigint").alias("n"))


@register("day_snapshot", with_views("""
SELECT CASE WHEN snapshot_date = DATE '2000-12-31' THEN 'dr1' ELSE 'dr2' END AS date_period,
  gc_platform, count(*)::BIGINT AS n_rows, CAST(SUM(total_listed) AS BIGINT) AS listed
FROM pid_metrics WHERE snapshot_date IN (DATE '2000-12-31', DATE '1999-12-31') GROUP BY 1, 2"""))
def q_day_snapshot(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    d = P.snapshot_on_days(pm, "snapshot_date", L1[1], L2[1])
    return d.groupBy("date_period", "gc_platform").agg(
        F.count("*").cast("bigint").alias("n_rows"), F.sum("total_listed").cast("bigint").alias("listed"))


@register("snapshot_or_previous", with_views("""
c AS (SELECT * FROM pid_metrics WHERE snapshot_date IN (DATE '2000-11-30', DATE '2000-11-29')),
m AS (SELECT gc_platform, gc_city, max(snapshot_date) AS d FROM c GROUP BY 1, 2)
SELECT c.gc_platform, c.gc_city, c.snapshot_date, count(*)::BIGINT AS n_rows
FROM c JOIN m ON c.gc_platform = m.gc_platform AND c.gc_city = m.gc_city AND c.snapshot_date = m.d
GROUP BY 1, 2, 3"""))
def q_snapshot_or_previous(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    d = P.snapshot_or_previous(pm, "snapshot_date", "2000-11-30", keys=["gc_platform", "gc_city"])
    return d.groupBy("gc_platform", "gc_city", "snapshot_date").agg(
        F.count("*").cast("bigint").alias("n_rows"))


@register("fact_dim_left", with_views(f"""
SELECT lower(d.bgr) AS dim_bgr, d.is_platform_bundle, count(*)::BIGINT AS n_rows,
  CAST(SUM(m.normalized_offtake) AS DOUBLE) AS offtake
FROM pid_metrics m LEFT JOIN product_dim d ON m.product_id = d.product_id
WHERE {between('m.snapshot_date', *L1)} GROUP BY 1, 2""", ("pid_metrics", "product_dim")))
def q_fact_dim_left(spark, sf):
    v = Views.shared(spark, sf)
    f = v.pid_metrics().where(F.col("snapshot_date").between(L1[0], L1[1])).select(
        "product_id", "normalized_offtake")
    d = v.product_dim().select("product_id", F.lower("bgr").alias("dim_bgr"), "is_platform_bundle")
    j = J.join_dim(f, d, "product_id")
    return j.groupBy("dim_bgr", "is_platform_bundle").agg(
        F.count("*").cast("bigint").alias("n_rows"),
        F.sum("normalized_offtake").cast("double").alias("offtake"))


@register("valid_product_semi", with_views(f"""
SELECT gc_platform, count(*)::BIGINT AS n_rows FROM pid_metrics
WHERE {between('snapshot_date', *L1)}
  AND product_id IN (SELECT DISTINCT product_id FROM product_dim WHERE is_platform_bundle IS NULL)
GROUP BY gc_platform""", ("pid_metrics", "product_dim")))
def q_valid_product_semi(spark, sf):
    v = Views.shared(spark, sf)
    f = v.pid_metrics().where(F.col("snapshot_date").between(L1[0], L1[1]))
    k = J.keep_valid(f, v.product_dim(), "product_id", F.col("is_platform_bundle").isNull())
    return k.groupBy("gc_platform").agg(F.count("*").cast("bigint").alias("n_rows"))


@register("in_list_semi", with_views("""
SELECT gc_platform, count(*)::BIGINT AS n_rows, CAST(SUM(potential_sales_loss_mrp) AS DOUBLE) AS psl
FROM psl_daily_locality WHERE product_id IN (SELECT product_id FROM own_sku_base WHERE is_own_brand = 1)
GROUP BY gc_platform""", ("psl_daily_locality", "own_sku_base")))
def q_in_list_semi(spark, sf):
    v = Views.shared(spark, sf)
    own = v.own_sku_base().where(F.col("is_own_brand") == 1).select("product_id")
    k = J.keep_in(v.psl_daily_locality(), own, "product_id")
    return k.groupBy("gc_platform").agg(F.count("*").cast("bigint").alias("n_rows"),
                                        F.sum("potential_sales_loss_mrp").cast("double").alias("psl"))


@register("sov_join", with_views(f"""
b AS (SELECT account, gc_platform, bgr, gc_city, brand, round(SUM(total_impressions), 0) AS ti
      FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT account, gc_platform, bgr, gc_city, round(SUM(total_impressions), 0) AS ti
      FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY 1, 2, 3, 4)
SELECT b.account, b.gc_platform, b.bgr, b.gc_city, b.brand,
  coalesce(round(CAST(b.ti AS DOUBLE) / nullif(CAST(t.ti AS DOUBLE), 0), 3) * 100.0, 0) AS sov
FROM b JOIN t ON b.account = t.account AND b.gc_platform = t.gc_platform AND b.bgr = t.bgr AND b.gc_city = t.gc_city"""))
def q_sov_join(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics().where(F.col("snapshot_date").between(L1[0], L1[1]))
    keys = ["account", "gc_platform", "bgr", "gc_city"]
    b = pm.groupBy(*keys, "brand").agg(F.round(F.sum("total_impressions"), 0).alias("ti"))
    t = pm.groupBy(*keys).agg(F.round(F.sum("total_impressions"), 0).alias("tti"))
    j = b.join(t, keys)  # C4: detail x group total on the shared keys
    return j.select(*keys, "brand", F.coalesce(
        F.round(X.safe_div(F.col("ti").cast("double"), F.col("tti").cast("double")), 3) * 100.0,
        F.lit(0.0)).alias("sov"))


@register("brand_flag_lookup", with_views(f"""
a AS (SELECT gc_platform, brand, CAST(SUM(normalized_offtake) AS DOUBLE) AS offtake
      FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY 1, 2),
f AS (SELECT DISTINCT gc_platform, brand, is_own_brand FROM pid_metrics)
SELECT a.*, f.is_own_brand FROM a LEFT JOIN f USING (gc_platform, brand)"""))
def q_brand_flag_lookup(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    a = (pm.where(F.col("snapshot_date").between(L1[0], L1[1]))
         .groupBy("gc_platform", "brand").agg(F.sum("normalized_offtake").cast("double").alias("offtake")))
    return J.lookup_flag(a, pm, ["gc_platform", "brand"])


@register("conditional_left", with_views(f"""
a AS (SELECT product_id, CAST(SUM(normalized_offtake) AS DOUBLE) AS offtake
      FROM pid_metrics WHERE {between('snapshot_date', *L1)} GROUP BY 1)
SELECT a.product_id, a.offtake, d.is_platform_bundle, d.title
FROM a LEFT JOIN product_dim d ON a.product_id = d.product_id AND d.is_platform_bundle = 'Y'""",
                                     ("pid_metrics", "product_dim")))
def q_conditional_left(spark, sf):
    v = Views.shared(spark, sf)
    a = (v.pid_metrics().where(F.col("snapshot_date").between(L1[0], L1[1]))
         .groupBy("product_id").agg(F.sum("normalized_offtake").cast("double").alias("offtake")))
    d = v.product_dim().select("product_id", "is_platform_bundle", "title")
    return J.left_with_filter(a, d, ["product_id"], F.col("is_platform_bundle") == "Y")


@register("correlated_count", """
SELECT n.n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey)::BIGINT AS n_customers
FROM nation n""")
def q_correlated_count(spark, sf):
    S.register_views(spark, sf, ("nation", "customer"))
    return spark.sql("""
        SELECT n.n_name,
               CAST((SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS BIGINT)
                 AS n_customers
        FROM nation n""")


@register("spine_fill", with_views(f"""
spine AS (SELECT * FROM (VALUES ('automobile'), ('building'), ('furniture'), ('household'),
                                ('machinery'), ('zepto')) t(gc_platform)),
s AS (SELECT gc_platform, CAST(SUM(normalized_offtake) AS DOUBLE) AS offtake FROM pid_metrics
      WHERE {between('snapshot_date', *L1)} GROUP BY 1)
SELECT spine.gc_platform, coalesce(s.offtake, 0.0) AS offtake FROM spine LEFT JOIN s USING (gc_platform)"""))
def q_spine_fill(spark, sf):
    pm = Views.shared(spark, sf).pid_metrics()
    s = (pm.where(F.col("snapshot_date").between(L1[0], L1[1]))
         .groupBy("gc_platform").agg(F.sum("normalized_offtake").cast("double").alias("offtake")))
    spine = spark.createDataFrame([(p,) for p in (*PLATFORMS, "zepto")], "gc_platform string")
    return J.on_spine(s, F.broadcast(spine), ["gc_platform"], {"offtake": 0.0})


@register("fill_defaults", with_views(
    "x AS (SELECT 1)," + CAT_MS_CTES.strip() + f"""
SELECT account, gc_platform, bgr, brand, coalesce(is_own_brand, 0) AS is_own_brand,
  coalesce(actual_sum, 0.0) AS actual_sum, coalesce(market_share, 0.0) AS market_share
FROM cms WHERE date_period = 'dr1'"""))
def q_fill_defaults(spark, sf):
    v = Views.shared(spark, sf)
    cms = M.market_share_category(v.pid_slice(L1, L2), L1, L2).where(F.col("date_period") == "dr1")
    return (cms.select("account", "gc_platform", "bgr", "brand", "is_own_brand", "actual_sum",
                       "market_share")
            .na.fill({"is_own_brand": 0, "actual_sum": 0.0, "market_share": 0.0}))

