"""Registered queries: keyword relevance, keyword x brand SOV, contribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import between, in_periods, label
from shelfpulse.plans import keywords as K
from shelfpulse.sources.views import Views

G = "account, gc_platform, bgr, gc_city"
KW_CTES = f"""
rk AS (
  SELECT {label('snapshot_date', 'dr2')} AS date_period, {G}, keyword,
    SUM(total_impressions) AS tot_imp, SUM(ad_impressions) AS ad_imp,
    CASE WHEN SUM(ad_impressions) = 0 THEN 0.0
      ELSE ROUND(CAST(SUM(is_own_brand * ad_impressions) AS DOUBLE) * 100.0 / CAST(SUM(ad_impressions) AS DOUBLE), 1) END AS ad_sov,
    MAX(keyword_weight) AS max_keyword_weight
  FROM keyword_impressions WHERE {in_periods()}
  GROUP BY 1, {G}, keyword
),
km AS (
  SELECT date_period, {G}, keyword, max_keyword_weight, ad_sov,
    ROUND(100.0 * CAST(tot_imp AS DOUBLE) / NULLIF(CAST(SUM(tot_imp) OVER w AS DOUBLE), 0), 1) AS cat_share,
    ROUND(100.0 * CAST(max_keyword_weight AS DOUBLE) / NULLIF(CAST(SUM(max_keyword_weight) OVER w AS DOUBLE), 0), 1) AS vol_share
  FROM rk WINDOW w AS (PARTITION BY date_period, {G})
),
piv AS (
  SELECT {G}, keyword,
    AVG(CASE WHEN date_period = 'dr1' THEN ad_sov END) AS sov_dr1,
    AVG(CASE WHEN date_period = 'dr2' THEN ad_sov END) AS sov_dr2
  FROM km WHERE account IS NOT NULL AND gc_platform IS NOT NULL AND bgr IS NOT NULL
    AND gc_city IS NOT NULL AND keyword IS NOT NULL
  GROUP BY {G}, keyword
),
cur AS (
  SELECT km.*, CASE WHEN vol_share = 0 THEN 0.0 ELSE round_even(cat_share / vol_share * 100.0, 0) / 100.0 END AS relevant_score
  FROM km WHERE date_period = 'dr1'
),
rel AS (
  SELECT c.*, c.vol_share * ln(1 + c.relevant_score) AS final_score, p.sov_dr1, p.sov_dr2
  FROM cur c LEFT JOIN piv p USING ({G}, keyword)
  WHERE c.relevant_score > 1 AND c.vol_share > 1
),
lowrel AS (
  SELECT c.*, c.vol_share * ln(1 + c.relevant_score) AS final_score, p.sov_dr1, p.sov_dr2
  FROM cur c LEFT JOIN piv p USING ({G}, keyword)
  WHERE c.relevant_score <= 1 AND c.relevant_score > 0 AND c.vol_share > 1
)"""

KW_COLS = (f"date_period, {G}, keyword, max_keyword_weight, ad_sov, cat_share, vol_share, "
           "relevant_score, round(final_score, 6) AS final_score, sov_dr1, sov_dr2")


def keyword_totals(v):
    """Keyword totals on the keyword aggregate, which is written once per session."""
    return K.keyword_totals(v.window_slice("keyword_impressions", L1, L2), L1, L2,
                            once=lambda g: v.materialize(("keyword_agg", L1, L2), lambda: g))


def _kw(spark, sf):
    return keyword_totals(Views.shared(spark, sf))


def _rounded(scores):
    """Scores to six decimals, for the comparison only: two engines' logarithms may differ in the last bit."""
    return scores.withColumn("final_score", F.round("final_score", 6))


@register("keyword_scores", with_views(KW_CTES + f"\nSELECT {KW_COLS} FROM rel", ("keyword_impressions",)))
def q_keyword_scores(spark, sf):
    return _rounded(K.keyword_scores(_kw(spark, sf)))


@register("keyword_low_relevance", with_views(KW_CTES + f"\nSELECT {KW_COLS} FROM lowrel",
                                              ("keyword_impressions",)))
def q_keyword_low_relevance(spark, sf):
    return _rounded(K.keyword_scores(_kw(spark, sf), relevant=False))


@register("keyword_recs", with_views(KW_CTES + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY final_score DESC, keyword) AS rn,
    row_number() OVER (PARTITION BY {G}, (coalesce(sov_dr1 < sov_dr2, false)) ORDER BY final_score DESC, keyword) AS frn,
    count(*) FILTER (WHERE coalesce(sov_dr1 < sov_dr2, false)) OVER (PARTITION BY {G}) AS nfell
  FROM rel
)
SELECT {G},
  list(keyword ORDER BY final_score DESC, keyword) FILTER (
    WHERE (nfell > 0 AND coalesce(sov_dr1 < sov_dr2, false) AND frn <= 2) OR (nfell = 0 AND rn = 1)) AS recommended_keywords
FROM ranked GROUP BY {G}""", ("keyword_impressions",)))
def q_keyword_recs(spark, sf):
    return K.keyword_recs(K.keyword_scores(_kw(spark, sf)))


KBS_SQL = f"""
t AS (
  SELECT {label()} AS date_period, {G}, keyword, brand, SUM(ad_impressions) AS own_imp
  FROM keyword_impressions WHERE {in_periods()} GROUP BY 1, {G}, keyword, brand
),
s AS (
  SELECT {label('snapshot_date', 'dr2')} AS date_period, {G}, keyword, SUM(ad_impressions) AS tot_imp
  FROM keyword_impressions WHERE {in_periods()} GROUP BY 1, {G}, keyword
),
z AS (
  SELECT t.date_period, t.account, t.gc_platform, t.bgr, t.gc_city, t.keyword, t.brand,
    ROUND(100 * CAST(t.own_imp AS DOUBLE) / NULLIF(CAST(s.tot_imp AS DOUBLE), 0), 1) AS ad_sov
  FROM t LEFT JOIN s USING (date_period, {G}, keyword)
),
bi AS (SELECT DISTINCT brand, is_own_brand FROM product_dim)
SELECT z.brand, z.date_period, z.account, lower(z.gc_platform) AS gc_platform, z.bgr, z.gc_city, z.keyword,
  coalesce(z.ad_sov, 0.0) AS ad_sov, coalesce(bi.is_own_brand, 0) AS is_own_brand
FROM z LEFT JOIN bi USING (brand)"""


@register("keyword_brand_sov", with_views(KBS_SQL, ("keyword_impressions", "product_dim")))
def q_keyword_brand_sov(spark, sf):
    v = Views.shared(spark, sf)
    return K.keyword_brand_sov(v.window_slice("keyword_impressions", L1, L2), v.product_dim(), L1, L2)


CONTRIB_SQL = f"""
pt AS (
  SELECT account, product_id, title, gc_platform, bgr, gc_city, SUM(reported_offtake_mrp) AS total_mrp
  FROM pid_metrics WHERE {between('snapshot_date', *L1)} AND is_own_brand = 1
  GROUP BY account, product_id, title, gc_platform, bgr, gc_city
)
SELECT account, product_id, title, gc_platform, bgr, gc_city,
  ROUND(100.0 * CAST(total_mrp AS DOUBLE) / NULLIF(CAST(SUM(total_mrp) OVER (PARTITION BY account, gc_platform, bgr, gc_city) AS DOUBLE), 0), 1) AS contribution_pct
FROM pt"""


@register("contribution_pct", with_views(CONTRIB_SQL))
def q_contribution(spark, sf):
    v = Views.shared(spark, sf)
    return K.contribution(v.pid_slice(L1, L2), L1)
