"""Registered queries: store-level OSA, Pareto tags, PSL, store coverage, DOI."""

from __future__ import annotations

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_drill import drill_ctes, frames, inputs, store_aggregate
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import between, in_periods, label, weight
from shelfpulse.plans import stores as ST
from shelfpulse.sources.views import Views

K = "account, gc_platform, gc_city, bgr, product_id, title, store_id, locality"
W = weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
LAB = label("snapshot_date", "dr2")

STORE_CTES = f"""
spm AS (
  SELECT {LAB} AS date_period, {K},
    SUM(total_available * {W}) AS wa, SUM(total_scrapes * {W}) AS ws,
    CAST(SUM(total_available) AS DOUBLE) AS tot_ls,
    SUM(impact_scrore_for_psl_tags_pf) AS imp,
    CAST(SUM(impact_scrore_for_psl_tags_pf) AS DOUBLE) AS total_mtd_impact_pf,
    CAST(SUM(CASE WHEN ({LAB} = 'dr1' AND snapshot_date = DATE '{L1[1]}')
                    OR ({LAB} = 'dr2' AND snapshot_date = DATE '{L2[1]}') THEN total_listed END) AS BIGINT) AS total_listed
  FROM locality_metrics WHERE {in_periods()}
  GROUP BY 1, {K}
),
spt AS (
  SELECT *, row_number() OVER w AS sku_rank_pf,
    CAST(SUM(imp) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
      / NULLIF(CAST(SUM(imp) OVER (PARTITION BY account, date_period, gc_platform, gc_city, bgr) AS DOUBLE), 0) AS cum
  FROM spm
  WINDOW w AS (PARTITION BY account, date_period, gc_platform, gc_city, bgr
               ORDER BY total_mtd_impact_pf DESC NULLS FIRST, product_id ASC NULLS LAST, store_id ASC NULLS LAST,
                        locality ASC NULLS LAST, title ASC NULLS LAST)
),
tags AS (
  SELECT * EXCLUDE (cum, imp),
    CASE WHEN (cum <= 0.25 OR sku_rank_pf <= 2) AND total_mtd_impact_pf > 0 THEN 'high'
         WHEN (cum <= 0.50 OR sku_rank_pf <= 4) AND total_mtd_impact_pf > 0 THEN 'medium' ELSE 'low' END AS psl_tags_pf,
    round(cum, 3) AS contribution_weight_pf
  FROM spt
),
osa AS (SELECT *, 100.0 * CAST(wa AS DOUBLE) / NULLIF(CAST(ws AS DOUBLE), 0) AS o FROM tags),
pairs AS (
  SELECT *, max(CASE WHEN date_period = 'dr1' THEN o END) OVER k AS o1,
    max(CASE WHEN date_period = 'dr2' THEN o END) OVER k AS o2,
    max(CASE WHEN date_period = 'dr1' THEN 1 END) OVER k AS h1,
    max(CASE WHEN date_period = 'dr2' THEN 1 END) OVER k AS h2
  FROM osa WINDOW k AS (PARTITION BY {K})
),
sku_osa AS (
  SELECT * EXCLUDE (wa, ws, o, o1, o2, h1, h2), round(o2, 1) AS wt_osa_dr2, round(o1, 1) AS wt_osa_dr1,
    round(o1 - o2, 1) AS osa_diff
  FROM pairs WHERE h1 = 1 AND h2 = 1 AND round(o1 - o2, 1) < 0
),
pslp AS (
  SELECT account, lower(gc_platform) AS gc_platform, product_id, store_id,
    CAST(SUM(potential_sales_loss_mrp) AS DOUBLE) AS psl_mrp
  FROM psl_daily_locality
  WHERE {between('gc_crawl_date', *L1)} AND store_id IS NOT NULL
    AND product_id IN (SELECT product_id FROM own_sku_base WHERE is_own_brand = 1)
  GROUP BY 1, 2, 3, 4
),
srows AS (
  SELECT s.*, coalesce(p.psl_mrp, 0.0) AS psl_mrp
  FROM sku_osa s LEFT JOIN pslp p USING (account, gc_platform, product_id, store_id)
  WHERE s.date_period = 'dr1'
)"""

SV = ("locality_metrics", "psl_daily_locality", "own_sku_base")


def _spm(spark, sf):
    return Views.shared(spark, sf).window_slice("locality_metrics", L1, L2)


def _srows(spark, sf):
    return inputs(Views.shared(spark, sf))["psl"]()


@register("pareto_tags", with_views(STORE_CTES + "\nSELECT * EXCLUDE (wa, ws) FROM tags", SV))
def q_pareto_tags(spark, sf):
    once = store_aggregate(Views.shared(spark, sf))
    t = ST.pareto_tags(once(ST.store_period_metrics(_spm(spark, sf), L1, L2)))
    return t.drop("__wa", "__ws", "__imp")


@register("sku_osa", with_views(STORE_CTES + "\nSELECT * FROM sku_osa", SV))
def q_sku_osa(spark, sf):
    return ST.sku_store_osa(_spm(spark, sf), L1, L2, once=store_aggregate(Views.shared(spark, sf)))


@register("self_period_join", with_views(STORE_CTES + f"""
SELECT DISTINCT {K}, wt_osa_dr2, wt_osa_dr1, osa_diff FROM sku_osa""", SV))
def q_self_period_join(spark, sf):
    d = ST.sku_store_osa(_spm(spark, sf), L1, L2, once=store_aggregate(Views.shared(spark, sf)))
    return d.select(*[c.strip() for c in K.split(",")], "wt_osa_dr2", "wt_osa_dr1", "osa_diff").distinct()


@register("psl_by_platform", with_views(STORE_CTES + """
SELECT date_period, account, gc_platform, CAST(SUM(CAST(psl_mrp AS DECIMAL(38,2))) AS DOUBLE) AS psl_mrp
FROM srows GROUP BY 1, 2, 3""", SV))
def q_psl_by_platform(spark, sf):
    return ST.psl_by(_srows(spark, sf), ["date_period", "account", "gc_platform"])


@register("psl_by_sku", with_views(STORE_CTES + """
SELECT account, gc_platform, bgr, gc_city, product_id, title,
  CAST(SUM(CAST(psl_mrp AS DECIMAL(38,2))) AS DOUBLE) AS psl_mrp
FROM srows GROUP BY 1, 2, 3, 4, 5, 6""", SV))
def q_psl_by_sku(spark, sf):
    return ST.psl_by(_srows(spark, sf), ["account", "gc_platform", "bgr", "gc_city", "product_id", "title"])


@register("sku_store_counts", with_views(STORE_CTES + """
SELECT account, gc_platform, bgr, gc_city, product_id, title,
  count(DISTINCT locality)::BIGINT AS high_psl_stores, CAST(SUM(total_listed) AS BIGINT) AS listed_in
FROM srows WHERE gc_city IS DISTINCT FROM 'Others' AND psl_tags_pf IS DISTINCT FROM 'medium'
GROUP BY 1, 2, 3, 4, 5, 6""", SV))
def q_sku_store_counts(spark, sf):
    return ST.sku_store_counts(_srows(spark, sf))


NEW_STORES = f"""
ns AS (
  SELECT account, lower(gc_platform) AS gc_platform, store_id, lower(trim(gc_city)) AS gc_city_fin,
    min(gc_crawl_date) AS store_first_seen
  FROM store_catalog GROUP BY 1, 2, 3, 4
  HAVING min(gc_crawl_date) BETWEEN DATE '{L2[0]}' AND DATE '{L1[1]}'
)"""


@register("first_seen_between", with_views(NEW_STORES + "\nSELECT * FROM ns", ("store_catalog",)))
def q_first_seen_between(spark, sf):
    return ST.new_stores(Views.shared(spark, sf).store_catalog(), L2[0], L1[1])


@register("new_store_coverage", with_views(NEW_STORES + f""",
cand AS (SELECT * FROM store_listing WHERE is_own_brand = 1 AND total_listed = 1
         AND snapshot_date IN (DATE '{L1[1]}', DATE '{L1[1]}' - INTERVAL 1 DAY)),
pick AS (SELECT account, max(snapshot_date) AS d FROM cand GROUP BY account),
yours AS (SELECT DISTINCT c.account, lower(c.gc_platform) AS gc_platform, c.store_id FROM cand c
          JOIN pick p ON c.account = p.account AND c.snapshot_date = p.d)
SELECT ns.account, ns.gc_platform, count(DISTINCT ns.store_id)::BIGINT AS new_stores,
  count(DISTINCT CASE WHEN y.store_id IS NOT NULL THEN ns.store_id END)::BIGINT AS listed_in_new_stores
FROM ns LEFT JOIN yours y ON ns.account = y.account AND ns.gc_platform = y.gc_platform AND ns.store_id = y.store_id
GROUP BY 1, 2""", ("store_catalog", "store_listing")))
def q_new_store_coverage(spark, sf):
    v = Views.shared(spark, sf)
    return ST.new_store_coverage(v.store_catalog(), v.window_slice("store_listing", L1, L2), L1, L2)


@register("inventory_days", with_views(drill_ctes("down") + f""",
doi AS (
  SELECT d.account, d.gc_platform, d.gc_city, lower(d.bgr) AS bgr, d.product_id,
    round(avg(backend_doi_value), 0) AS backend_doi, round(avg(frontend_doi_value), 0) AS frontend_doi
  FROM facility_doi d
  WHERE {between('d.snapshot_date', *L1)}
    AND EXISTS (SELECT 1 FROM own_sku o WHERE o.account = d.account AND o.gc_platform = d.gc_platform
                AND o.gc_city = d.gc_city AND o.bgr = lower(d.bgr) AND o.product_id = d.product_id)
  GROUP BY 1, 2, 3, 4, 5
)
SELECT * FROM doi""", ("pid_metrics", "product_dim", "facility_doi")))
def q_inventory_days(spark, sf):
    skus = frames(spark, sf, "down")["own_sku"]
    return ST.inventory_days(Views.shared(spark, sf).window_slice("facility_doi", L1, L2), skus, L1)


REACH_KEYS = {"platform": (), "city": ("gc_city",), "category": ("bgr",), "sku": ("product_id",)}
REACH_SQL = "\nUNION ALL\n".join(f"""SELECT '{name}' AS grain, account, gc_platform,
  {", ".join(c if c in keys else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("gc_city", "bgr", "product_id"))},
  count(DISTINCT store_id)::BIGINT AS stores,
  count(DISTINCT CASE WHEN total_listed > 0 THEN store_id END)::BIGINT AS listing_stores,
  count(DISTINCT CASE WHEN total_available > 0 THEN store_id END)::BIGINT AS stocking_stores
FROM locality_metrics WHERE {between('snapshot_date', *L1)} GROUP BY {", ".join(("account", "gc_platform", *keys))}"""
                                   for name, keys in REACH_KEYS.items())


@register("store_reach", with_views(REACH_SQL, ("locality_metrics",)))
def q_store_reach(spark, sf):
    """Distinct stores at four grains, merged from one table of bitmaps."""
    v = Views.shared(spark, sf)
    written = iter(("numbers", "bitmaps"))

    def once(df):
        return v.materialize(("reach", next(written)), lambda: df)
    return ST.store_reach(_spm(spark, sf), L1, once)
