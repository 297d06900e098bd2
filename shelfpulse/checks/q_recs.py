"""Registered queries: OSA / SOV / discount recommendations and their merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import several_accounts
from shelfpulse.checks.q_drill import frames, inputs
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.operators.joins import keep_groups
from shelfpulse.operators.periods import compare_periods
from shelfpulse.plans import drilldown as D
from shelfpulse.plans import keywords as K
from shelfpulse.plans import recommendations as RC
from shelfpulse.plans import stores as ST
from shelfpulse.sources.views import Views

CITY = ["account", "gc_platform", "bgr", "gc_city", "brand"]


class Inputs:
    """The frames the recommendation blocks read, built once per call."""

    def __init__(self, spark, sf, views=None):
        v = views or Views.shared(spark, sf)
        self.v = v
        self.fr = frames(spark, sf, "down", v)
        shared = inputs(v)
        self.cat_metrics = shared["catm"]()
        self.tiers = shared["tiers"]()
        ms = shared["ms"]()
        ch = shared["ch"]()
        self.merged_comp = D.city_impacts(ms, 0).drop("is_own_brand").join(
            ch.where(F.col("is_own_brand") == 0).drop("is_own_brand"), CITY, "left")
        self.dim = v.product_dim()

    def store_frames(self):
        """Losses, store counts and days of inventory of the drivers' categories: the blocks look
        nothing else up, and all three are per category or finer."""
        v, rows, cat = self.v, self.fr["brand_rows"], ["account", "gc_platform", "bgr"]
        psl_rows = keep_groups(inputs(v)["psl"](), rows, cat)
        counts = ST.sku_store_counts(psl_rows)
        doi = keep_groups(v.window_slice("facility_doi", L1, L2), rows, cat, {"bgr": F.lower("bgr")})
        doi = ST.inventory_days(doi, psl_rows, L1)
        return psl_rows, counts, doi

    def keyword_frames(self):
        """Scores and recommended keywords; brand changes on the keywords of the drivers' groups,
        which are whole: the blocks look no other group up."""
        v, i = self.v, inputs(self.v)
        scores = i["kws"]()
        low = K.keyword_scores(i["kwt"](), relevant=False)
        shown = keep_groups(v.window_slice("keyword_impressions", L1, L2), self.fr["brand_rows"], K.KW_GROUP,
                            {"gc_platform": F.lower("gc_platform")})
        change = v.materialize(("keyword_brand_change", L1, L2), lambda: compare_periods(
            K.keyword_brand_sov(shown, self.dim, L1, L2),
            ["account", "gc_platform", "bgr", "brand", "keyword", "gc_city"], ["ad_sov"]))
        return scores, low, K.keyword_recs(scores), change


def osa_recs(spark, sf, i=None):
    i = i or Inputs(spark, sf)
    psl_rows, counts, doi = i.store_frames()
    return RC.osa_recommendations(i.fr["brand_rows"], i.fr["drivers"], i.cat_metrics, i.fr["cities"],
                                  psl_rows, counts, doi)


def sov_recs(spark, sf, i=None):
    i = i or Inputs(spark, sf)
    scores, low, recs, change = i.keyword_frames()
    own = i.dim.select("product_id", "is_own_brand")
    sku = (inputs(i.v)["sku"]().join(own, "product_id", "left")
           .where(F.col("is_own_brand") == 1).drop("is_own_brand"))
    contrib = inputs(i.v)["contrib"]()
    return RC.sov_recommendations(i.fr["brand_rows"], i.fr["drivers"], i.cat_metrics, i.fr["cities"],
                                  i.tiers, i.merged_comp, sku, contrib, scores, recs, low, change)


def discount_recs(spark, sf, i=None):
    i = i or Inputs(spark, sf)
    return RC.discount_recommendations(i.fr["brand_rows"], i.fr["drivers"], i.cat_metrics, i.fr["cities"],
                                       i.tiers, i.merged_comp)


def merged_recs(osa, sov):
    cat = ["account", "gc_platform", "bgr", "brand"]
    o = osa.select(*cat, F.col("recommendation").alias("recommendation_osa"))
    s = sov.select(*cat, "gc_city", F.col("recommendation").alias("recommendation_sov"))
    return RC.merge_recommendations(s.join(o, cat, "full"))


@register("osa_recs")
def q_osa_recs(spark, sf):
    return osa_recs(spark, sf)


@register("sov_recs")
def q_sov_recs(spark, sf):
    return sov_recs(spark, sf)


@register("discount_recs")
def q_discount_recs(spark, sf):
    return discount_recs(spark, sf)


@register("text_rules")
def q_text_rules(spark, sf):
    i = Inputs(spark, sf)
    return merged_recs(osa_recs(spark, sf, i), sov_recs(spark, sf, i))


# several accounts (order priorities): more drivers, so the availability rules print lines
@register("osa_recs_accounts")
def q_osa_recs_accounts(spark, sf):
    return osa_recs(spark, sf, Inputs(spark, sf, Views.shared(spark, sf, "by_priority")))


@register("text_rules_accounts")
def q_text_rules_accounts(spark, sf):
    i = Inputs(spark, sf, Views.shared(spark, sf, "by_priority"))
    return merged_recs(osa_recs(spark, sf, i), sov_recs(spark, sf, i))


# ------------------------------------------------------------------ oracle SQL
def _renamed_cat_block() -> str:
    import re

    from shelfpulse.checks.q_metrics import BM_CAT
    s = BM_CAT
    for name in ("valid", "src2", "src", "wt", "bp", "mbi", "mi", "bs", "merged", "bi", "bm"):
        s = re.sub(rf"\b{name}\b", f"cat_{name}", s)
    return s


def _f1(x: str) -> str:
    return f"printf('%.1f', round_even(({x}) * 10.0, 0) / 10.0)"


def _pct(x: str) -> str:
    return f"{_f1(x)} || '%'"


def _discount_sql() -> str:
    from shelfpulse.checks.oracle_views import with_views
    from shelfpulse.checks.q_drill import drill_ctes
    from shelfpulse.checks.q_metrics import CAT_KEYS, METRICS, NAMES, change_sql
    cat = "account, gc_platform, bgr, brand"
    on = lambda a, b, ks: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in ks.split(","))
    where = "account, gc_platform, bgr, gc_city"
    return with_views(drill_ctes("down") + ",\n" + _renamed_cat_block().strip() + f""",
cat_ch AS ({change_sql("cat_bm", CAT_KEYS + ["is_own_brand"], METRICS, NAMES, False)}),
ctx AS (
  SELECT d.account, d.gc_platform, d.bgr, d.brand, d.share_dr1 AS cat_share_dr1, d.pct_change AS cat_change_market_share,
    m.wt_discounting_dr1 AS cat_wt_discounting_dr1, m.change_wt_discounting AS cat_change_wt_discounting
  FROM drivers d LEFT JOIN (SELECT * FROM cat_ch WHERE is_own_brand = 1) m ON {on('d', 'm', cat)}
),
drows AS (
  SELECT b.account, b.gc_platform, b.bgr, b.gc_city, b.brand, b.ppu_category, x.cat_share_dr1,
    x.cat_change_market_share, x.cat_wt_discounting_dr1, x.cat_change_wt_discounting
  FROM brand_rows b JOIN ctx x ON {on('b', 'x', cat)}
  WHERE b.change_wt_discounting < 0
),
mcomp AS (
  SELECT ci.account, ci.gc_platform, ci.bgr, ci.gc_city, ci.brand, ci.pct_change, ci.share_dr1,
    m.wt_discounting_dr1, m.change_wt_discounting, t.ppu_category AS tier
  FROM comp_imp ci
  LEFT JOIN (SELECT * FROM bmch WHERE is_own_brand = 0) m ON {on('ci', 'm', 'account, gc_platform, bgr, gc_city, brand')}
  LEFT JOIN (SELECT * FROM tiers WHERE is_own_brand = 0) t ON {on('ci', 't', cat)}
  WHERE m.change_wt_discounting > 0 AND ci.pct_change > 0
),
drv AS (SELECT DISTINCT {where}, ppu_category FROM drows),
l1c AS (SELECT c.* FROM mcomp c WHERE EXISTS (SELECT 1 FROM drv d WHERE {on('c', 'd', where)} AND d.ppu_category = c.tier)),
l2c AS (SELECT c.* FROM mcomp c WHERE EXISTS (SELECT 1 FROM drv d WHERE {on('c', 'd', where)})),
pick AS (
  SELECT *, 1 AS lvl FROM (
    SELECT *, row_number() OVER (PARTITION BY {where}, tier ORDER BY change_wt_discounting DESC NULLS LAST, brand) AS r2 FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {where}, tier ORDER BY share_dr1 DESC NULLS LAST, brand) AS r1
                     FROM l1c) WHERE r1 <= 4)) WHERE r2 = 1
  UNION ALL
  SELECT *, 2 AS lvl FROM (
    SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY change_wt_discounting DESC NULLS LAST, brand) AS r2 FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY share_dr1 DESC NULLS LAST, brand) AS r1
                     FROM l2c) WHERE r1 <= 4)) WHERE r2 = 1
),
best AS (
  SELECT {where}, CASE WHEN lvl = 1 THEN tier END AS tier, lvl, brand AS comp, wt_discounting_dr1 AS comp_current,
    change_wt_discounting AS comp_change, share_dr1 AS comp_share, pct_change AS comp_ms_delta
  FROM pick
),
best_of AS (
  SELECT d.*, coalesce(s.comp, a.comp) AS comp, CASE WHEN s.comp IS NULL THEN a.comp_current ELSE s.comp_current END AS comp_current,
    CASE WHEN s.comp IS NULL THEN a.comp_change ELSE s.comp_change END AS comp_change,
    CASE WHEN s.comp IS NULL THEN a.comp_share ELSE s.comp_share END AS comp_share,
    CASE WHEN s.comp IS NULL THEN a.comp_ms_delta ELSE s.comp_ms_delta END AS comp_ms_delta
  FROM drv d
  LEFT JOIN (SELECT * FROM best WHERE lvl = 1) s ON {on('d', 's', where)} AND d.ppu_category = s.tier
  LEFT JOIN (SELECT * FROM best WHERE lvl = 2) a ON {on('d', 'a', where)}
)
SELECT r.account, r.gc_platform, r.bgr, r.gc_city, r.brand,
  CASE WHEN b.comp IS NOT NULL THEN chr(10) || b.comp || ' increased discounting to '
    || printf('%.0f', round_even(b.comp_current, 0)) || '% (' || printf('%+.0f', round_even(b.comp_change, 0))
    || '%) in ' || r.gc_city ELSE '' END AS what_happened,
  CASE WHEN b.comp IS NOT NULL THEN b.comp || '''s MS increased to ' || {_f1('b.comp_share')} || '% ('
    || printf('%+.0f', round_even(b.comp_ms_delta, 0)) || '%) in ' || r.gc_city ELSE '' END AS why_it_matters,
  {_pct('r.cat_wt_discounting_dr1')} AS wt_discounting_dr1,
  {_pct('r.cat_change_wt_discounting')} AS change_wt_discounting,
  {_pct('r.cat_share_dr1')} AS share_dr1,
  {_pct('r.cat_change_market_share')} AS pct_change
FROM drows r LEFT JOIN best_of b ON {on('r', 'b', where)} AND r.ppu_category IS NOT DISTINCT FROM b.ppu_category""", ("pid_metrics", "product_dim"))


ORACLE_EXTRA = {"discount_recs": _discount_sql()}


def _osa_sql() -> str:
    from shelfpulse.checks.oracle_views import with_views
    from shelfpulse.checks.q_drill import drill_ctes
    from shelfpulse.checks.q_metrics import CAT_KEYS, METRICS, NAMES, change_sql
    from shelfpulse.checks.q_stores import STORE_CTES
    from shelfpulse.checks.sqlbits import between
    cat = "account, gc_platform, bgr, brand"
    on = lambda a, b, ks: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in ks.split(","))

    def psl_text(x):
        return (f"CASE WHEN {x} >= 1e7 THEN '₹' || {_f1(x + ' / 1e7')} || ' Cr' "
                f"ELSE '₹' || {_f1(x + ' / 1e5')} || ' L' END")
    nl = "chr(10)"
    return with_views(drill_ctes("down") + ",\n" + _renamed_cat_block().strip() + ",\n" + STORE_CTES.strip() + f""",
cat_ch AS ({change_sql("cat_bm", CAT_KEYS + ["is_own_brand"], METRICS, NAMES, False)}),
ctx AS (
  SELECT d.account, d.gc_platform, d.bgr, d.brand, d.share_dr1 AS cat_share_dr1, d.pct_change AS cat_change_market_share,
    d.sales_impact AS cat_sales_impact, m.wt_osa_dr1 AS cat_wt_osa_dr1, m.change_wt_osa AS cat_change_wt_osa
  FROM drivers d LEFT JOIN (SELECT * FROM cat_ch WHERE is_own_brand = 1) m ON {on('d', 'm', cat)}
),
cc AS (
  SELECT c.account, c.gc_platform, c.bgr, c.brand, c.city_rank, c.gc_city,
    CAST(round_even(100 * c.sales_impact / x.cat_sales_impact, 0) AS BIGINT) AS pct
  FROM cities c JOIN ctx x ON {on('c', 'x', cat)} WHERE c.city_rank <= 2
),
geo AS (
  SELECT account, gc_platform, bgr, brand,
    string_agg(gc_city || ' (' || CAST(pct AS VARCHAR) || '%)', ' , ' ORDER BY city_rank) AS top_geo,
    arg_min(gc_city, city_rank) AS top_city
  FROM cc GROUP BY 1, 2, 3, 4
),
orows AS (
  SELECT b.account, b.gc_platform, b.bgr, b.brand, b.wt_osa_dr1, b.change_wt_osa, x.cat_share_dr1,
    x.cat_change_market_share, x.cat_wt_osa_dr1, x.cat_change_wt_osa, g.top_geo, g.top_city
  FROM brand_rows b JOIN ctx x ON {on('b', 'x', cat)} LEFT JOIN geo g ON {on('b', 'g', cat)}
  WHERE b.change_wt_osa < 0
),
psl_cat AS (
  SELECT account, gc_platform, bgr, CAST(round(SUM(CAST(psl_mrp AS DECIMAL(38,2))), 0) AS DOUBLE) AS psl_mrp
  FROM srows GROUP BY 1, 2, 3
),
skup AS (
  SELECT account, gc_platform, bgr, gc_city, product_id, title, SUM(CAST(psl_mrp AS DECIMAL(38,2))) AS p
  FROM srows GROUP BY 1, 2, 3, 4, 5, 6
),
sku1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr, gc_city
                   ORDER BY p DESC NULLS LAST, product_id) AS r FROM skup) WHERE r = 1
),
cnt AS (
  SELECT account, gc_platform, bgr, gc_city, product_id, title,
    count(DISTINCT locality)::BIGINT AS high_psl_stores, CAST(SUM(total_listed) AS BIGINT) AS listed_in
  FROM srows WHERE gc_city IS DISTINCT FROM 'Others' AND psl_tags_pf IS DISTINCT FROM 'medium'
  GROUP BY 1, 2, 3, 4, 5, 6
),
doi AS (
  SELECT account, gc_platform, gc_city, lower(bgr) AS bgr, product_id,
    round(avg(backend_doi_value), 0) AS bdoi, round(avg(frontend_doi_value), 0) AS fdoi
  FROM facility_doi WHERE {between('snapshot_date', *L1)} GROUP BY 1, 2, 3, 4, 5
),
full_osa AS (
  SELECT o.*, pc.psl_mrp, s.product_id, s.title, n.high_psl_stores, n.listed_in, dd.bdoi, dd.fdoi,
    n.high_psl_stores - n.listed_in AS gap
  FROM orows o
  LEFT JOIN psl_cat pc ON o.account = pc.account AND o.gc_platform = pc.gc_platform AND o.bgr = pc.bgr
  LEFT JOIN sku1 s ON o.account = s.account AND o.gc_platform = s.gc_platform AND o.bgr = s.bgr AND o.top_city = s.gc_city
  LEFT JOIN cnt n ON o.account = n.account AND o.gc_platform = n.gc_platform AND o.bgr = n.bgr
    AND o.top_city = n.gc_city AND s.product_id = n.product_id AND s.title = n.title
  LEFT JOIN doi dd ON o.account = dd.account AND o.gc_platform = dd.gc_platform AND o.bgr = dd.bgr
    AND o.top_city = dd.gc_city AND s.product_id = dd.product_id
),
lines AS (
  SELECT *, list_filter([
      CASE WHEN gap > 5 THEN '• Fix DS listing in ' || CAST(gap AS VARCHAR) || ' stores in ' || top_city || {nl} END,
      CASE WHEN bdoi = 0 THEN '• No stock available, fix backend inventory in ' || top_city || {nl}
           WHEN bdoi < 5 THEN '• Stock-out risk, Only ' || CAST(bdoi AS VARCHAR) || ' days of stock left in ' || top_city
             || '; backend inventory needs to be refilled' || {nl}
           ELSE CASE WHEN fdoi < 3 THEN '• Fix transfer issue from warehouse to DS in ' || top_city || {nl} END END],
    lambda x: x IS NOT NULL) AS fired
  FROM full_osa
)
SELECT account, gc_platform, bgr, brand, top_geo,
  {_pct('cat_share_dr1')} AS share_dr1, {_pct('cat_change_market_share')} AS pct_change,
  {_pct('cat_wt_osa_dr1')} AS wt_osa_dr1, {_pct('cat_change_wt_osa')} AS change_wt_osa,
  'OSA dropped from ' || CAST(CAST(trunc(wt_osa_dr1 - change_wt_osa) AS BIGINT) AS VARCHAR) || '% to ' || {_f1('wt_osa_dr1')}
    || '%' || {nl} || 'Top impacted cities are ' || coalesce(top_geo, '') AS what_happened,
  {psl_text('psl_mrp')} AS potential_sales_loss,
  CASE WHEN len(fired) > 0 THEN 'OSA Recommendations:' || {nl} || '- ' || coalesce(title, '') || ':' || {nl}
    || array_to_string(fired, '') ELSE '' END AS recommendation
FROM lines""", ("pid_metrics", "product_dim", "locality_metrics", "psl_daily_locality", "own_sku_base",
                "facility_doi"))


ORACLE_EXTRA["osa_recs"] = _osa_sql()


def _sov_sql() -> str:
    import re

    from shelfpulse.checks.oracle_views import with_views
    from shelfpulse.checks.q_drill import drill_ctes
    from shelfpulse.checks.q_keywords import G, KBS_SQL, KW_CTES
    from shelfpulse.checks.q_metrics import CAT_KEYS, METRICS, NAMES, change_sql
    from shelfpulse.checks.sqlbits import between
    cat = "account, gc_platform, bgr, brand"
    where = "account, gc_platform, bgr, gc_city"
    on = lambda a, b, ks: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in ks.split(","))
    nl = "chr(10)"
    # keyword x brand SOV as CTEs with private names
    kbs = KBS_SQL
    for name in ("t", "s", "z", "bi"):
        kbs = re.sub(rf"\b{name}\b(?=\s+AS \(|\.|\s+LEFT|\s+USING|\s*$)", f"kb_{name}", kbs)
    kbs = kbs.replace("FROM t LEFT JOIN s", "FROM kb_t LEFT JOIN kb_s").replace("FROM z LEFT JOIN bi", "FROM kb_z LEFT JOIN kb_bi")
    head, final = kbs.rsplit("SELECT z.brand", 1) if "SELECT z.brand" in kbs else kbs.rsplit("SELECT kb_z.brand", 1)
    kbs_ctes = head.strip().rstrip(",") + ",\nkbs AS (SELECT kb_z.brand" + final.replace("z.", "kb_z.").replace(
        "bi.", "kb_bi.").replace("kb_kb_", "kb_") + ")"
    quoted = lambda arr: f"array_to_string(list_transform({arr}, lambda x: '“' || x || '”'), ' and ')"
    return with_views(drill_ctes("down") + ",\n" + _renamed_cat_block().strip() + ",\n" + KW_CTES.strip() + ",\n"
                      + kbs_ctes + f""",
cat_ch AS ({change_sql("cat_bm", CAT_KEYS + ["is_own_brand"], METRICS, NAMES, False)}),
kbc AS ({change_sql("kbs", ["account", "gc_platform", "bgr", "brand", "keyword", "gc_city"], ["ad_sov"], dict(), True)}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY final_score DESC, keyword) AS rn,
    row_number() OVER (PARTITION BY {G}, (coalesce(sov_dr1 < sov_dr2, false)) ORDER BY final_score DESC, keyword) AS frn,
    count(*) FILTER (WHERE coalesce(sov_dr1 < sov_dr2, false)) OVER (PARTITION BY {G}) AS nfell
  FROM rel
),
recs AS (
  SELECT {G}, list(keyword ORDER BY final_score DESC, keyword) FILTER (
    WHERE (nfell > 0 AND coalesce(sov_dr1 < sov_dr2, false) AND frn <= 2) OR (nfell = 0 AND rn = 1)) AS rec_keywords
  FROM ranked GROUP BY {G}
),
ctb AS (
  SELECT account, product_id, title, gc_platform, bgr, gc_city,
    ROUND(100.0 * CAST(total_mrp AS DOUBLE) / NULLIF(CAST(SUM(total_mrp) OVER (PARTITION BY account, gc_platform, bgr, gc_city) AS DOUBLE), 0), 1) AS contribution_pct
  FROM (SELECT account, product_id, title, gc_platform, bgr, gc_city, SUM(reported_offtake_mrp) AS total_mrp
        FROM pid_metrics WHERE {between('snapshot_date', *L1)} AND is_own_brand = 1
        GROUP BY account, product_id, title, gc_platform, bgr, gc_city)
),
ctx AS (
  SELECT d.account, d.gc_platform, d.bgr, d.brand, d.share_dr1 AS cat_share_dr1, d.pct_change AS cat_change_market_share,
    d.sales_impact AS cat_sales_impact, m.sov_dr1 AS cat_sov_dr1, m.change_sov AS cat_change_sov
  FROM drivers d LEFT JOIN (SELECT * FROM cat_ch WHERE is_own_brand = 1) m ON {on('d', 'm', cat)}
),
topc AS (SELECT account, gc_platform, bgr, brand, arg_min(gc_city, city_rank) AS top_city FROM cities
         WHERE city_rank <= 2 GROUP BY 1, 2, 3, 4),
srows0 AS (
  SELECT b.account, b.gc_platform, b.bgr, b.gc_city, b.brand, b.ppu_category, b.sov_dr1, b.change_sov, b.wt_osa_dr1,
    b.change_wt_osa, x.cat_share_dr1, x.cat_change_market_share, x.cat_sov_dr1, x.cat_change_sov, tc.top_city
  FROM brand_rows b JOIN ctx x ON {on('b', 'x', cat)} LEFT JOIN topc tc ON {on('b', 'tc', cat)}
  WHERE b.change_sov < 0
),
sov_sku AS (
  SELECT * FROM (
    SELECT s.account, s.gc_platform, s.bgr, s.gc_city, s.title, s.change_sov AS sku_change_sov,
      s.change_wt_osa AS sku_change_wt_osa,
      row_number() OVER (PARTITION BY s.account, s.gc_platform, s.bgr, s.gc_city
                         ORDER BY c.contribution_pct DESC NULLS LAST, s.product_id) AS r
    FROM sc s JOIN product_dim pd ON s.product_id = pd.product_id
    LEFT JOIN ctb c ON {on('s', 'c', where)} AND s.product_id = c.product_id AND s.title = c.title
    WHERE pd.is_own_brand = 1 AND c.contribution_pct > 5 AND s.change_sov < 0 AND s.change_wt_osa < 0
  ) WHERE r = 1
),
sov_mc AS (
  SELECT ci.account, ci.gc_platform, ci.bgr, ci.gc_city, ci.brand, ci.share_dr1, m.wt_osa_dr1, m.change_adsov,
    t.ppu_category AS tier
  FROM comp_imp ci
  LEFT JOIN (SELECT * FROM bmch WHERE is_own_brand = 0) m ON {on('ci', 'm', 'account, gc_platform, bgr, gc_city, brand')}
  LEFT JOIN (SELECT * FROM tiers WHERE is_own_brand = 0) t ON {on('ci', 't', cat)}
),
sov_tgt AS (
  SELECT m.account, m.gc_platform, m.bgr, m.gc_city, d.ppu_category,
    coalesce(max(CASE WHEN m.tier = d.ppu_category THEN m.wt_osa_dr1 END),
             max(CASE WHEN m.tier IS NOT NULL THEN m.wt_osa_dr1 END)) AS target
  FROM sov_mc m JOIN (SELECT DISTINCT {where}, ppu_category FROM srows0) d ON {on('m', 'd', where)}
  GROUP BY 1, 2, 3, 4, 5
),
sov_comp AS (
  SELECT account, gc_platform, bgr, brand AS comp_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr
                                 ORDER BY change_adsov DESC NULLS LAST, brand, gc_city) AS r2 FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr
                       ORDER BY share_dr1 DESC NULLS LAST, brand, gc_city) AS r1
                     FROM sov_mc WHERE tier IS NOT NULL AND change_adsov > 0) WHERE r1 <= 4)) WHERE r2 = 1
),
sr AS (
  SELECT s.*, os.title, os.sku_change_sov, os.sku_change_wt_osa,
    CASE WHEN s.wt_osa_dr1 > tg.target THEN s.wt_osa_dr1 - s.change_wt_osa ELSE tg.target END AS target_osa,
    cp.comp_ms
  FROM srows0 s
  LEFT JOIN sov_sku os ON {on('s', 'os', where)}
  LEFT JOIN sov_tgt tg ON {on('s', 'tg', where)} AND s.ppu_category = tg.ppu_category
  LEFT JOIN sov_comp cp ON s.account = cp.account AND s.gc_platform = cp.gc_platform AND s.bgr = cp.bgr
),
kb AS (
  SELECT k.account, k.gc_platform, k.bgr, k.gc_city, k.brand, k.keyword, rl.final_score
  FROM kbc k LEFT JOIN rel rl ON {on('k', 'rl', where)} AND k.keyword = rl.keyword
  WHERE k.change_ad_sov > 0
    AND EXISTS (SELECT 1 FROM sr WHERE {on('k', 'sr', where)} AND sr.comp_ms = k.brand)
),
kbl AS (
  SELECT {where}, list(keyword ORDER BY r) AS comp_keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY final_score DESC NULLS LAST, keyword) AS r FROM kb)
  WHERE r <= 2 GROUP BY 1, 2, 3, 4
),
low10 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY ad_sov DESC NULLS LAST, keyword) AS r
                 FROM lowrel WHERE ad_sov > 0 AND relevant_score < 0.5) WHERE r <= 10
),
drop1 AS (
  SELECT {where}, keyword AS drop_keyword FROM (
    SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY final_score ASC NULLS LAST, keyword) AS r2 FROM low10)
  WHERE r2 = 1
),
fin AS (
  SELECT sr.*, kbl.comp_keywords, recs.rec_keywords, drop1.drop_keyword,
    CASE WHEN sr.top_city IS NOT NULL THEN '• Top impacted geographies – ' || sr.top_city END AS what2
  FROM sr LEFT JOIN kbl ON {on('sr', 'kbl', where)} LEFT JOIN recs ON {on('sr', 'recs', where)}
  LEFT JOIN drop1 ON {on('sr', 'drop1', where)}
),
sov_lines AS (
  SELECT *, list_filter([
      CASE WHEN title IS NOT NULL AND sku_change_wt_osa <= -5.0 AND target_osa IS NOT NULL THEN
        '• ' || title || ': Restore OSA to ' || CAST(CAST(ceil(target_osa / 5) * 5 AS DOUBLE) AS VARCHAR)
        || '% to improve organic SOV' END,
      CASE WHEN len(coalesce(rec_keywords, [])) > 0 THEN '• Increase Ad SOV on ' || {quoted('list_slice(rec_keywords, 1, 2)')} || ' KWs' END,
      CASE WHEN drop_keyword IS NOT NULL THEN '• Remove ad spends from ' || drop_keyword END],
    lambda x: x IS NOT NULL) AS rl
  FROM fin
)
SELECT account, gc_platform, bgr, gc_city, brand,
  concat_ws({nl}, '• Overall SOV dropped from ' || {_f1('sov_dr1 - change_sov')} || '% to ' || {_f1('sov_dr1')} || '%', what2) AS what_happened,
  concat_ws({nl},
    CASE WHEN title IS NOT NULL THEN '• ' || title || ' SOV declined ' || {_f1('abs(sku_change_sov)')} || '% due to OSA drop' END,
    CASE WHEN len(coalesce(comp_keywords, [])) > 0 THEN '• ' || comp_ms || ' gained SOV on KWs – ' || {quoted('comp_keywords')} END,
    what2) AS rca,
  CASE WHEN len(rl) > 0 THEN 'Sov Recommendation:' || {nl} || array_to_string(rl, {nl}) ELSE '' END AS recommendation,
  {_pct('cat_share_dr1')} AS share_dr1, {_pct('cat_change_market_share')} AS pct_change,
  {_pct('cat_sov_dr1')} AS sov_dr1_text, {_pct('cat_change_sov')} AS change_sov_text
FROM sov_lines""", ("pid_metrics", "product_dim", "keyword_impressions"))


ORACLE_EXTRA["sov_recs"] = _sov_sql()


def _text_rules_sql() -> str:
    nl = "chr(10)"

    def strip(x):
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    def first_group(lines, pattern):
        return (f"trim(list_filter(list_transform({lines}, lambda l: regexp_extract(l, '{pattern}', 1)), "
                f"lambda x: x <> '')[1])")

    def drop_orphan(lines, header):
        ne = f"list_filter({lines}, lambda l: trim(l) <> '')"
        return (f"CASE WHEN len({ne}) = 1 AND regexp_matches({ne}[1], '{header}') THEN []::VARCHAR[] "
                f"ELSE {lines} END")

    def tidy(lines):
        return strip(f"regexp_replace(array_to_string({lines}, {nl}), '\\n{{3,}}', {nl} || {nl}, 'g')")
    restore = "regexp_matches(l, '(?i)restore\\s+osa')"
    right = ("CASE WHEN instr(l, ':') > 0 THEN trim(regexp_extract(l, '(?s)^[^:]*:(.*)$', 1)) "
             "ELSE trim(regexp_replace(l, '^\\s*[•-]\\s*', '')) END")
    return f"""WITH o AS ({_osa_sql()}),
s AS ({_sov_sql()}),
j AS (
  SELECT coalesce(s.account, o.account) AS account, coalesce(s.gc_platform, o.gc_platform) AS gc_platform,
    coalesce(s.bgr, o.bgr) AS bgr, coalesce(s.brand, o.brand) AS brand, s.gc_city,
    s.recommendation AS recommendation_sov, o.recommendation AS recommendation_osa
  FROM s FULL JOIN o ON s.account = o.account AND s.gc_platform = o.gc_platform AND s.bgr = o.bgr AND s.brand = o.brand
),
p AS (
  SELECT *, string_split({strip("coalesce(recommendation_sov, '')")}, {nl}) AS rec_l,
    string_split({strip("coalesce(recommendation_osa, '')")}, {nl}) AS osa_l
  FROM j
),
q AS (
  SELECT *, {first_group('rec_l', '(?i)^\\s*•\\s*(.+?)\\s*:')} AS sku_sov,
    {first_group('osa_l', '(?i)^\\s*-\\s*(.+?)\\s*:')} AS sku_osa,
    list_transform(list_filter(rec_l, lambda l: {restore}), lambda l: trim(l)) AS restore_l,
    list_transform(list_filter(rec_l, lambda l: NOT {restore} AND trim(l) <> ''), lambda l: trim(l)) AS other_l
  FROM p
),
m AS (
  SELECT *, list_concat(osa_l, list_transform(restore_l, lambda l:
      CASE WHEN sku_sov IS NOT NULL AND sku_osa IS NOT NULL AND sku_sov = sku_osa THEN '• ' || {right}
           WHEN sku_sov IS NOT NULL THEN '- ' || sku_sov || ': ' || {right}
           ELSE '• ' || {right} END)) AS osa_all
  FROM q
),
t AS (
  SELECT account, gc_platform, bgr, brand, gc_city,
    {tidy(drop_orphan('other_l', '(?i)^\\s*sov\\s+recommendation:?\\s*$'))} AS rec_txt,
    {tidy(drop_orphan('osa_all', '(?i)^\\s*osa\\s+recommendations?:?\\s*$'))} AS osa_txt
  FROM m
),
u AS (
  SELECT account, gc_platform, bgr, brand, gc_city,
    CASE WHEN rec_txt <> '' THEN rec_txt END AS recommendation_sov,
    CASE WHEN osa_txt <> '' THEN osa_txt END AS recommendation_osa
  FROM t
)
SELECT *, CASE WHEN concat_ws({nl} || {nl}, recommendation_osa, recommendation_sov) <> ''
  THEN concat_ws({nl} || {nl}, recommendation_osa, recommendation_sov) END AS recommendation
FROM u
WHERE concat_ws({nl} || {nl}, recommendation_osa, recommendation_sov) NOT IN ('', {nl})"""


ORACLE_EXTRA["text_rules"] = _text_rules_sql()
ORACLE_EXTRA |= {f"{key}_accounts": several_accounts(ORACLE_EXTRA[key]) for key in ("osa_recs", "text_rules")}
