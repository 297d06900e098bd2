"""Registered queries: impact text, what happened, new launches."""

from __future__ import annotations

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_core import MS_KEYS
from shelfpulse.checks.q_drill import COMP_SKU_SQL, drill_ctes, frames, inputs, on
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.plans import metrics as M
from shelfpulse.plans import summaries as SU
from shelfpulse.sources.views import Views


def re1(x: str) -> str:
    """pandas round to one decimal, printed with one decimal."""
    return f"printf('%.1f', round_even(({x}) * 10.0, 0) / 10.0)"


IMPACT_TEXT_SQL = with_views(drill_ctes("down") + f""",
dd AS (
  SELECT account, gc_platform, bgr, brand, sales_impact, share_dr1, pct_change,
    CASE WHEN pct_change >= 0 THEN 'While Pan-India share did not decline, localized impact in this segment led to a sales loss of INR '
           || {re1('abs(sales_impact) / 100000')} || ' lakhs'
         ELSE 'Sales Opportunity Loss: INR ' || {re1('abs(sales_impact) / 100000')} || ' lakhs' || chr(10) || chr(10)
           || 'Category Share: ' || {re1('share_dr1')} || '% (' || {re1('pct_change')} || '%)' || chr(10) END AS impact_text
  FROM drivers
),
cc AS (
  SELECT c.account, c.gc_platform, c.bgr, c.brand, c.city_rank, c.gc_city,
    round_even(((c.sales_impact / d.sales_impact) * 100) * 10.0, 0) / 10.0 AS p
  FROM cities c JOIN drivers d ON c.account = d.account AND c.gc_platform = d.gc_platform AND c.bgr = d.bgr AND c.brand = d.brand
  WHERE c.city_rank <= 3
),
cg AS (
  SELECT account, gc_platform, bgr, brand, count(*) AS n,
    max(CASE WHEN city_rank = 1 THEN gc_city END) AS c1, max(CASE WHEN city_rank = 1 THEN p END) AS p1,
    max(CASE WHEN city_rank = 2 THEN gc_city END) AS c2, max(CASE WHEN city_rank = 2 THEN p END) AS p2,
    max(CASE WHEN city_rank = 3 THEN p END) AS p3,
    string_agg(gc_city || ' (' || CAST(CAST(round_even(p, 0) AS BIGINT) AS VARCHAR) || '%)', ', ' ORDER BY city_rank) AS fb
  FROM cc GROUP BY 1, 2, 3, 4
),
geo AS (
  SELECT account, gc_platform, bgr, brand,
    CASE WHEN n >= 1 AND p1 >= 50 THEN c1 || '(' || CAST(CAST(round_even(p1, 0) AS BIGINT) AS VARCHAR) || '%)'
         WHEN (n >= 2 AND p1 + p2 >= 50) OR (n >= 3 AND p1 + p2 + p3 >= 50)
           THEN c1 || '(' || CAST(CAST(round_even(p1, 0) AS BIGINT) AS VARCHAR) || '%), '
             || c2 || '(' || CAST(CAST(round_even(p2, 0) AS BIGINT) AS VARCHAR) || '%)'
         ELSE fb END AS geo_text
  FROM cg
)
SELECT dd.*, geo.geo_text FROM dd JOIN geo USING (account, gc_platform, bgr, brand)""",
                             ("pid_metrics", "product_dim"))


@register("impact_text", IMPACT_TEXT_SQL)
def q_impact_text(spark, sf):
    fr = frames(spark, sf, "down")
    return SU.impact_by_city(fr["drivers"], fr["cities"])


@register("what_happened")
def q_what_happened(spark, sf):
    return happened_rows(spark, sf, Views.shared(spark, sf))


def happened_rows(spark, sf, v):
    fr = frames(spark, sf, "down", v)
    return SU.what_happened(fr["brand_rows"], fr["competitors"], inputs(v)["ch"](), fr["own_sku"], fr["comp_sku"])


# month over month (the reference's default window shape): launches need data in both months
LM1 = ("2000-11-01", "2000-11-30")
LM2 = ("2000-10-01", "2000-10-31")


def _sku_compare_sql(l1, l2) -> str:
    from shelfpulse.checks.q_metrics import SKU_COMPARE_CTES
    return SKU_COMPARE_CTES.replace(L1[0], l1[0]).replace(L1[1], l1[1]).replace(
        L2[0], l2[0]).replace(L2[1], l2[1])


def _launch_sql(l1, l2, registry: str) -> str:
    return with_views(_sku_compare_sql(l1, l2).strip() + f""",
nd AS (SELECT DISTINCT product_id, title, is_own_brand, lower(bgr) AS bgr FROM product_dim),
nb AS (
  SELECT s.account, s.product_id, s.first_seen, lower(s.gc_platform) AS gc_platform
  FROM {registry} s
  WHERE s.product_id IN (SELECT product_id FROM nd)
    AND s.first_seen >= date_trunc('month', DATE '{l1[1]}' - INTERVAL 1 MONTH)
),
nj AS (
  SELECT nb.*, nd.title, nd.is_own_brand, nd.bgr, a.gc_city, a.brand, a.change_market_share, a.market_share_dr1,
    a.change_wt_osa, a.wt_osa_dr1
  FROM nb LEFT JOIN nd ON nb.product_id = nd.product_id
  LEFT JOIN sc a ON a.account = nb.account AND a.gc_platform = nb.gc_platform AND a.bgr = nd.bgr
    AND a.product_id = nb.product_id AND a.title = nd.title
  WHERE nd.is_own_brand = 0
)
SELECT * EXCLUDE (rn, wt_osa_dr1, change_wt_osa),
  round_even(wt_osa_dr1 * 10.0, 0) / 10.0 AS wt_osa_dr1, round_even(change_wt_osa * 10.0, 0) / 10.0 AS change_wt_osa
FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform
        ORDER BY market_share_dr1 DESC NULLS LAST, product_id ASC NULLS LAST, gc_city ASC NULLS LAST) AS rn
      FROM nj WHERE change_wt_osa > 0)
WHERE rn = 1""", ("pid_metrics", "product_dim", registry))


@register("new_launches", _launch_sql(LM1, LM2, "sku_master"))
def q_new_launches(spark, sf):
    v = Views.shared(spark, sf)
    sku = M.sku_compare(M.product_metrics(v.pid_slice(L1, L2), None, LM1, LM2))
    return SU.new_launches(v.sku_master(), v.product_dim(), sku, LM1[1])


@register("new_launches_registry", _launch_sql(L1, L2, "sku_registry"))
def q_new_launches_registry(spark, sf):
    """Launches of the report's own windows, first seen by the product registry."""
    return registry_launches(Views.shared(spark, sf))


def registry_launches(v):
    return SU.new_launches(v.window_slice("sku_registry", L1, L2), v.product_dim(), inputs(v)["sku"](), L1[1])


@register("gain_summary")
def q_gain_summary(spark, sf):
    return gain_rows(spark, sf, Views.shared(spark, sf))


def gain_rows(spark, sf, v):
    fr = frames(spark, sf, "up", v)
    i = inputs(v)
    return SU.gain_summary(fr["drivers"], i["catm"](), fr["cities"], fr["brand_rows"], i["sku"](),
                           i["contrib"](), i["kws"]())


def _f1(x: str) -> str:
    return f"printf('%.1f', round_even(({x}) * 10.0, 0) / 10.0)"


def _moves_sql(sign: int) -> str:
    """Selected moves (list of structs) and status for one brand row, as SQL."""
    items = ", ".join(
        f"{{'i': {i}, 'label': '{label}', 'v': CAST({ch} AS DOUBLE), 'lvl': CAST({lvl} AS DOUBLE)}}"
        for i, (ch, label, lvl) in enumerate(SU.BRAND_CHANGE_LABELS))
    s = float(sign)
    arr = f"list_filter([{items}], lambda x: x.v IS NOT NULL)"
    signed = (f"list_sort(list_transform(list_filter({arr}, lambda x: x.v * {s} > 0), "
              f"lambda x: {{'o': -(x.v * {s}), 'i': x.i, 'label': x.label, 'v': x.v, 'lvl': x.lvl}}))")
    fall = (f"list_sort(list_transform({arr}, "
            f"lambda x: {{'o': -abs(x.v), 'i': x.i, 'label': x.label, 'v': x.v, 'lvl': x.lvl}}))")
    want, other = ("decreased", "increased") if sign < 0 else ("increased", "decreased")
    sel = f"CASE WHEN len({signed}) > 0 THEN list_slice({signed}, 1, 2) ELSE list_slice({fall}, 1, 2) END"
    status = f"CASE WHEN len({signed}) > 0 THEN '{want}' ELSE '{other}' END"
    return sel, status


def _block_sql(src: str, sign: int) -> str:
    sel, status = _moves_sql(sign)
    arrow = lambda x: f"CASE WHEN {x} > 0 THEN '↑' ELSE '↓' END"
    return f"""(
  SELECT *,
    brand || ' ' || array_to_string(list_transform(sel, lambda x: x.label), ' and ') || ' ' || status AS performance_line,
    brand || ' ' || array_to_string(list_concat(
      ['MS ' || {_f1('share_dr1')} || '% (' || {arrow('pct_change')} || {_f1('abs(pct_change)')} || '%)'],
      list_transform(sel, lambda x: x.label || ' ' || {_f1('coalesce(x.lvl, 0.0)')} || '% (' ||
        CASE WHEN x.v > 0 THEN '↑' ELSE '↓' END || {_f1('abs(x.v)')} || '%)')), chr(10) || chr(10)) AS brand_text
  FROM (SELECT *, {sel} AS sel, {status} AS status FROM {src})
)"""


WHAT_HAPPENED_SQL = with_views(drill_ctes("down") + f""",
cm AS (
  SELECT c.account, c.gc_platform, c.bgr, c.gc_city, c.brand, c.pct_change, c.share_dr1,
    m.wt_osa_dr1, m.wt_discounting_dr1, m.sov_dr1, m.ad_sov_dr1,
    m.change_wt_osa, m.change_wt_discounting, m.change_sov, m.change_adsov
  FROM comps c LEFT JOIN (SELECT * FROM bmch WHERE is_own_brand = 0) m
    ON c.account = m.account AND c.gc_platform = m.gc_platform AND c.bgr = m.bgr AND c.gc_city = m.gc_city
   AND c.brand = m.brand
),
comp_sku AS ({COMP_SKU_SQL}),
cb AS (SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM comp_sku s WHERE s.change_market_share IS NOT NULL AND {on('s', 'x', MS_KEYS)})
         THEN brand_text END AS brand_text) FROM {_block_sql('cm', +1)} x),
cr AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, gc_platform, bgr, gc_city
                   ORDER BY pct_change DESC NULLS LAST, brand ASC NULLS LAST) AS r
                 FROM cb WHERE pct_change IS NOT NULL) WHERE r <= 2
),
cg AS (
  SELECT account, gc_platform, bgr, gc_city,
    list(brand_text ORDER BY r) AS texts, list(performance_line ORDER BY r) AS perfs
  FROM cr GROUP BY 1, 2, 3, 4
),
ob AS (SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM own_sku s WHERE s.change_market_share IS NOT NULL AND {on('s', 'x', MS_KEYS)})
         THEN brand_text END AS brand_text) FROM {_block_sql('brand_rows', -1)} x)
SELECT ob.account, ob.gc_platform, ob.bgr, ob.gc_city, ob.brand,
  ob.brand_text AS what_happened1, cg.texts[1] AS what_happened2, cg.texts[2] AS what_happened3,
  array_to_string(list_concat([ob.performance_line], coalesce(cg.perfs, [])), chr(10)) AS performance
FROM ob LEFT JOIN cg ON ob.account = cg.account AND ob.gc_platform = cg.gc_platform AND ob.bgr = cg.bgr
  AND ob.gc_city = cg.gc_city""", ("pid_metrics", "product_dim"))


def _gain_sql() -> str:
    from shelfpulse.checks.q_keywords import KW_CTES
    from shelfpulse.checks.q_metrics import CAT_KEYS, METRICS, NAMES, change_sql
    from shelfpulse.checks.q_recs import _renamed_cat_block
    from shelfpulse.checks.sqlbits import between
    cat = "account, gc_platform, bgr, brand"
    where = "account, gc_platform, bgr, gc_city"
    on = lambda a, b, ks: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in ks.split(","))
    f1 = _f1
    return with_views(drill_ctes("up") + ",\n" + _renamed_cat_block().strip() + ",\n" + KW_CTES.strip() + f""",
cat_ch AS ({change_sql("cat_bm", CAT_KEYS + ["is_own_brand"], METRICS, NAMES, False)}),
cat_sh AS ({change_sql("cms", CAT_KEYS, ["market_share"], dict(), True)}),
catm AS (SELECT c.account, c.gc_platform, c.bgr, c.brand, s.market_share_dr1 FROM cat_ch c
         LEFT JOIN cat_sh s ON {on('c', 's', cat)} WHERE c.is_own_brand = 1),
geo AS (
  SELECT c.account, c.gc_platform, c.bgr, c.brand,
    string_agg(c.gc_city || ' (' || {f1('c.sales_impact / d.sales_impact * 100')} || '%)', ' and ' ORDER BY c.city_rank) AS geo_text
  FROM cities c JOIN drivers d ON {on('c', 'd', cat)} WHERE c.city_rank <= 2 GROUP BY 1, 2, 3, 4
),
dd AS (
  SELECT d.*, m.market_share_dr1, g.geo_text,
    CASE WHEN d.sales_impact >= 1e7 THEN {f1('d.sales_impact / 1e7')} || ' Cr' ELSE {f1('d.sales_impact / 1e5')} || ' L' END AS off,
    CAST(m.market_share_dr1 AS VARCHAR) || '% (' || {f1('d.pct_change')} || '%)' AS ms_text
  FROM drivers d LEFT JOIN catm m ON {on('d', 'm', cat)} LEFT JOIN geo g ON {on('d', 'g', cat)}
),
ctb AS (
  SELECT account, product_id, title, gc_platform, bgr, gc_city,
    ROUND(100.0 * CAST(total_mrp AS DOUBLE) / NULLIF(CAST(SUM(total_mrp) OVER (PARTITION BY account, gc_platform, bgr, gc_city) AS DOUBLE), 0), 1) AS contribution_pct
  FROM (SELECT account, product_id, title, gc_platform, bgr, gc_city, SUM(reported_offtake_mrp) AS total_mrp
        FROM pid_metrics WHERE {between('snapshot_date', *L1)} AND is_own_brand = 1
        GROUP BY account, product_id, title, gc_platform, bgr, gc_city)
),
gsk AS (
  SELECT * FROM (
    SELECT s.account, s.gc_platform, s.bgr, s.gc_city, s.brand, s.title, s.product_id,
      row_number() OVER (PARTITION BY s.account, s.gc_platform, s.bgr, s.gc_city, s.brand
                         ORDER BY c.contribution_pct DESC NULLS LAST, s.product_id) AS r
    FROM sc s LEFT JOIN ctb c ON {on('s', 'c', where)} AND s.product_id = c.product_id AND s.title = c.title
    WHERE s.change_ds_listing > 0
      AND EXISTS (SELECT 1 FROM brand_rows b WHERE {on('s', 'b', 'account, gc_platform, bgr, gc_city, brand')})
  ) WHERE r <= 2
),
sk AS (SELECT account, gc_platform, bgr, gc_city, brand, list(title ORDER BY r) AS titles FROM gsk GROUP BY 1, 2, 3, 4, 5),
kwc AS (
  SELECT *, sov_dr1 - sov_dr2 AS change_adsov FROM rel r
  WHERE relevant_score > 1 AND sov_dr1 - sov_dr2 > 0
    AND EXISTS (SELECT 1 FROM brand_rows b WHERE {on('r', 'b', where)})
),
kw10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY final_score DESC NULLS LAST, keyword) AS r1
                       FROM kwc) WHERE r1 <= 10),
kw2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {where} ORDER BY change_adsov DESC NULLS LAST, keyword) AS r2
                      FROM kw10) WHERE r2 <= 2),
kg AS (SELECT {where}, list(keyword ORDER BY r2) AS kws FROM kw2 GROUP BY 1, 2, 3, 4),
worked AS (
  SELECT b.account, b.gc_platform, b.bgr, b.brand,
    concat_ws(chr(10),
      CASE WHEN b.change_wt_osa > 0 THEN
        CASE WHEN len(coalesce(sk.titles, [])) = 1 THEN '•' || upper(substr(b.account, 1, 1)) || lower(substr(b.account, 2))
               || '''s OSA increased to ' || CAST(b.wt_osa_dr1 AS VARCHAR) || '%(+' || printf('%.0f', round_even(b.change_wt_osa, 0))
               || '%) by fixing DS listing for ' || sk.titles[1] || ' in ' || b.gc_city
             WHEN len(coalesce(sk.titles, [])) >= 2 THEN '• ' || upper(substr(b.account, 1, 1)) || lower(substr(b.account, 2))
               || '''s OSA increased to ' || CAST(b.wt_osa_dr1 AS VARCHAR) || '%(+' || printf('%.0f', round_even(b.change_wt_osa, 0))
               || '%) by fixing DS listing for ' || sk.titles[1] || ' and ' || sk.titles[2] || ' in ' || b.gc_city END END,
      CASE WHEN b.change_adsov > 0 THEN
        CASE WHEN len(coalesce(kg.kws, [])) > 0 THEN '• SOV increased to ' || {f1('b.ad_sov_dr1')} || '(+' || {f1('b.change_adsov')}
               || '%) by targeting relevant keywords - ' || array_to_string(kg.kws, ', ') ELSE '' END END,
      CASE WHEN b.change_wt_discounting > 0 THEN '• Discounting increased to ' || CAST(b.wt_discounting_dr1 AS VARCHAR)
        || '(+' || {f1('b.change_wt_discounting')} || '%) ,resulting in market share increase to '
        || CAST(b.share_dr1 AS VARCHAR) || '(' || {f1('b.pct_change')} || '%)' END) AS what_worked
  FROM brand_rows b
  LEFT JOIN sk ON {on('b', 'sk', 'account, gc_platform, bgr, gc_city, brand')}
  LEFT JOIN kg ON {on('b', 'kg', where)}
)
SELECT dd.account, dd.gc_platform, dd.bgr, dd.brand,
  'Offtake: ' || dd.off || ' (' || {f1('100 * (dd.actual_sales_dr1 - dd.actual_sales_dr2) / dd.actual_sales_dr2')} || '%)' || chr(10)
    || 'Category Share: ' || dd.ms_text || chr(10) || coalesce(dd.geo_text, '') AS result,
  dd.off AS offtake, coalesce(dd.geo_text, '') AS geo_text, dd.ms_text AS ms, w.what_worked
FROM dd LEFT JOIN worked w ON {on('dd', 'w', cat)}""", ("pid_metrics", "product_dim", "keyword_impressions"))


GAIN_SUMMARY_SQL = _gain_sql()
