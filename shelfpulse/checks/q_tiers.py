"""Registered queries: price tiers (H7)."""

from __future__ import annotations

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import between, null_greatest
from shelfpulse.plans import tiers as TR
from shelfpulse.sources.views import Views

PPU_CTES = f"""
ppd AS (SELECT product_id, lower(bgr) AS dbgr FROM product_dim),
ppg AS (
  SELECT m.account, lower(m.gc_platform) AS gc_platform, ppd.dbgr AS bgr, m.brand,
    round(CAST(SUM(CASE WHEN m.ppu_flag = 1 THEN m.price_per_100_units * {null_greatest('m.estimated_offtake_mrp', '1')} ELSE 0 END) AS DOUBLE)
      / NULLIF(CAST(SUM(CASE WHEN m.ppu_flag = 1 THEN {null_greatest('m.estimated_offtake_mrp', '1')} ELSE 0 END) AS DOUBLE), 0), 0) AS wt_ppu
  FROM pid_metrics m LEFT JOIN ppd ON m.product_id = ppd.product_id
  WHERE {between('m.snapshot_date', *L1)}
  GROUP BY 1, 2, 3, 4
),
ppfl AS (SELECT DISTINCT lower(bgr) AS bgr, brand, is_own_brand FROM product_dim),
ppu AS (
  SELECT ppg.account, ppg.gc_platform, ppg.bgr, ppg.brand, abs(ppg.wt_ppu) AS wt_ppu, ppfl.is_own_brand
  FROM ppg LEFT JOIN ppfl ON ppg.bgr IS NOT DISTINCT FROM ppfl.bgr AND ppg.brand = ppfl.brand
  WHERE ppg.wt_ppu IS NOT NULL
),
ppqt AS (
  SELECT ppu.*, quantile_cont(wt_ppu, 1/3) OVER g AS q1, quantile_cont(wt_ppu, 2/3) OVER g AS q2
  FROM ppu WINDOW g AS (PARTITION BY account, gc_platform, bgr)
),
tiers AS (
  SELECT account, gc_platform, bgr, brand, is_own_brand, wt_ppu, 'quantile' AS binning_method,
    CASE WHEN wt_ppu <= q1 THEN 'cost_effective' WHEN wt_ppu <= q2 THEN 'mid_range' ELSE 'premium' END AS ppu_category
  FROM ppqt
),
bounds AS (
  SELECT account, gc_platform, bgr, ppu_category,
    CAST(floor(min(wt_ppu) / 5) * 5 AS DOUBLE) AS ppu_lower_bound,
    CAST(ceil(max(wt_ppu) / 5) * 5 AS DOUBLE) AS ppu_upper_bound
  FROM tiers GROUP BY 1, 2, 3, 4
)"""


# k-means as a recursive query of its own: centres per group, moved until they stay
KMEANS_CTES = PPU_CTES[:PPU_CTES.index("ppqt AS (")] + """
kmq AS (
  SELECT account, gc_platform, bgr, count(*) AS brands, quantile_cont(wt_ppu, 0.05) AS lo, quantile_cont(wt_ppu, 0.95) AS hi,
    quantile_cont(wt_ppu, 1/3) AS q1, quantile_cont(wt_ppu, 2/3) AS q2
  FROM ppu GROUP BY 1, 2, 3
),
kmz AS (
  SELECT ppu.*, kmq.brands, kmq.q1, kmq.q2, row_number() OVER () AS row,
    dense_rank() OVER (ORDER BY ppu.account, ppu.gc_platform, ppu.bgr) AS gid,
    CAST(ln(1 + least(greatest(wt_ppu, lo), hi)) AS DECIMAL(18,12)) AS z
  FROM ppu JOIN kmq ON ppu.account = kmq.account AND ppu.gc_platform = kmq.gc_platform AND ppu.bgr IS NOT DISTINCT FROM kmq.bgr
),
kme AS (
  SELECT gid, CAST(min(z) AS DOUBLE) AS lo, CAST(max(z) AS DOUBLE) AS hi, count(*) AS n, sum(z) AS s,
    0.0001 * var_pop(CAST(z AS DOUBLE)) AS tol
  FROM kmz WHERE brands >= 3 GROUP BY gid
),
kmi AS (
  SELECT gid, 0 AS step, lo + (hi - lo) / 6 AS a, lo + (hi - lo) / 2 AS b, lo + (hi - lo) * 5 / 6 AS c, TRUE AS moving FROM kme
  UNION ALL
  SELECT gid, step + 1, list_sort([a2, b2, c2])[1], list_sort([a2, b2, c2])[2], list_sort([a2, b2, c2])[3],
    (a2 - a) ** 2 + (b2 - b) ** 2 + (c2 - c) ** 2 > tol AND step + 1 < 300
  FROM (
    SELECT *,
      CASE WHEN nb = 0 AND far > 0 AND far = greatest(round(abs(loa - a), 9), round(abs(hia - a), 9))
        THEN CASE WHEN na > 1 THEN (sa - CASE WHEN round(abs(loa - a), 9) = far THEN loa ELSE hia END) / (na - 1) ELSE a END
        ELSE sa / na END AS a2,
      CASE WHEN nb > 0 THEN sb / nb WHEN far = 0 THEN b WHEN round(abs(loa - a), 9) = far THEN loa WHEN round(abs(hia - a), 9) = far THEN hia
        WHEN round(abs(loc - c), 9) = far THEN loc ELSE hic END AS b2,
      CASE WHEN nb = 0 AND far > 0 AND far > greatest(round(abs(loa - a), 9), round(abs(hia - a), 9))
        THEN CASE WHEN nc > 1 THEN (sc - CASE WHEN round(abs(loc - c), 9) = far THEN loc ELSE hic END) / (nc - 1) ELSE c END
        ELSE sc / nc END AS c2
    FROM (
      SELECT *, greatest(round(abs(loa - a), 9), round(abs(hia - a), 9), round(abs(loc - c), 9), round(abs(hic - c), 9)) AS far
      FROM (
        SELECT i.gid, any_value(i.step) AS step, any_value(i.a) AS a, any_value(i.b) AS b, any_value(i.c) AS c, any_value(e.tol) AS tol,
          count(*) FILTER (side = 1) AS na, CAST(sum(z) FILTER (side = 1) AS DOUBLE) AS sa,
          count(*) FILTER (side = 2) AS nb, CAST(sum(z) FILTER (side = 2) AS DOUBLE) AS sb,
          count(*) FILTER (side = 3) AS nc, CAST(sum(z) FILTER (side = 3) AS DOUBLE) AS sc,
          CAST(min(z) FILTER (side = 1) AS DOUBLE) AS loa, CAST(max(z) FILTER (side = 1) AS DOUBLE) AS hia,
          CAST(min(z) FILTER (side = 3) AS DOUBLE) AS loc, CAST(max(z) FILTER (side = 3) AS DOUBLE) AS hic
        FROM kmi i JOIN kme e ON e.gid = i.gid JOIN (
          SELECT gid, z FROM kmz WHERE brands >= 3) v ON v.gid = i.gid
        CROSS JOIN LATERAL (SELECT CASE WHEN CAST(v.z AS DOUBLE) <= (i.a + i.b) / 2 THEN 1
                                        WHEN CAST(v.z AS DOUBLE) <= (i.b + i.c) / 2 THEN 2 ELSE 3 END AS side) t
        WHERE i.moving GROUP BY i.gid)))
),
kmc AS (
  SELECT i.gid, (a + b) / 2 AS m1, (b + c) / 2 AS m2, lo, hi FROM kmi i JOIN kme USING (gid) WHERE NOT moving
),
kmw AS (
  SELECT gid, list_filter([CASE WHEN m1 - lo > 1e-8 THEN m1 END, CASE WHEN m2 - m1 > 1e-8 THEN m2 END,
    CASE WHEN hi - m2 > 1e-8 THEN hi END], lambda x: x IS NOT NULL) AS edges FROM kmc
),
tiers AS (
  SELECT account, gc_platform, bgr, brand, is_own_brand, wt_ppu,
    CASE WHEN brands >= 3 THEN 'kmeans' ELSE 'quantile' END AS binning_method,
    CASE WHEN brands >= 3 THEN ['cost_effective', 'mid_range', 'premium'][1 + len(list_filter(edges[:len(edges) - 1], lambda x: x <= CAST(z AS DOUBLE)))]
      WHEN wt_ppu <= q1 THEN 'cost_effective' WHEN wt_ppu <= q2 THEN 'mid_range' ELSE 'premium' END AS ppu_category
  FROM kmz LEFT JOIN kmw USING (gid)
),""" + PPU_CTES[PPU_CTES.index("\nbounds AS ("):]

TIERS_SQL = ("\nSELECT t.*, b.ppu_lower_bound, b.ppu_upper_bound FROM tiers t JOIN bounds b "
             "ON t.account = b.account AND t.gc_platform = b.gc_platform AND t.bgr IS NOT DISTINCT FROM b.bgr "
             "AND t.ppu_category = b.ppu_category")


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("price_tier_quantile", with_views(
    PPU_CTES + TIERS_SQL, ("pid_metrics", "product_dim")))
def q_price_tier_quantile(spark, sf):
    v = Views.shared(spark, sf)
    return TR.price_tiers(v.pid_slice(L1, L2), v.product_dim(), L1, method="quantile")


@register("price_tier_bounds", with_views(PPU_CTES + "\nSELECT * FROM bounds",
                                          ("pid_metrics", "product_dim")))
def q_price_tier_bounds(spark, sf):
    v = Views.shared(spark, sf)
    tiers = TR.quantile_tiers(TR.brand_ppu(v.pid_slice(L1, L2), v.product_dim(), L1))
    return TR.tier_bounds(tiers)


@register("price_tier_kmeans", recursive(with_views(KMEANS_CTES + TIERS_SQL, ("pid_metrics", "product_dim"))))
def q_price_tier_kmeans(spark, sf):
    v = Views.shared(spark, sf)
    return TR.price_tiers(v.pid_slice(L1, L2), v.product_dim(), L1, method="auto")
