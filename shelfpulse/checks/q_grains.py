"""Registered queries: four-grain impacts, item mapping, default windows, own and competitor
blocks, the platform and month layout, configs with mixed types."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfpulse.checks.oracle_views import with_views
from shelfpulse.checks.q_core import MARKET_SHARE_SQL_CTES, MS_KEYS, impact_sql, market_share_df, share_of
from shelfpulse.checks.q_metrics import PM_CTES
from shelfpulse.checks.registry import L1, L2, register
from shelfpulse.checks.sqlbits import between, label
from shelfpulse.functions import text as T
from shelfpulse.operators import periods as P
from shelfpulse.plans import metrics as M
from shelfpulse.plans.impacts import BASE, GRAINS, share_impact_grains
from shelfpulse.sources import tables as S
from shelfpulse.sources.views import Views


# ---------------------------------------------------------------- C13 at four grains
def _grain_sql(grain: str, extra: tuple[str, ...]) -> str:
    """One grain by itself: own sums per period, sizes of the category (x city), both joined."""
    keys = (*BASE, *extra)
    size_keys = [k for k in keys if k != "brand"]
    def on(a, b, cols):
        return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in cols)
    return f"""
    SELECT '{grain}' AS grain, {', '.join(f'a.{k} AS {k}' for k in BASE)},
      {'a.gc_city' if 'gc_city' in extra else 'CAST(NULL AS VARCHAR)'} AS gc_city,
      {'a.brand' if 'brand' in extra else 'CAST(NULL AS VARCHAR)'} AS brand,
      a.whole AS size_dr1, a.share AS share_dr1, a.sold AS actual_sales_dr1,
      b.whole AS size_dr2, b.share AS share_dr2, b.sold AS actual_sales_dr2,
      a.share - b.share AS pct_change,
      CAST(CAST(a.share - b.share AS DECIMAL(6,1)) * CAST(a.whole AS DECIMAL(20,4)) * 0.01::DECIMAL(3,2) AS DOUBLE) AS sales_impact
    FROM {grain}_p a JOIN {grain}_p b ON {on('a', 'b', keys)} AND a.date_period = 'dr1' AND b.date_period = 'dr2'""", f"""
{grain}_p AS (
  SELECT o.*, CAST(t.size AS DOUBLE) AS whole, {share_of('o.part', 't.size')} AS share
  FROM (SELECT date_period, {', '.join(keys)}, CAST(sum(reported_offtake_mrp) AS DOUBLE) AS sold, sum(normalized_offtake) AS part
        FROM msf WHERE date_period IS NOT NULL AND is_own_brand = 1 GROUP BY ALL) o
  JOIN (SELECT date_period, {', '.join(size_keys)}, sum(normalized_offtake) AS size
        FROM msf WHERE date_period IS NOT NULL GROUP BY ALL) t
    ON o.date_period = t.date_period AND {on('o', 't', size_keys)}
)"""


_PARTS = [_grain_sql(g, extra) for g, extra in GRAINS.items()]
_MSD_MSF = MARKET_SHARE_SQL_CTES[:MARKET_SHARE_SQL_CTES.index("msbrand AS")].rstrip().rstrip(",")


@register("share_impact_grains", with_views(
    _MSD_MSF + "," + ",".join(c for _, c in _PARTS) + "\nUNION ALL".join(q for q, _ in _PARTS),
    ("pid_metrics", "product_dim")))
def q_share_impact_grains(spark, sf):
    v = Views.shared(spark, sf)
    return share_impact_grains(v.pid_slice(L1, L2), v.product_dim(), L1, L2)


# ---------------------------------------------------------------- H6 with an item mapping
@register("product_metrics_mapped", with_views(PM_CTES + """,
mapping AS (
  SELECT DISTINCT gc_platform, product_id, upper(substr(gc_platform, 1, 2)) || '-' || product_id AS item_id,
    CASE WHEN CAST(grammage AS INTEGER) % 3 = 0 THEN 'combo' ELSE 'single' END AS type
  FROM pid_metrics WHERE """ + between("snapshot_date", L2[0], L1[1]) + """
)
SELECT pm.*, mp.item_id FROM pm
LEFT JOIN mapping mp ON pm.product_id = mp.product_id AND pm.gc_platform = mp.gc_platform AND mp.type = 'single'"""))
def q_product_metrics_mapped(spark, sf):
    """Every listed product has an item per platform; packs of a third of the sizes are no single items."""
    facts = Views.shared(spark, sf).pid_slice(L1, L2)
    mapping = facts.select(
        "gc_platform", "product_id",
        F.concat(F.upper(F.substring("gc_platform", 1, 2)), F.lit("-"), "product_id").alias("item_id"),
        F.when(F.col("grammage").cast("int") % 3 == 0, "combo").otherwise("single").alias("type")).distinct()
    return M.product_metrics(facts, mapping, L1, L2)


# ---------------------------------------------------------------- default windows
@register("default_windows", with_views("""
lastday AS (SELECT account, max(snapshot_date) AS l1_end FROM pid_metrics GROUP BY account),
win AS (SELECT account, CAST(date_trunc('month', l1_end) AS DATE) AS l1_start, l1_end FROM lastday)
SELECT account, l1_start, l1_end, CAST(l1_start - INTERVAL 30 DAY AS DATE) AS l2_start,
  CAST(l1_start - INTERVAL 1 DAY AS DATE) AS l2_end FROM win""", by_priority=True))
def q_default_windows(spark, sf):
    return P.default_windows(Views.shared(spark, sf, "by_priority").pid_metrics())


@register("default_windows_sales", with_views("""
win AS (SELECT account, max(snapshot_date) AS last, date_trunc('month', max(snapshot_date)) AS start
        FROM pid_metrics GROUP BY account)
SELECT p.account, p.gc_platform, CASE WHEN p.snapshot_date >= win.start THEN 'dr1' ELSE 'dr2' END AS date_period,
  count(*)::BIGINT AS n_rows, CAST(sum(p.normalized_offtake) AS DOUBLE) AS offtake
FROM pid_metrics p JOIN win ON p.account = win.account
  AND p.snapshot_date BETWEEN win.start - INTERVAL 30 DAY AND win.last
GROUP BY ALL""", by_priority=True))
def q_default_windows_sales(spark, sf):
    d = P.label_default_windows(Views.shared(spark, sf, "by_priority").pid_metrics())
    return d.groupBy("account", "gc_platform", "date_period").agg(
        F.count("*").alias("n_rows"), F.sum("normalized_offtake").cast("double").alias("offtake"))


# ---------------------------------------------------------------- G2 own and competitor blocks
@register("own_comp_blocks", with_views(MARKET_SHARE_SQL_CTES + f""",
own AS ({impact_sql('ms', MS_KEYS, 'is_own_brand = 1')}),
comp AS ({impact_sql('ms', MS_KEYS, 'is_own_brand = 0')})
SELECT {MS_KEYS}, pct_change, sales_impact, 1 AS is_own FROM own WHERE sales_impact < 0
UNION ALL
SELECT c.account, c.gc_platform, c.bgr, c.gc_city, c.brand, c.pct_change, NULL, 0 FROM comp c
WHERE c.pct_change > 0 AND EXISTS (SELECT 1 FROM own o WHERE o.sales_impact < 0 AND o.account = c.account
  AND o.gc_platform = c.gc_platform AND o.bgr = c.bgr AND o.gc_city = c.gc_city)""",
    ("pid_metrics", "product_dim")))
def q_own_comp_blocks(spark, sf):
    """Falling own rows and, for their categories and cities, the competitors that rise."""
    ms = market_share_df(spark, sf)
    keys = [k.strip() for k in MS_KEYS.split(",")]
    own = (P.share_impact(ms.where(F.col("is_own_brand") == 1), keys).where("sales_impact < 0")
           .select(*keys, "pct_change", "sales_impact"))
    rising = P.share_impact(ms.where(F.col("is_own_brand") == 0), keys).where("pct_change > 0")
    comp = rising.select(*keys, "pct_change").join(own.select(*keys[:-1]), keys[:-1], "left_semi")
    return S.union_blocks(own, comp)


# ---------------------------------------------------------------- layout with pruned platforms
@register("platform_months", with_views(f"""
SELECT p.gc_platform, {label()} AS date_period, count(*)::BIGINT AS n_rows,
  CAST(sum(p.normalized_offtake) AS DOUBLE) AS offtake
FROM pid_metrics p
WHERE ({between('p.snapshot_date', *L1)} OR {between('p.snapshot_date', *L2)})
  AND p.gc_platform IN (SELECT lower(c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey
                        WHERE n_nationkey < 5 GROUP BY 1 HAVING min(c_custkey) % 2 = 0)
GROUP BY ALL"""))
def q_platform_months(spark, sf):
    """Both windows of the platforms that the accounts' configuration enables, from the layout."""
    v = Views.shared(spark, sf)
    enabled = (v.table("customer").where(F.col("c_nationkey") < 5)
               .groupBy(F.lower("c_mktsegment").alias("gc_platform")).agg(F.min("c_custkey").alias("first"))
               .where(F.col("first") % 2 == 0))
    d = P.label_period(v.platform_months((L1, L2), enabled), "snapshot_date", L1, L2)
    return d.groupBy("gc_platform", "date_period").agg(
        F.count("*").alias("n_rows"), F.sum("normalized_offtake").cast("double").alias("offtake"))


# ---------------------------------------------------------------- K7 with mixed types
@register("json_flags_mixed", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE CAST(c_custkey AS VARCHAR) END AS name,
  c_nationkey % 2 = 0 AS build_blinkit, c_nationkey % 3 = 0 AS build_instamart, false AS build_zepto
FROM customer""")
def q_json_flags_mixed(spark, sf):
    """Configs whose entries are of several types: numbers, texts, lists and objects among the flags."""
    config = F.format_string(
        '{"redshift": {"database": %s}, "dbt": {"variables": [7, "text", null, ["x"], '
        '{"name": {"a": 1}, "value": true}, {"name": "threshold", "value": 0.5}, '
        '{"name": "build_normalized_offtake_zepto", "value": [true]}, '
        '{"name": "build_normalized_offtake_blinkit", "value": %s}, '
        '{"name": "build_normalized_offtake_instamart", "value": "%s"}]}}',
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), F.lower("c_mktsegment"), F.lit('"')))
        .otherwise(F.col("c_custkey").cast("string")),
        (F.col("c_nationkey") % 2 == 0).cast("string"), (F.col("c_nationkey") % 3 == 0).cast("string"))
    d = S.scan_table(spark, sf, "customer").withColumn("config", config)
    return d.select("c_custkey", *T.json_flags("config"))


