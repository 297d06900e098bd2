"""The views of ``shelfpulse.sources.views`` restated as DuckDB SQL for the oracle.

The oracle SQL for each registered query is ``WITH <views>, <query CTEs> SELECT``.
Values here must stay equal to the Spark side (fixed values of the mapping):
own brands Brand#1..Brand#5 and the upload date 2000-11-30.
"""

from __future__ import annotations

BASE = """
base AS (
  SELECT
    'main' AS account,
    CAST(l.l_shipdate AS DATE) AS snapshot_date,
    lower(c.c_mktsegment) AS gc_platform,
    lower(p.p_type) AS bgr,
    r.r_name AS gc_city,
    p.p_brand AS brand,
    CAST(p.p_partkey AS VARCHAR) AS product_id,
    p.p_name AS title,
    CAST(p.p_size AS VARCHAR) AS original_grammage,
    CAST(p.p_size AS DOUBLE) AS grammage,
    CASE WHEN p.p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') THEN 1 ELSE 0 END AS is_own_brand,
    CAST(p.p_retailprice AS DECIMAL(12,2)) AS mrp,
    CAST(p.p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS price,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) * (1 + CAST(l.l_tax AS DECIMAL(4,2))) AS reported_offtake_mrp,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS reported_offtake_sp,
    CAST(l.l_quantity AS DECIMAL(12,2)) AS reported_offtake_qty,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS normalized_offtake,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) AS estimated_offtake_mrp,
    CASE WHEN l.l_linenumber = 1 THEN NULL ELSE CAST(l.l_extendedprice AS DECIMAL(12,2)) END AS estimated_offtake_mrp_last_month,
    CASE WHEN l.l_linenumber IN (1, 2) THEN NULL ELSE CAST(l.l_extendedprice AS DECIMAL(12,2)) END AS estimated_offtake_mrp_current_month,
    CAST(l.l_quantity AS DECIMAL(12,2)) AS estimated_qty_sold,
    CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS asp_flag,
    CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS ppu_flag,
    CAST(p.p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) * 2 AS price_per_100_units,
    CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END AS total_available,
    CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END AS total_listed,
    1 AS total_scrapes,
    CAST(l.l_quantity AS DECIMAL(12,2)) AS total_impressions,
    CAST(l.l_quantity AS DECIMAL(12,2)) - CAST(floor(l.l_quantity * l.l_discount * 10) AS DECIMAL(12,2)) AS organic_impressions,
    CAST(floor(l.l_quantity * l.l_discount * 10) AS DECIMAL(12,2)) AS ad_impressions,
    DATE '2000-11-30' AS platform_offtake_uploaded_till,
    l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_quantity,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) AS ext,
    CAST(l.l_discount AS DECIMAL(4,2)) AS disc
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def several_accounts(sql: str) -> str:
    """The statement over several accounts: the order's priority names the account."""
    return sql.replace("'main' AS account", "'acct_' || substr(o.o_orderpriority, 1, 1) AS account")


BASE_BY_PRIORITY = several_accounts(BASE)

PID = """
pid_metrics AS (
  SELECT account, snapshot_date, gc_platform, bgr, gc_city, brand, product_id, title,
    original_grammage, grammage, is_own_brand, mrp, price, reported_offtake_mrp,
    reported_offtake_sp, reported_offtake_qty, normalized_offtake, estimated_offtake_mrp,
    estimated_offtake_mrp_last_month, estimated_offtake_mrp_current_month,
    estimated_qty_sold, asp_flag, ppu_flag, price_per_100_units, total_available,
    total_listed, total_scrapes, total_impressions, organic_impressions, ad_impressions,
    platform_offtake_uploaded_till
  FROM base
)"""

PRODUCT_DIM = """
product_dim AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, lower(p_type) AS bgr, p_brand AS brand,
    p_name AS title, CAST(p_size AS DOUBLE) AS grammage,
    CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') THEN 1 ELSE 0 END AS is_own_brand,
    CASE WHEN p_size % 10 = 0 THEN 'Y' ELSE NULL END AS is_platform_bundle
  FROM part
)"""

LOCALITY = """
locality_metrics AS (
  SELECT account, snapshot_date, gc_platform, gc_city, bgr,
    CAST(l_partkey AS VARCHAR) AS product_id,
    'sku ' || CAST(l_partkey AS VARCHAR) AS title,
    CAST(l_suppkey AS VARCHAR) AS store_id,
    'loc ' || CAST(l_suppkey AS VARCHAR) AS locality,
    total_available, total_listed, total_scrapes,
    estimated_offtake_mrp_last_month, estimated_offtake_mrp_current_month,
    ext * disc AS impact_scrore_for_psl_tags_pf,
    is_own_brand
  FROM base
)"""

KEYWORDS = """
keyword_impressions AS (
  SELECT account, snapshot_date, gc_platform, bgr, gc_city, title AS keyword, brand,
    is_own_brand, ad_impressions, total_impressions, grammage AS keyword_weight
  FROM base
)"""

PSL = """
psl_daily AS (
  SELECT account, gc_platform, product_id, CAST(l_suppkey AS VARCHAR) AS store_id,
    ext AS potential_sales_loss_mrp, snapshot_date AS gc_crawl_date
  FROM base WHERE l_returnflag = 'R'
)"""

PSL_LOCALITY = """
psl_daily_locality AS (
  SELECT account, gc_platform, CAST(l_partkey AS VARCHAR) AS product_id,
    CAST(l_suppkey AS VARCHAR) AS store_id,
    ext AS potential_sales_loss_mrp, snapshot_date AS gc_crawl_date
  FROM base WHERE l_returnflag = 'R'
)"""

DOI = """
facility_doi AS (
  SELECT account, snapshot_date, gc_platform, bgr, gc_city, title AS sku, product_id,
    l_quantity % 13 AS backend_doi_value, l_quantity % 7 AS frontend_doi_value
  FROM base
)"""

STORE_CATALOG = """
store_catalog AS (
  SELECT account, gc_platform,
    CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS store_id,
    gc_city, snapshot_date AS gc_crawl_date
  FROM base
)"""

SKU_MASTER = """
sku_master AS (
  SELECT account, gc_platform, product_id, min(snapshot_date) AS first_seen
  FROM base GROUP BY account, gc_platform, product_id
)"""

OWN_SKU_BASE = """
own_sku_base AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
    CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') THEN 1 ELSE 0 END AS is_own_brand
  FROM part
)"""

SKU_REGISTRY = """
sku_registry AS (
  SELECT DISTINCT account, gc_platform, product_id,
    CAST(DATE '2000-09-01' + CAST(grammage * 2 AS INTEGER) AS DATE) AS first_seen
  FROM base WHERE snapshot_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'
)"""

STORE_LISTING = """
store_listing AS (
  SELECT account, snapshot_date, gc_platform,
    CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS store_id,
    total_listed, is_own_brand
  FROM base
)"""

ALL_VIEWS = {
    "pid_metrics": PID, "product_dim": PRODUCT_DIM, "locality_metrics": LOCALITY,
    "keyword_impressions": KEYWORDS, "psl_daily": PSL, "psl_daily_locality": PSL_LOCALITY,
    "facility_doi": DOI, "store_catalog": STORE_CATALOG, "sku_master": SKU_MASTER,
    "own_sku_base": OWN_SKU_BASE, "sku_registry": SKU_REGISTRY, "store_listing": STORE_LISTING,
}


def with_views(body: str, views=("pid_metrics",), by_priority: bool = False) -> str:
    """Prefix ``body`` (``name AS (...), ... SELECT ...`` or a bare SELECT) with views."""
    parts = [BASE_BY_PRIORITY if by_priority else BASE]
    parts += [ALL_VIEWS[v] for v in views]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + ",".join(parts) + "\n" + body
    return "WITH " + ",".join(parts) + ",\n" + body
