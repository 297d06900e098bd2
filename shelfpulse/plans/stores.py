"""Store-level availability, potential sales loss and store coverage (H10, H11,
D10, D11, D21, D22, D23)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import row_weight, safe_div
from shelfpulse.operators.distinct import bitmaps, dense_numbers, merged_counts
from shelfpulse.operators.periods import _d, filter_periods, period_label
from shelfpulse.operators.windows import pareto_tag, ranked_running_share

STORE_KEYS = ("account", "gc_platform", "gc_city", "bgr", "product_id", "title", "store_id",
              "locality")
PARETO_PART = ("account", "date_period", "gc_platform", "gc_city", "bgr")


def store_period_metrics(loc: DataFrame, l1, l2, keys: Sequence[str] = STORE_KEYS) -> DataFrame:
    """One aggregate per (period, store x SKU): weighted OSA sums, listing on the
    last day of the period, potential-sales-loss impact.

    The reference runs three queries over the same table (OSA windows, impact
    ranking, last-day listing) and joins them; their grain is the same, so one
    ``groupBy`` with conditional sums replaces them (the last-day listing is
    the sum over rows dated at the period's end; NULL when there are none,
    like the unmatched left join).
    """
    f = filter_periods(loc, "snapshot_date", l1, l2).withColumn(
        "date_period", period_label("snapshot_date", l1, l2, "dr2"))
    w = row_weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
    last_day = (((F.col("date_period") == "dr1") & (F.col("snapshot_date") == _d(l1[1])))
                | ((F.col("date_period") == "dr2") & (F.col("snapshot_date") == _d(l2[1]))))
    return f.groupBy("date_period", *keys).agg(
        F.sum(F.col("total_available") * w).alias("__wa"),
        F.sum(F.col("total_scrapes") * w).alias("__ws"),
        F.sum("total_available").cast("double").alias("tot_ls"),
        F.sum("impact_scrore_for_psl_tags_pf").alias("__imp"),
        F.sum("impact_scrore_for_psl_tags_pf").cast("double").alias("total_mtd_impact_pf"),
        F.sum(F.when(last_day, F.col("total_listed"))).cast("bigint").alias("total_listed"))


def pareto_tags(spm: DataFrame, part: Sequence[str] = PARETO_PART,
                tie: Sequence[str] = ("product_id", "store_id", "locality", "title"),
                buckets: int = 32) -> DataFrame:
    """Rank SKU x store by impact inside period x platform x city x category,
    cumulative share of impact, Pareto tag (E5-E7).

    A city x category can hold very many store x SKU rows, so rank and running
    share come from the bucketed, parallel form (``ranked_running_share``)
    rather than one sorted window per partition; the result is identical.
    ``contribution_weight_pf`` is reported rounded to 3 decimals; the tag is
    decided on the unrounded share.
    """
    d = ranked_running_share(spm, part, "total_mtd_impact_pf", "__imp", tie, buckets,
                             rank_out="sku_rank_pf", cum_out="__cum")
    return (d.withColumn("psl_tags_pf", pareto_tag("__cum", "sku_rank_pf", "total_mtd_impact_pf"))
            .withColumn("contribution_weight_pf", F.round("__cum", 3)).drop("__cum"))


def sku_store_osa(loc: DataFrame, l1, l2, keys: Sequence[str] = STORE_KEYS,
                  once: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Store x SKU rows (both periods) whose weighted OSA fell from L2 to L1.

    Each row carries its Pareto tag, the last-day listing and the OSA of both
    periods with the difference.  OSA pairs are matched on all store x SKU keys
    (X14); ``osa_diff < 0`` keeps only falling pairs (C9: the left join with a
    filter on its right side is an inner join).

    ``once`` may write the aggregate and read it back: cut points, bucket totals and rows
    of the running share then start from it and the facts are scanned once.
    """
    spm = store_period_metrics(loc, l1, l2, keys)
    spm = once(spm) if once else spm
    osa = safe_div(100.0 * F.col("__wa").cast("double"), F.col("__ws").cast("double"))
    t = pareto_tags(spm.withColumn("__osa", osa))
    wk = Window.partitionBy(*keys)
    o1 = F.max(F.when(F.col("date_period") == "dr1", F.col("__osa"))).over(wk)
    o2 = F.max(F.when(F.col("date_period") == "dr2", F.col("__osa"))).over(wk)
    h1 = F.max(F.when(F.col("date_period") == "dr1", 1)).over(wk)
    h2 = F.max(F.when(F.col("date_period") == "dr2", 1)).over(wk)
    d = (t.withColumn("wt_osa_dr2", F.round(o2, 1)).withColumn("wt_osa_dr1", F.round(o1, 1))
         .withColumn("osa_diff", F.round(o1 - o2, 1))
         .withColumn("__pair", (h1 == 1) & (h2 == 1)))
    return (d.where(F.col("__pair") & (F.col("osa_diff") < 0))
            .drop("__pair", "__wa", "__ws", "__osa", "__imp"))


def psl_by_store(sku_osa: DataFrame, psl: DataFrame, own_ids: DataFrame, l1,
                 keys: Sequence[str] = ("account", "gc_platform", "product_id", "store_id")) -> DataFrame:
    """Attach potential sales loss of L1 to each current (``dr1``) store x SKU row, 0 when
    none (H11).  The ``dr2`` row of a pair carries no loss of its own and is left out, so
    every loss counts once.

    Own products through a semi join (C3), never an id tuple in the query text.
    """
    p = (psl.where(F.col("gc_crawl_date").between(_d(l1[0]), _d(l1[1]))
                   & F.col("store_id").isNotNull())
         .join(own_ids.where(F.col("is_own_brand") == 1).select("product_id").distinct(),
               "product_id", "left_semi")
         .withColumn("gc_platform", F.lower("gc_platform"))
         .groupBy(*keys).agg(F.sum("potential_sales_loss_mrp").cast("double").alias("psl_mrp")))
    return sku_osa.where(F.col("date_period") == "dr1").join(p, list(keys), "left").na.fill({"psl_mrp": 0.0})


def psl_by(psl_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSL sums by any grain (D22), summed exactly as DECIMAL."""
    return psl_rows.groupBy(*keys).agg(
        F.sum(F.col("psl_mrp").cast("decimal(38,2)")).cast("double").alias("psl_mrp"))


def sku_store_counts(psl_rows: DataFrame, drop_city: str = "Others", drop_tag: str = "medium",
                     keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city",
                                            "product_id", "title")) -> DataFrame:
    """Stores with high loss and listings per SKU (D23): both filters applied."""
    d = psl_rows.where(~F.col("gc_city").eqNullSafe(drop_city)
                       & ~F.col("psl_tags_pf").eqNullSafe(drop_tag))
    return d.groupBy(*keys).agg(F.count_distinct("locality").cast("bigint").alias("high_psl_stores"),
                                F.sum("total_listed").cast("bigint").alias("listed_in"))


def new_stores(catalog: DataFrame, start, end) -> DataFrame:
    """Stores first seen in ``[start, end]`` (D10: GROUP BY + HAVING min)."""
    return (catalog.groupBy("account", F.lower("gc_platform").alias("gc_platform"), "store_id",
                            F.lower(F.trim("gc_city")).alias("gc_city_fin"))
            .agg(F.min("gc_crawl_date").alias("store_first_seen"))
            .where(F.col("store_first_seen").between(_d(start), _d(end))))


def listed_stores(loc: DataFrame, day) -> DataFrame:
    """Stores listing an own product on ``day``, else on the day before (B6, per account)."""
    cand = loc.where((F.col("is_own_brand") == 1) & (F.col("total_listed") == 1)
                     & F.col("snapshot_date").isin(_d(day), F.date_sub(_d(day), 1)))
    pick = cand.groupBy("account").agg(F.max("snapshot_date").alias("__d"))
    return (cand.join(pick, (cand["account"] == pick["account"]) & (cand["snapshot_date"] == pick["__d"]),
                      "left_semi")
            .select("account", F.lower("gc_platform").alias("gc_platform"), "store_id").distinct())


def new_store_coverage(catalog: DataFrame, loc: DataFrame, l1, l2) -> DataFrame:
    """Per platform: new stores since L2 start and how many of them list own SKUs."""
    ns = new_stores(catalog, l2[0], l1[1])
    yours = listed_stores(loc, l1[1]).withColumn("__yours", F.lit(1))
    j = ns.join(yours, ["account", "gc_platform", "store_id"], "left")
    return j.groupBy("account", "gc_platform").agg(
        F.count_distinct("store_id").cast("bigint").alias("new_stores"),
        F.count_distinct(F.when(F.col("__yours") == 1, F.col("store_id"))).cast("bigint")
         .alias("listed_in_new_stores"))


def inventory_days(doi: DataFrame, wanted: DataFrame, l1,
                   keys: Sequence[str] = ("account", "gc_platform", "gc_city", "bgr", "product_id")) -> DataFrame:
    """Average back-end and front-end days of inventory over L1 for the wanted
    (platform, city, category, product) rows (D21): one semi join, not a query per row."""
    d = (doi.where(F.col("snapshot_date").between(_d(l1[0]), _d(l1[1])))
         .withColumn("bgr", F.lower("bgr"))
         .join(wanted.select(*keys).distinct(), list(keys), "left_semi"))
    return d.groupBy(*keys).agg(F.round(F.avg("backend_doi_value"), 0).alias("backend_doi"),
                                F.round(F.avg("frontend_doi_value"), 0).alias("frontend_doi"))


REACH_GRAINS = {"platform": (), "city": ("gc_city",), "category": ("bgr",), "sku": ("product_id",)}


def store_reach(facts: DataFrame, l1, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stores that scraped, listed and stocked at four grains of account and platform.

    The facts of L1 are reduced once to bitmaps of city x category x SKU; the grains are merges
    of those (``once`` writes them).  Columns a grain does not have are NULL; NULL keys are
    groups like any other, rows without a store count as no store.
    """
    base = ["account", "gc_platform"]
    fine = [*base, "gc_city", "bgr", "product_id"]
    rows = facts.where(F.col("snapshot_date").between(_d(l1[0]), _d(l1[1])))
    counted = {"stores": F.lit(True), "listing_stores": F.coalesce(F.col("total_listed") > 0, F.lit(False)),
               "stocking_stores": F.coalesce(F.col("total_available") > 0, F.lit(False))}
    maps = once(bitmaps(rows, fine, "store_id", dense_numbers(rows, "store_id", once), counted))
    parts = []
    for name, keys in REACH_GRAINS.items():
        got = merged_counts(maps, [*base, *keys], list(counted))
        parts.append(got.select(F.lit(name).alias("grain"), *base, *[
            F.col(c) if c in keys else F.lit(None).cast(maps.schema[c].dataType).alias(c) for c in fine[2:]], *counted))
    return reduce(DataFrame.unionAll, parts)
