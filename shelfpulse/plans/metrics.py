"""Composed metric operators H1, H2, H4, H5, H6, H8 (market share, availability,
discount, share of voice, SKU metrics, grammage).

Each operator scans the fact table once: where the reference runs several CTEs
over the same table and joins them back (``bgr_prices``, ``month_bgr_imps``,
``wt_aggregated``), we compute one ``groupBy`` with conditional sums and take
coarser totals with a window over that aggregate (SURVEY 4, "scan fusion").
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import null_greatest, row_weight, safe_div
from shelfpulse.operators.windows import with_group_totals
from shelfpulse.operators.periods import (compare_periods, filter_periods,
                                          filter_periods_capped, period_label)

GEO = ("gc_platform", "bgr", "gc_city", "brand")


def _ratio_pct(num, den, scale=1):
    return F.round(safe_div(100.0 * F.col(num).cast("double"), F.col(den).cast("double")), scale)


def brand_flags(facts: DataFrame, keys=("account", "gc_platform", "brand")) -> DataFrame:
    """Distinct (platform, brand, own flag) lookup.

    A brand carrying two flags yields two rows, so a join to it fans out exactly
    like the reference's ``select distinct`` join.
    """
    return facts.select(*keys, "is_own_brand").distinct()


def market_share(facts: DataFrame, dim: DataFrame, l1, l2,
                 keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city", "brand"),
                 part_keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city")) -> DataFrame:
    """Market share by period x platform x category x city x brand (H1, live branch).

    * facts left-joined to the product dimension for the category (C1);
    * both windows capped at the data freshness date (B4), label L1 first (B1);
    * ``actual_sum`` = own brand's reported offtake, competitors' normalised one;
    * ``category_size`` = normalised offtake of the partition;
    * ``market_share`` = ``ROUND(100 * own / size, 1)``, 0 for an empty category;
    * ``is_own_brand`` from the distinct (platform, brand, flag) rows of the
      filtered facts (C6).
    """
    d = (dim.select("product_id", F.lower("bgr").alias("__dim_bgr"))
         .dropDuplicates(["product_id"]))
    f = filter_periods_capped(facts, "snapshot_date", l1, l2)
    f = (f.join(d, "product_id", "left")
         .withColumn("date_period", period_label("snapshot_date", l1, l2, "dr1"))
         .withColumn("gc_platform", F.lower("gc_platform"))
         .withColumn("bgr", F.col("__dim_bgr"))
         .where(F.col("date_period").isNotNull()))
    f = f.select("date_period", *keys, "is_own_brand", "reported_offtake_mrp",
                 "normalized_offtake")
    gkeys = ["date_period", *keys]
    # one aggregate; the per-group set of own flags (at most {0, 1, NULL}) gives
    # the distinct (platform, brand, flag) lookup without a second fact scan
    agg = f.groupBy(*gkeys).agg(
        F.sum(F.when(F.col("is_own_brand") == 1, F.col("reported_offtake_mrp"))
              .otherwise(F.col("normalized_offtake"))).cast("double").alias("actual_sum"),
        F.sum("normalized_offtake").alias("__n"),
        *flag_parts())
    w = Window.partitionBy("date_period", *part_keys)
    size = F.sum("__n").over(w)
    agg = (agg.withColumn("category_size", size.cast("double"))
           .withColumn("market_share",
                       F.when(F.col("category_size") == 0, F.lit(0.0))
                       .otherwise(F.round(safe_div(100 * F.col("__n").cast("double"),
                                                   F.col("category_size")), 1)))
           .drop("__n"))
    return attach_flags(agg, [k for k in keys if k in ("account", "gc_platform", "brand")])


def flag_parts(col: str = "is_own_brand") -> list:
    """Per-group presence of each own-flag value (0, 1, NULL): three bounded ints."""
    c = F.col(col)
    return [F.max(F.when(c == 0, 1).otherwise(0)).alias("__f0"),
            F.max(F.when(c == 1, 1).otherwise(0)).alias("__f1"),
            F.max(F.when(c.isNull(), 1).otherwise(0)).alias("__fn")]


def attach_flags(agg: DataFrame, flag_keys: Sequence[str]) -> DataFrame:
    """Own flag per (platform, brand) from the per-group flag presence, as a
    window over the aggregate (C6 without a second pass over the facts).

    A brand carrying two flags yields two rows, exactly like a left join to
    the distinct (platform, brand, flag) rows.  The window only takes three
    maxima per key, so a brand present in very many groups costs O(rows).
    """
    w = Window.partitionBy(*flag_keys)
    present = F.array(F.when(F.max("__f0").over(w) == 1, F.lit(0)),
                      F.when(F.max("__f1").over(w) == 1, F.lit(1)),
                      F.when(F.max("__fn").over(w) == 1, F.lit(-1)))
    out = agg.withColumn("__allf", F.filter(present, lambda x: x.isNotNull()))
    out = out.drop("__f0", "__f1", "__fn").withColumn("__f", F.explode_outer("__allf")).drop("__allf")
    return out.withColumn("is_own_brand", F.when(F.col("__f") == -1, F.lit(None).cast("int"))
                          .otherwise(F.col("__f").cast("int"))).drop("__f")


def market_share_category(facts: DataFrame, l1, l2,
                          keys: Sequence[str] = ("account", "gc_platform", "bgr", "brand",
                                                 "is_own_brand"),
                          part_keys: Sequence[str] = ("account", "gc_platform", "bgr")) -> DataFrame:
    """Market share without city (H2): L2 tested first (B2), own flag in the key."""
    f = filter_periods_capped(facts, "snapshot_date", l1, l2,
                              extra=F.col("is_own_brand").isin(0, 1))
    f = f.withColumn("date_period", period_label("snapshot_date", l1, l2, "dr2"))
    agg = f.groupBy("date_period", *keys).agg(
        F.sum(F.when(F.col("is_own_brand") == 1, F.col("reported_offtake_mrp"))
              .otherwise(F.col("normalized_offtake"))).cast("double").alias("actual_sum"),
        F.sum("normalized_offtake").alias("__n"))
    w = Window.partitionBy("date_period", *part_keys)
    agg = (agg.withColumn("category_size", F.sum("__n").over(w).cast("double"))
           .withColumn("market_share",
                       F.when(F.col("category_size") == 0, F.lit(0.0))
                       .otherwise(F.round(safe_div(100 * F.col("__n").cast("double"),
                                                   F.col("category_size")), 1)))
           .drop("__n"))
    return (agg.withColumn("gc_platform", F.lower("gc_platform"))
            .withColumn("bgr", F.lower("bgr")))


def brand_metrics(facts: DataFrame, dim: DataFrame, l1, l2,
                  keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city", "brand"),
                  total_keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city")) -> DataFrame:
    """Weighted OSA, OSA in listed stores, weighted discount and three SOVs (H4).

    One scan of the facts in both windows (B3, label B1), one aggregate with
    conditional sums:

    * availability sums only over products that are not platform bundles (C2,
      a left join to the distinct valid ids gives a flag, then sums are
      conditional on it); a group exists only when it has such products;
    * discount sums only over ``asp_flag = 1`` rows (X1 parenthesised);
    * impressions over all rows; category totals by a window over the
      aggregate (C4 without a second scan);
    * the own flag of a (platform, brand) comes from its rows inside the two
      windows (the reference reads it from the whole table; the two differ
      only for a brand whose flag changed outside the windows).
    """
    valid = (dim.where(F.col("is_platform_bundle").isNull()).select("product_id").distinct()
             .withColumn("__valid", F.lit(1)))
    f = filter_periods(facts, "snapshot_date", l1, l2)
    f = (f.join(valid, "product_id", "left")
         .withColumn("date_period", period_label("snapshot_date", l1, l2, "dr1"))
         .withColumn("bgr", F.lower("bgr")))
    w = row_weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
    qty_w = null_greatest("estimated_qty_sold", F.lit(1))
    is_valid = F.col("__valid") == 1
    asp = F.col("asp_flag") == 1
    g = f.groupBy(*keys[:1], *keys[1:2], "date_period", *keys[2:]).agg(
        F.max(F.when(is_valid, 1)).alias("__has_valid"),
        F.sum(F.when(is_valid, F.col("total_available") * w)).alias("total_wt_available"),
        F.sum(F.when(is_valid, F.col("total_listed") * w)).alias("total_wt_listed"),
        F.sum(F.when(is_valid, F.col("total_scrapes") * w)).alias("total_wt_scrapes"),
        F.sum(F.when(asp, F.col("mrp") * qty_w)).alias("wt_mrp"),
        F.sum(F.when(asp, F.col("price") * qty_w)).alias("wt_price"),
        F.sum("total_impressions").alias("__ti"),
        F.sum("ad_impressions").alias("__ai"),
        *flag_parts(),
    )
    wt = Window.partitionBy("date_period", *total_keys)
    ti = F.round(F.col("__ti"), 0)
    ai = F.round(F.col("__ai"), 0)
    oi = F.round(F.col("__ti") - F.col("__ai"), 0)
    mti = F.round(F.sum("__ti").over(wt), 0)
    mai = F.round(F.sum("__ai").over(wt), 0)
    moi = F.round(F.sum("__ti").over(wt) - F.sum("__ai").over(wt), 0)

    def sov(a, b):
        return F.coalesce(F.round(safe_div(a.cast("double"), b.cast("double")), 3) * 100.0,
                          F.lit(0.0))

    g = (g.withColumn("sov", sov(ti, mti))
         .withColumn("ad_sov", sov(ai, mai))
         .withColumn("organic_sov", sov(oi, moi)))
    out = attach_flags(g, [k for k in keys if k in ("account", "gc_platform", "brand")])
    out = out.where(F.col("__has_valid") == 1)
    lowered = {"gc_platform", "bgr"}
    return out.select(
        *[F.lower(k).alias(k) if k in lowered else F.col(k) for k in keys],
        "date_period", "is_own_brand",
        _ratio_pct("total_wt_available", "total_wt_scrapes").alias("wt_osa"),
        _ratio_pct("total_wt_available", "total_wt_listed").alias("wt_osa_in_ls"),
        F.round(safe_div(100.0 * (F.col("wt_mrp") - F.col("wt_price")).cast("double"),
                         F.col("wt_mrp").cast("double")), 1).alias("wt_discounting"),
        "sov", "ad_sov", "organic_sov")


BRAND_METRIC_COLS = ("wt_osa", "wt_osa_in_ls", "wt_discounting", "sov", "ad_sov", "organic_sov")
BRAND_CHANGE_NAMES = {"organic_sov": "ogsov", "ad_sov": "adsov", "wt_osa_in_ls": "wt_osa_listing"}


def brand_metrics_change(metrics: DataFrame,
                         keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city",
                                                "brand", "is_own_brand")) -> DataFrame:
    """``dr1`` metrics with unrounded changes against ``dr2``."""
    return compare_periods(metrics, keys, BRAND_METRIC_COLS, rounded=False,
                           names=BRAND_CHANGE_NAMES)


def category_metrics(facts: DataFrame, dim: DataFrame, l1, l2) -> DataFrame:
    """H4 without city, with the category share compare attached (H5).

    Category share: H2 compared on (platform, category, brand) with pandas
    rounding, left-joined onto the metric changes.
    """
    keys = ("account", "gc_platform", "bgr", "brand")
    m = brand_metrics(facts, dim, l1, l2, keys=keys, total_keys=("account", "gc_platform", "bgr"))
    ch = brand_metrics_change(m, keys=(*keys, "is_own_brand"))
    cms = market_share_category(facts, l1, l2)
    share = compare_periods(cms, keys, ["market_share"])
    return ch.join(share, list(keys), "left")


def grammage(facts: DataFrame, dim: DataFrame, l1, l2) -> DataFrame:
    """Mean pack size per SKU over both capped windows.

    L1 is capped at the upload date and L2 a month before it (B4); the
    category and pack size come from the product dimension (left join, C1).
    """
    d = dim.select("product_id", F.lower("bgr").alias("__bgr"), F.col("grammage").alias("__g"))
    f = filter_periods_capped(facts, "snapshot_date", l1, l2).join(d, "product_id", "left")
    return (f.groupBy("account", F.lower("gc_platform").alias("gc_platform"),
                      F.col("__bgr").alias("bgr"), "brand", "product_id")
            .agg(F.avg("__g").alias("grammage")))


def product_metrics(facts: DataFrame, mapping: DataFrame | None, l1, l2,
                    keys: Sequence[str] = ("account", "gc_platform", "product_id", "title",
                                           "grammage", "bgr", "gc_city", "brand"),
                    part_keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city"),
                    once: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """SKU x city x period metrics (H6): offtake, prices, units, listing, OSA,
    discount, shares of sales and impressions within the category, weighted PPU.

    * windows capped (B4), label L2 first (B2), own flag in (0, 1) for both
      windows (X1 parenthesised);
    * ``mapping`` (optional) adds ``item_id`` through a left join filtered to
      ``type = 'single'`` on the same platform (C7);
    * one window spec over the aggregate for the four shares (E3); the
      reference partitions by category, city and period inside one platform
      table -- with all platforms in one table the platform joins the partition;
    * listing rate ``100 * listed / scrapes`` with ``try_divide`` (X24).

    ``once`` may write the aggregate and read it back: rows and category totals
    then start from it and the facts are scanned once.
    """
    f = filter_periods_capped(facts, "snapshot_date", l1, l2,
                              extra=F.col("is_own_brand").isin(0, 1))
    f = (f.withColumn("date_period", period_label("snapshot_date", l1, l2, "dr2"))
         .withColumn("bgr", F.lower("bgr"))
         .withColumn("grammage", F.col("original_grammage")))
    if mapping is not None:
        mp = (mapping.where(F.col("type") == "single")
              .select(F.col("product_id").alias("__mid"), F.col("gc_platform").alias("__mp"), "item_id"))
        f = f.join(mp, (F.col("product_id") == F.col("__mid")) & (F.col("gc_platform") == F.col("__mp")),
                   "left").drop("__mid", "__mp")
        keys = (*keys, "item_id")
    w = row_weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
    qty_w = null_greatest("estimated_qty_sold", F.lit(1))
    ppu_w = null_greatest("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")
    asp = F.col("asp_flag") == 1
    ppu = F.col("ppu_flag") == 1
    # nearly every row of a scan task is a group of its own, and the scan's tasks grow with the
    # files: the first sums are made over partitions of bounded size; the date among the columns
    # spreads a crowded SKU, and leaves the totals an exchange of their own
    f = f.hint("rebalance", "product_id", "snapshot_date")
    g = f.groupBy(*keys, "date_period").agg(
        F.sum("reported_offtake_mrp").cast("double").alias("offtake_mrp"),
        F.sum("reported_offtake_sp").cast("double").alias("offtake_sp"),
        F.avg(F.when(asp, F.col("price"))).cast("double").alias("sp"),
        F.avg(F.when(asp, F.col("mrp"))).cast("double").alias("mrp"),
        F.sum("reported_offtake_qty").cast("double").alias("units"),
        F.sum("total_listed").alias("__listed"),
        F.sum("total_scrapes").alias("__scrapes"),
        F.sum(F.col("total_available") * w).alias("__wa"),
        F.sum(F.col("total_scrapes") * w).alias("__ws"),
        F.sum(F.col("total_listed") * w).alias("__wl"),
        F.sum(F.when(asp, F.col("mrp") * qty_w)).alias("__wmrp"),
        F.sum(F.when(asp, F.col("price") * qty_w)).alias("__wprice"),
        F.sum("normalized_offtake").alias("__no"),
        F.sum("total_impressions").alias("__ti"),
        F.sum("organic_impressions").alias("__oi"),
        F.sum("ad_impressions").alias("__ai"),
        F.sum(F.when(ppu, F.col("price_per_100_units") * ppu_w)).alias("__ppu_num"),
        F.sum(F.when(ppu, ppu_w)).alias("__ppu_den"),
    )
    g = once(g) if once else g
    # category x city totals of four measures: group totals joined back (SKUs
    # per category x city grow with the data, so no single-task window partition)
    g = with_group_totals(g, [*part_keys, "date_period"], ["__no", "__ti", "__oi", "__ai"])

    def dbl(c):
        return F.col(c).cast("double")

    def tot(c):
        return F.col(f"__tot_{c}").cast("double")

    def share(c):
        return F.try_divide(dbl(c), tot(c)) * 100.0

    return g.select(
        *keys, "date_period", "offtake_mrp", "offtake_sp", "sp", "mrp", "units",
        F.try_divide(100 * dbl("__listed"), dbl("__scrapes")).alias("ds_listing"),
        F.try_divide(dbl("__wa") * 100.0, dbl("__ws")).alias("wt_osa"),
        F.try_divide(dbl("__wa") * 100.0, dbl("__wl")).alias("wt_osa_in_ls"),
        F.try_divide((dbl("__wmrp") - dbl("__wprice")) * 100.0, dbl("__wmrp")).alias("wt_discounting"),
        share("__no").alias("market_share"),
        F.try_divide(dbl("__ti") * 100.0, tot("__ti")).alias("sov"),
        F.try_divide(dbl("__oi") * 100.0, tot("__oi")).alias("organic_sov"),
        F.try_divide(dbl("__ai") * 100.0, tot("__ai")).alias("ad_sov"),
        F.try_divide(dbl("__ppu_num"), dbl("__ppu_den")).alias("wt_ppu"),
    )


SKU_METRICS = ("ds_listing", "wt_osa", "wt_osa_in_ls", "wt_discounting", "sov", "ad_sov",
               "organic_sov", "market_share")


def sku_compare(pm: DataFrame,
                keys: Sequence[str] = ("account", "gc_platform", "bgr", "gc_city", "brand",
                                       "product_id", "title")) -> DataFrame:
    """SKU x city period compare of H6 metrics (C11, pandas rounding)."""
    return compare_periods(pm, keys, SKU_METRICS)
