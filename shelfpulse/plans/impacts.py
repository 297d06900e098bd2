"""Share impact at four key grains from one aggregate of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import safe_div
from shelfpulse.operators.periods import filter_periods_capped, period_label

BASE = ("account", "gc_platform", "bgr")
GRAINS = {"category": (), "brand": ("brand",), "city": ("gc_city",), "city_brand": ("gc_city", "brand")}


def impact_value(points: Column, size: Column) -> Column:
    """Share points of a size, in DECIMAL so that sums of impacts do not depend on order."""
    return (points.cast("decimal(12,6)") * size.cast("decimal(24,4)")
            * F.lit(0.01).cast("decimal(3,2)")).cast("double")


def share_impact_grains(facts: DataFrame, dim: DataFrame, l1, l2, own: int = 1) -> DataFrame:
    """Share change and sales impact of the ``own`` side by category, brand, city and both.

    The facts are scanned and aggregated once, to category x city x brand with one sum per
    period; the coarser grains are grouping sets over that small aggregate.  The size of a
    grain is the normalised offtake of all brands, so the rows of a category (x city) give
    the size of its brands through a window over the aggregate.  A grain's row needs sales
    rows of the side in both periods (inner match); each grain has unique keys.  Keys that
    a grain does not have are NULL; a NULL key of the data is a key like any other.
    An empty size gives a share of 0.
    """
    d = dim.select("product_id", F.lower("bgr").alias("__bgr")).dropDuplicates(["product_id"])
    f = (filter_periods_capped(facts, "snapshot_date", l1, l2).join(d, "product_id", "left")
         .select("account", F.lower("gc_platform").alias("gc_platform"), F.col("__bgr").alias("bgr"), "gc_city",
                 "brand", "is_own_brand", "reported_offtake_mrp", "normalized_offtake",
                 period_label("snapshot_date", l1, l2, "dr1").alias("__p")))
    side = F.col("is_own_brand") == own
    sold = F.col("reported_offtake_mrp" if own == 1 else "normalized_offtake")
    sums = []
    for p in ("dr1", "dr2"):
        here = F.col("__p") == p
        sums += [F.sum(F.when(here & side, sold)).alias(f"__sales_{p}"),
                 F.sum(F.when(here & side, F.col("normalized_offtake"))).alias(f"__part_{p}"),
                 F.sum(F.when(here, F.col("normalized_offtake"))).alias(f"__all_{p}"),
                 F.count(F.when(here & side, 1)).alias(f"__rows_{p}")]
    names = [f"__{n}_{p}" for p in ("dr1", "dr2") for n in ("sales", "part", "all", "rows")]
    keys = [*BASE, "gc_city", "brand"]
    fine = f.groupBy(*keys).agg(*sums)
    g = (fine.groupingSets([[F.col(c) for c in (*BASE, *extra)] for extra in GRAINS.values()], *keys)
         .agg(F.grouping("gc_city").alias("__no_city"), F.grouping("brand").alias("__no_brand"),
              *[F.sum(n).alias(n) for n in names]))
    w = Window.partitionBy("__no_city", *BASE, "gc_city")
    for p in ("dr1", "dr2"):
        size = F.max(F.when(F.col("__no_brand") == 1, F.col(f"__all_{p}"))).over(w).cast("double")
        g = g.withColumn(f"size_{p}", size)
    g = g.where((F.col("__rows_dr1") > 0) & (F.col("__rows_dr2") > 0))
    for p in ("dr1", "dr2"):
        percent = F.round(safe_div(100 * F.col(f"__part_{p}").cast("double"), F.col(f"size_{p}")), 1)
        g = (g.withColumn(f"share_{p}", F.when(F.col(f"size_{p}") == 0, F.lit(0.0)).otherwise(percent))
             .withColumn(f"actual_sales_{p}", F.col(f"__sales_{p}").cast("double")))
    grain = F.coalesce(*[F.when((F.col("__no_city") == int("gc_city" not in extra))
                                & (F.col("__no_brand") == int("brand" not in extra)), F.lit(name))
                         for name, extra in GRAINS.items()])
    points = F.col("share_dr1") - F.col("share_dr2")
    return g.select(grain.alias("grain"), *keys, "size_dr1", "share_dr1", "actual_sales_dr1", "size_dr2",
                    "share_dr2", "actual_sales_dr2", points.alias("pct_change"),
                    impact_value(points, F.col("size_dr1")).alias("sales_impact"))
