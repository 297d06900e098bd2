"""Drill-down from losing / gaining categories to cities, competitors and SKUs (H9).

The reference walks the driver rows in Python loops with a filter per row.
Here every step is a join of the driver set to the candidate set followed by a
``row_number`` top-k inside each driver key, so all drivers of all accounts
are processed in one distributed plan:

    category drivers (F2) -> driver cities (F3) -> own brand row with tier and
    metric changes (C18) -> rising competitors (F5, fallback ladder) -> SKUs (F5)

Fallback ladder for competitors (one ladder for both directions, X6): level 1
same city and same price tier; level 2 same city, any tier; level 3 the best
two per platform x category.  The reference takes the next level only when the
whole competitor set of the report is empty, so the lowest level that has rows
is kept per account.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.operators.aggregates import impact_split
from shelfpulse.operators.periods import share_impact
from shelfpulse.operators.topk import SKEW_SALT, top_k

CITY = ["account", "gc_platform", "bgr", "gc_city", "brand"]
CAT = ["account", "gc_platform", "bgr", "brand"]
CUTS = {"down": (-100000.0, -10000.0), "up": (50000.0, 10000.0)}
DROP_CITY = "Others"


def city_impacts(ms: DataFrame, own: int = 1, drop_city: str | None = DROP_CITY) -> DataFrame:
    """Share impact at city x brand grain for own (1) or competitor (0) brands (H3).

    The catch-all city bucket is dropped; a NULL city is kept (N6).
    """
    imp = share_impact(ms.where(F.col("is_own_brand") == own), CITY)
    if drop_city is not None:
        imp = imp.where(~F.col("gc_city").eqNullSafe(drop_city))
    return imp.withColumn("is_own_brand", F.lit(own))


def category_drivers(city_imp: DataFrame, cat_imp: DataFrame, direction: str = "down",
                     cut: float | None = None, k: int = 2) -> DataFrame:
    """Worst (``down``) or best (``up``) categories per account x platform (D13 + F2).

    Sales impact of a category = sum of its negative (positive) city impacts;
    the category-level share columns are attached from ``cat_imp``.
    """
    cut = CUTS[direction][0] if cut is None else cut
    split = impact_split(city_imp, [*CAT, "is_own_brand"])
    side = "impact_loss" if direction == "down" else "impact_gain"
    d = split.where(F.col(side).isNotNull()).select(*CAT, "is_own_brand",
                                                    F.col(side).alias("sales_impact"))
    d = d.join(cat_imp.drop("sales_impact", "is_own_brand"), CAT, "left")
    if direction == "down":
        order = [F.col("sales_impact").asc_nulls_last()]
        pred = F.col("sales_impact") < cut
    else:
        order = [F.col("sales_impact").desc_nulls_last()]
        pred = F.col("sales_impact") > cut
    order += [F.col("bgr").asc_nulls_last(), F.col("brand").asc_nulls_last()]
    return top_k(d, ["account", "gc_platform"], order, k, pred)


def driver_cities(drivers: DataFrame, city_imp: DataFrame, direction: str = "down",
                  cut: float | None = None, k: int = 3) -> DataFrame:
    """Cities of each driver category beyond the city cut, worst (best) first."""
    cut = CUTS[direction][1] if cut is None else cut
    pred = F.col("sales_impact") < cut if direction == "down" else F.col("sales_impact") > cut
    d = city_imp.where(pred).join(drivers.select(*CAT).distinct(), CAT, "left_semi")
    first = (F.col("sales_impact").asc_nulls_last() if direction == "down"
             else F.col("sales_impact").desc_nulls_last())
    return top_k(d, CAT, [first, F.col("gc_city").asc_nulls_last()], k, rank_col="city_rank")


def driver_brand_rows(cities: DataFrame, tiers: DataFrame, metrics_change: DataFrame | None) -> DataFrame:
    """Own brand row in the top city of each driver with its price tier and
    metric changes (the reference's ``city_df_brand``)."""
    top = cities.where(F.col("city_rank") == 1).drop("city_rank")
    t = tiers.select(*CAT, "ppu_category", "wt_ppu")
    out = top.join(t, CAT, "left")
    if metrics_change is not None:
        out = out.join(metrics_change, [*CITY, "is_own_brand"], "left")
    return out


def rising_competitors(brand_rows: DataFrame, comp_imp: DataFrame, tiers: DataFrame,
                       k: int = 2) -> DataFrame:
    """Competitors gaining share next to each driver (F5) with the fallback ladder."""
    t = tiers.select(*CAT, "ppu_category")
    comp = comp_imp.where(F.col("pct_change") > 0).join(t, CAT, "left")
    order = [F.col("pct_change").desc_nulls_last(), F.col("brand").asc_nulls_last()]
    where = ["account", "gc_platform", "bgr", "gc_city"]
    drv = brand_rows.select(*where, "ppu_category").distinct()
    # own brands of different tiers in one city have k competitors each
    l1 = top_k(comp.join(drv, [*where, "ppu_category"], "left_semi"), [*where, "ppu_category"], order, k,
               rank_col="comp_rank").withColumn("level", F.lit(1))
    l2 = top_k(comp.join(drv.select(*where).distinct(), where, "left_semi"), where, order, k,
               rank_col="comp_rank").withColumn("level", F.lit(2))
    l3 = top_k(comp, ["account", "gc_platform", "bgr"], order, k,
               rank_col="comp_rank").withColumn("level", F.lit(3))
    allv = l1.unionByName(l2).unionByName(l3)
    w = Window.partitionBy("account")
    return (allv.withColumn("__min", F.min("level").over(w))
            .where(F.col("level") == F.col("__min")).drop("__min"))


def driver_skus(rows: DataFrame, sku_cmp: DataFrame, direction: str = "down",
                keys: Sequence[str] = CITY) -> DataFrame:
    """SKU of each driver row with the lowest (``down``) / highest (``up``) share change."""
    d = sku_cmp.join(rows.select(*keys).distinct(), list(keys), "left_semi")
    first = (F.col("change_market_share").asc_nulls_last() if direction == "down"
             else F.col("change_market_share").desc_nulls_last())
    return top_k(d, keys, [first, F.col("product_id").asc_nulls_last()], 1, rank_col=None,
                 salt=SKEW_SALT)


class LazyFrames(dict):
    """Mapping whose frames are built on first access (plan construction in
    PySpark analyses every step, so frames a caller never reads are never built)."""

    def __init__(self, builders: dict, wrap=None):
        super().__init__()
        self._builders = builders
        self._wrap = wrap

    def __missing__(self, key):
        value = self._builders[key](self)
        if self._wrap is not None:
            value = self._wrap(key, value)
        self[key] = value
        return value


def drilldown(ms, cat_ms, tiers, metrics_change, sku_cmp, direction: str = "down",
              wrap=None) -> LazyFrames:
    """All drill-down frames of one direction, built lazily on access.

    Inputs may be DataFrames or zero-argument callables returning them;
    ``wrap(name, frame)`` may materialise each frame once it is built.
    """
    def get(x):
        return x() if callable(x) else x
    return LazyFrames({
        "own": lambda f: city_impacts(get(ms), 1),
        "comp": lambda f: city_impacts(get(ms), 0),
        "cat_imp": lambda f: share_impact(get(cat_ms).where(F.col("is_own_brand") == 1), CAT),
        "drivers": lambda f: category_drivers(f["own"], f["cat_imp"], direction),
        "cities": lambda f: driver_cities(f["drivers"], f["own"], direction),
        "brand_rows": lambda f: driver_brand_rows(f["cities"], get(tiers), get(metrics_change)),
        "competitors": lambda f: rising_competitors(f["brand_rows"], f["comp"], get(tiers)),
        "own_sku": lambda f: driver_skus(f["brand_rows"], get(sku_cmp), direction),
        "comp_sku": lambda f: driver_skus(f["competitors"], get(sku_cmp), "up"),
    }, wrap)
