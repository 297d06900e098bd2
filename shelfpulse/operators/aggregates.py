"""Aggregation operators.

All are ``groupBy().agg()`` (partial aggregation before the shuffle, final
after) or windows over an aggregate; none collects a group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import null_greatest, row_weight, safe_div


def uploaded_till(facts: DataFrame, date_col: str = "snapshot_date",
                  keys: Sequence[str] = ("account",)) -> DataFrame:
    """Latest date per platform."""
    return (facts.groupBy(*keys, F.lower("gc_platform").alias("gc_platform"))
            .agg(F.max(date_col).alias("last_updated")))


def sum_by(df: DataFrame, keys: Sequence, cols: Sequence[str], to_double: bool = True) -> DataFrame:
    """Sum of ``cols`` by ``keys``."""
    aggs = [(F.sum(c).cast("double") if to_double else F.sum(c)).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def weighted_ratio(num: str, den: str, weight: Column, scale: int | None = 1) -> Column:
    """``100 * sum(num * w) / NULLIF(sum(den * w), 0)`` (D3)."""
    r = safe_div(100.0 * F.sum(F.col(num) * weight).cast("double"),
                 F.sum(F.col(den) * weight).cast("double"))
    return F.round(r, scale) if scale is not None else r


def osa_weight() -> Column:
    return row_weight("estimated_offtake_mrp_last_month", "estimated_offtake_mrp_current_month")


def weighted_discount(flag: str = "asp_flag", scale: int | None = 1) -> Column:
    """``100 * (sum w*mrp - sum w*price) / sum w*mrp`` on flagged rows, w = greatest(qty,1)."""
    w = null_greatest("estimated_qty_sold", F.lit(1))
    on = F.col(flag) == 1
    m = F.sum(F.when(on, F.col("mrp") * w))
    p = F.sum(F.when(on, F.col("price") * w))
    r = safe_div(100.0 * (m - p).cast("double"), m.cast("double"))
    return F.round(r, scale) if scale is not None else r


def weighted_price(value: str = "price_per_100_units", weight: Column | None = None,
                   flag: str = "ppu_flag", scale: int | None = 0) -> Column:
    """Weighted average of ``value`` over flagged rows."""
    w = weight if weight is not None else null_greatest("estimated_offtake_mrp", F.lit(1))
    on = F.col(flag) == 1
    r = safe_div(F.sum(F.when(on, F.col(value) * w).otherwise(0)).cast("double"),
                 F.sum(F.when(on, w).otherwise(0)).cast("double"))
    return F.round(r, scale) if scale is not None else r


def first_seen_between(df: DataFrame, keys: Sequence[str], date_col: str, start, end,
                       out: str = "first_seen") -> DataFrame:
    """Groups whose first date falls in ``[start, end]``: GROUP BY + HAVING min."""
    return (df.groupBy(*keys).agg(F.min(date_col).alias(out))
            .where(F.col(out).between(F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end))))))


def distinct_dims(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``SELECT DISTINCT``."""
    return df.select(*cols).distinct()


def impact_split(df: DataFrame, keys: Sequence[str], col: str = "sales_impact") -> DataFrame:
    """Sum of negative and of positive values per group in one pass.

    pandas drops NULL group keys (N4) and a group with no negative (positive)
    rows is absent from that side; here both sums come from one aggregate and
    are NULL when the side is empty.
    """
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    # summed as DECIMAL(38,7): a double sum depends on the order rows arrive in
    x = F.col(col).cast("decimal(38,7)")
    return d.groupBy(*keys).agg(
        F.sum(F.when(F.col(col) < 0, x)).cast("double").alias("impact_loss"),
        F.sum(F.when(F.col(col) > 0, x)).cast("double").alias("impact_gain"))


def pivot_periods(df: DataFrame, keys: Sequence[str], value: str, how: str = "avg",
                  periods: Sequence[str] = ("dr1", "dr2"), period_col: str = "date_period",
                  fill: float | None = None) -> DataFrame:
    """Period to columns with an explicit value list (D14 mean, D15 sum + fill).

    The explicit list keeps the pivot to one aggregate (no distinct-values job).
    pandas pivot_table drops NULL keys (N4).
    """
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    agg = F.avg(value) if how == "avg" else F.sum(value)
    out = d.groupBy(*keys).pivot(period_col, list(periods)).agg(agg.cast("double"))
    if fill is not None:
        out = out.na.fill(fill, list(periods))
    return out


def top_names(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[Column],
              k: int = 2, sep: str = ",", out: str | None = None) -> DataFrame:
    """First ``k`` distinct names per group in a given order, joined by ``sep``.

    pandas ``x.head(k).unique()``: take the first k rows, then de-duplicate.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__rn", name))).alias("__l"))
    names = F.array_distinct(F.transform("__l", lambda s: s[name]))
    return g.select(*keys, F.array_join(names, sep).alias(out or f"top_{name}"))


def max_in_set(df: DataFrame, keys: Sequence[str], value: str, set_pred: Column,
               wider_pred: Column, out: str = "target") -> DataFrame:
    """Max over a set with fallback to a wider set when the set is empty."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(set_pred, F.col(value))),
                   F.max(F.when(wider_pred, F.col(value)))).alias(out))
