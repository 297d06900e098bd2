"""Sorts, limits and top-k operators.

Top-k per group is a ``row_number`` window (each group is sorted inside its
own task after a hash exchange on the group keys), never a global sort or a
driver-side loop.  Every order ends with tie-breakers (X10) and spells its
NULL order (N7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Salt slices for two-phase top-k over candidate sets whose size grows with the data.
SKEW_SALT = 16


def top_k(df: DataFrame, part_keys: Sequence[str], order: Sequence[Column], k: int,
          cut: Column | None = None, rank_col: str | None = "rank",
          salt: int | None = None) -> DataFrame:
    """Rows passing ``cut``, first ``k`` per partition by ``order`` (F2).

    With ``salt`` the selection runs in two phases: first ``k`` inside each of
    ``salt`` hash slices of a partition (parallel tasks even when one partition
    holds a large share of the rows), then first ``k`` of those survivors.  The
    global first ``k`` rows are always among the slice winners, so the result
    is exact; only ``salt * k`` rows per partition reach the second phase.
    """
    d = df if cut is None else df.where(cut)
    if salt:
        d = d.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in d.columns]), F.lit(salt)))
        w1 = Window.partitionBy(*part_keys, "__salt").orderBy(*order)
        d = d.withColumn("__rn1", F.row_number().over(w1)).where(F.col("__rn1") <= k).drop("__rn1", "__salt")
    w = Window.partitionBy(*part_keys).orderBy(*order)
    d = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    if rank_col:
        return d.withColumnRenamed("__rn", rank_col).withColumn(rank_col, F.col(rank_col).cast("bigint"))
    return d.drop("__rn")


def top_k_for(drivers: DataFrame, df: DataFrame, keys: Sequence[str], order: Sequence[Column],
              k: int, cut: Column | None = None, rank_col: str = "rank") -> DataFrame:
    """For each driver row, the first ``k`` matching rows of ``df`` (F3): semi join + top-k."""
    d = df if cut is None else df.where(cut)
    d = d.join(drivers.select(*keys).distinct(), list(keys), "left_semi")
    return top_k(d, keys, order, k, None, rank_col)


def two_stage_top(df: DataFrame, part_keys: Sequence[str], order1: Sequence[Column], k1: int,
                  order2: Sequence[Column], k2: int, salt: int | None = SKEW_SALT) -> DataFrame:
    """Top ``k1`` by ``order1``, then of those top ``k2`` by ``order2``."""
    first = top_k(df, part_keys, order1, k1, rank_col="stage1_rank", salt=salt)
    return top_k(first, part_keys, order2, k2, rank_col="stage2_rank")


def top_metrics(df: DataFrame, keys: Sequence[str], metric_cols: Sequence[str], k: int = 2,
                sign: int = 1) -> DataFrame:
    """Top ``k`` metric names across columns of each row.

    Metrics moving in the wanted direction (``sign * value > 0``) first, by
    signed value; when fewer than ``k`` move that way, the rest by absolute
    value.  Built per row as an array of (group, order, name, value) structs
    sorted with ``array_sort``: no unpivot, no shuffle.
    """
    s = float(sign)
    items = []
    for m in metric_cols:
        v = F.col(m).cast("double")
        items.append(F.struct(
            F.when(v * s > 0, 0).otherwise(1).alias("g"),
            F.when(v * s > 0, -v * s).otherwise(-F.abs(v)).alias("o"),
            F.lit(m).alias("metric"), v.alias("value")))
    arr = F.array_sort(F.filter(F.array(*items), lambda x: x["value"].isNotNull()))
    top = F.slice(arr, 1, k)
    return df.select(*keys, F.transform(top, lambda x: x["metric"]).alias("top_metrics"),
                     F.transform(top, lambda x: x["value"]).alias("top_values"))


def max_abs_row(df: DataFrame, keys: Sequence[str], col: str, tie: Sequence[str] = (),
                salt: int | None = SKEW_SALT) -> DataFrame:
    """Row with the largest absolute ``col`` per group (F8)."""
    order = [F.abs(F.col(col)).desc_nulls_last()] + [F.col(t).asc_nulls_last() for t in tie]
    return top_k(df, keys, order, 1, rank_col=None, salt=salt)


def limit_ordered(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """``ORDER BY ... LIMIT n`` (F10): Spark plans TakeOrderedAndProject, a per-task
    top-n followed by one merge of n rows per task."""
    return df.orderBy(*order).limit(n)
