"""Period labelling, period filters and period-over-period comparison.

``l1`` is the current window (label ``dr1``), ``l2`` the comparison window
(label ``dr2``); both are ``(start, end)`` pairs of ``datetime.date`` or ISO
strings, inclusive on both ends like SQL ``BETWEEN``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import col_of, null_least, pandas_round

Period = tuple


def _d(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, (_dt.date, _dt.datetime)):
        x = x.isoformat()[:10]
    return F.to_date(F.lit(str(x)))


def validate_periods(l1: Period, l2: Period) -> None:
    """Raise on an inverted window (the reference only shows a message, then goes on)."""
    for name, (a, b) in (("l1", l1), ("l2", l2)):
        if str(a) > str(b):
            raise ValueError(f"{name} starts after it ends: {a} > {b}")


def period_label(date_col, l1: Period, l2: Period, first: str = "dr1") -> Column:
    """``dr1`` / ``dr2`` / NULL by date range (B1, B2).

    ``first`` decides which window is tested first; it only matters when the
    windows overlap (B1 tests L1 first, B2 tests L2 first).
    """
    d = col_of(date_col)
    in1 = d.between(_d(l1[0]), _d(l1[1]))
    in2 = d.between(_d(l2[0]), _d(l2[1]))
    if first == "dr1":
        return F.when(in1, F.lit("dr1")).when(in2, F.lit("dr2"))
    return F.when(in2, F.lit("dr2")).when(in1, F.lit("dr1"))


def label_period(df: DataFrame, date_col: str, l1: Period, l2: Period, first: str = "dr1",
                 out: str = "date_period") -> DataFrame:
    return df.withColumn(out, period_label(date_col, l1, l2, first))


def in_periods(date_col, l1: Period, l2: Period) -> Column:
    d = col_of(date_col)
    return d.between(_d(l1[0]), _d(l1[1])) | d.between(_d(l2[0]), _d(l2[1]))


def filter_periods(df: DataFrame, date_col: str, l1: Period, l2: Period) -> DataFrame:
    """Keep rows inside either window (B3); plain comparisons reach the parquet scan."""
    validate_periods(l1, l2)
    return df.where(in_periods(date_col, l1, l2))


def capped_periods(date_col, l1: Period, l2: Period, till_col) -> Column:
    """B4 predicate: both windows stop at the data freshness date.

    L1 ends at ``least(till, l1_end)``; L2 ends at ``least(till - 1 month,
    l2_end)`` so both windows cover the same number of days.  A NULL ``till``
    makes the bound NULL and drops the row (warehouse LEAST, N1).  The outer
    bounds (earliest start, latest end) are added as plain comparisons so the
    scan can prune by them.
    """
    d = col_of(date_col)
    t = col_of(till_col)
    c2 = d.between(_d(l2[0]), null_least(F.add_months(t, -1), _d(l2[1])))
    c1 = d.between(_d(l1[0]), null_least(t, _d(l1[1])))
    lo = min(str(l1[0]), str(l2[0]))
    hi = max(str(l1[1]), str(l2[1]))
    return d.between(_d(lo), _d(hi)) & (c2 | c1)


def filter_periods_capped(df: DataFrame, date_col: str, l1: Period, l2: Period,
                          till_col: str = "platform_offtake_uploaded_till",
                          extra: Column | None = None) -> DataFrame:
    """B4 filter; ``extra`` applies to both windows (the reference binds it to L1 only, X1)."""
    validate_periods(l1, l2)
    cond = capped_periods(date_col, l1, l2, till_col)
    if extra is not None:
        cond = cond & extra
    return df.where(cond)


def snapshot_on_days(df: DataFrame, date_col: str, l1_end, l2_end,
                     out: str = "date_period") -> DataFrame:
    """Rows of exactly two days, labelled ``dr1`` (L1 end) / ``dr2`` (L2 end)."""
    d = col_of(date_col)
    return (df.where(d.isin(_d(l1_end), _d(l2_end)))
            .withColumn(out, F.when(d == _d(l1_end), "dr1").otherwise("dr2")))


def snapshot_or_previous(df: DataFrame, date_col: str, day, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``day``; if there are none, rows of the day before.

    With ``keys`` the fallback is decided per key group.  The chosen day is the
    max date among {day, day-1} (a one-row-per-group aggregate joined back),
    so no value goes through the driver.
    """
    d = col_of(date_col)
    day_c = _d(day)
    cand = df.where((d == day_c) | (d == F.date_sub(day_c, 1)))
    chosen = cand.groupBy(*keys).agg(F.max(date_col).alias("__day"))
    if not keys:
        # one row: a broadcast of a single value
        return cand.join(F.broadcast(chosen), cand[date_col] == chosen["__day"]).drop("__day")
    cond = [cand[k].eqNullSafe(chosen[k]) for k in keys] + [cand[date_col] == chosen["__day"]]
    out = cand.join(chosen, cond, "left_semi")
    return out


def default_windows(df: DataFrame, keys: Sequence[str] = ("account",), date_col: str = "snapshot_date",
                    back: int = 30) -> DataFrame:
    """Per key: L1 from the first of the month of its last day to that day, L2 the ``back``
    days before L1.  The last day is the data's, not today's, so a report over old data
    repeats.  Keys without any day are left out."""
    last = df.groupBy(*keys).agg(F.max(date_col).alias("l1_end")).where(F.col("l1_end").isNotNull())
    start = F.trunc("l1_end", "month")
    return last.select(*keys, start.alias("l1_start"), "l1_end", F.date_sub(start, back).alias("l2_start"),
                       F.date_sub(start, 1).alias("l2_end"))


def label_default_windows(df: DataFrame, keys: Sequence[str] = ("account",), date_col: str = "snapshot_date",
                          back: int = 30) -> DataFrame:
    """Rows inside their key's default windows with ``date_period`` (``dr1`` / ``dr2``)."""
    w = default_windows(df, keys, date_col, back).select(
        *[F.col(k).alias(f"__{k}") for k in keys], "l1_start", "l1_end", "l2_start", "l2_end")
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(date_col).between(F.col("l2_start"), F.col("l1_end"))]
    p = F.when(F.col(date_col) >= F.col("l1_start"), "dr1").otherwise("dr2")
    return df.join(w, cond).withColumn("date_period", p).select(*df.columns, "date_period")


def compare_periods(df: DataFrame, group_cols: Sequence[str], metric_cols: Sequence[str],
                    date_col: str = "date_period", rounded: bool = True,
                    names: dict | None = None, keep_dr2: bool = False) -> DataFrame:
    """Period compare (C11 / C12): ``dr1`` rows left-joined to ``dr2`` rows on the keys.

    Output: keys, ``<m>_dr1`` per metric (plus ``<m>_dr2`` with ``keep_dr2``)
    and ``change_<m> = <m>_dr1 - <m>_dr2`` (pandas rounding to one decimal when
    ``rounded``; ``names`` renames change columns, e.g. ``{'organic_sov':
    'ogsov'}``).  NULL keys match NULL keys (pandas merge, N3).  A key present
    only in ``dr1`` is kept with NULL change; keys only in ``dr2`` are dropped.

    Implementation: the input is one row per (period, keys) -- an aggregate --
    so the left join of the two halves is a single ``groupBy(keys)`` with
    period-conditional values: one shuffle instead of a self-join's two, and
    NULL keys group together exactly like the pandas merge matches them.
    """
    names = names or {}
    p = F.col(date_col)
    aggs = [F.max(F.when(p == "dr1", 1)).alias("__has1")]
    for m in metric_cols:
        aggs.append(F.first(F.when(p == "dr1", F.col(m)), ignorenulls=True).alias(f"{m}_dr1"))
        aggs.append(F.first(F.when(p == "dr2", F.col(m)), ignorenulls=True).alias(f"{m}_dr2"))
    g = (df.where(p.isin("dr1", "dr2")).groupBy(*group_cols).agg(*aggs)
         .where(F.col("__has1") == 1))
    out = [F.col(c) for c in group_cols] + [F.col(f"{m}_dr1") for m in metric_cols]
    if keep_dr2:
        out += [F.col(f"{m}_dr2") for m in metric_cols]
    for m in metric_cols:
        diff = F.col(f"{m}_dr1").cast("double") - F.col(f"{m}_dr2").cast("double")
        if rounded:
            diff = pandas_round(diff, 1)
        out.append(diff.alias(f"change_{names.get(m, m)}"))
    return g.select(*out)


def share_impact(ms: DataFrame, keys: Sequence[str], date_col: str = "date_period",
                 share: str = "market_share", size: str = "category_size",
                 sales: str = "actual_sum") -> DataFrame:
    """Share change and sales impact at a key grain.

    Inner match of ``dr1`` and ``dr2`` rows on ``keys`` (a key only in one
    period is dropped); ``pct_change = share_dr1 - share_dr2`` in points and
    ``sales_impact = pct_change * size_dr1 / 100``.  ``ms`` must be one row per
    (period, keys) -- the grain the share was computed at.
    """
    p = F.col(date_col)
    aggs = [F.max(F.when(p == "dr1", 1)).alias("__h1"), F.max(F.when(p == "dr2", 1)).alias("__h2")]
    for src, dst in ((size, "size"), (share, "share"), (sales, "actual_sales")):
        aggs.append(F.first(F.when(p == "dr1", F.col(src)), ignorenulls=True).alias(f"{dst}_dr1"))
        aggs.append(F.first(F.when(p == "dr2", F.col(src)), ignorenulls=True).alias(f"{dst}_dr2"))
    g = (ms.where(p.isin("dr1", "dr2")).groupBy(*keys).agg(*aggs)
         .where((F.col("__h1") == 1) & (F.col("__h2") == 1)).drop("__h1", "__h2"))
    # sales impact in DECIMAL with six decimals of a share point, so sums of impacts
    # do not depend on summation order
    exact = (F.col("pct_change").cast("decimal(12,6)") * F.col("size_dr1").cast("decimal(24,4)")
             * F.lit(0.01).cast("decimal(3,2)"))
    return (g.withColumn("pct_change", F.col("share_dr1") - F.col("share_dr2"))
             .withColumn("sales_impact", exact.cast("double")))
