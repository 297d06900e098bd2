"""Exact order statistics per group without a buffer of the group.

Rows become distinct values with their counts (a partially aggregated ``groupBy`` on keys and
value, so a hot group is spread over all tasks).  While any group holds more than ``small``
distinct values, its values are cut into ranges (approximate quantiles of the distinct values;
they only split the work), the counts of the ranges say in which range a wanted rank lies, and
only the values of that range go on.  A range holds a small part of the values before it,
whatever their distribution and ties, so a few rounds over ever fewer rows are enough.  What is
left is ordered inside (group, wanted rank).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.operators.joins import join_null_safe
from shelfpulse.session import written

RANGES = 256


def _range_of(v: str, cuts: str) -> Column:
    """Number of cut points below a value."""
    return F.size(F.filter(cuts, lambda c: c < F.col(v)))


def _narrowed(values: DataFrame, by: list[str], targets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values of the ranges that hold each target's ranks, and the targets within them."""
    cuts = values.groupBy(*by).agg(F.percentile_approx(
        "__v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(4 * RANGES)).alias("__cuts"))
    dealt = join_null_safe(values, cuts, by, "inner").withColumn("__b", _range_of("__v", "__cuts")).drop("__cuts")
    ranges = dealt.groupBy(*by, "__b").agg(F.sum("__w").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))      # RANGES rows a group
    rank_in = lambda k: (F.col("__start") <= k) & (k < F.col("__start") + F.col("__n"))
    held = join_null_safe(targets, ranges, by, "inner")
    held = held.where(rank_in(F.col("__k")) | rank_in(F.col("__k") + 1))
    found = held.groupBy(*keys, "__t").agg(
        F.min("__b").alias("__lo"), F.max("__b").alias("__hi"), F.min("__start").alias("__below"),
        F.first("__k").alias("__k"), F.first("__frac").alias("__frac"))
    kept = join_null_safe(dealt, found.select(*keys, "__t", "__lo", "__hi"), by, "inner")
    kept = kept.where(F.col("__b").between(F.col("__lo"), F.col("__hi"))).select(*keys, "__t", "__v", "__w")
    return kept, found.select(*keys, "__t", (F.col("__k") - F.col("__below")).alias("__k"), "__frac")


def group_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], small: int = 50_000,
                    once: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Exact linearly-interpolated quantiles per group, as ``q_<prob>`` columns.

    NULL values do not count; a group of NULLs alone has NULL quantiles.  NULL keys are a
    group.  ``once`` writes a frame that is read more than once and returns it read back.
    """
    keys = list(keys)
    values = once(df.groupBy(*keys, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__w")))
    groups = values.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__w"))), F.lit(0)).alias("__n"),
                                       F.count("__v").alias("__d"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("__t"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    targets = (groups.where("__n > 0").withColumn("__x", wanted)
               .withColumn("__pos", F.col("__x.p") * (F.col("__n") - 1))
               .select(*keys, F.col("__x.__t").alias("__t"), F.floor("__pos").alias("__k"),
                       (F.col("__pos") - F.floor("__pos")).alias("__frac")))
    by, left = keys, values.where(F.col("__v").isNotNull())
    most = groups.agg(F.max("__d")).first()[0] or 0
    while most > small:
        left, targets = _narrowed(left, by, targets, keys)
        left, targets, by = once(left), once(targets), [*keys, "__t"]
        most = left.groupBy(*by).agg(F.count("*").alias("d")).agg(F.max("d")).first()[0]
    upto = F.sum("__w").over(Window.partitionBy(*by).orderBy("__v"))
    held = join_null_safe(left.withColumn("__upto", upto), targets, by, "inner")
    covers = lambda k: (F.col("__upto") > k) & (F.col("__upto") - F.col("__w") <= k)
    k, frac = F.col("__k"), F.col("__frac")
    ends = held.groupBy(*keys, "__t").agg(F.max(F.when(covers(k), F.col("__v"))).alias("__a"),
                                          F.max(F.when(covers(k + 1), F.col("__v"))).alias("__z"), F.first(frac).alias("__frac"))
    # at a whole position, and between equal values, the value itself
    q = F.when((frac == 0) | F.col("__z").isNull() | (F.col("__a") == F.col("__z")), F.col("__a")).otherwise(
        (1 - frac) * F.col("__a") + frac * F.col("__z"))
    names = [f"q_{str(p).replace('.', '_')}" for p in probs]
    wide = ends.withColumn("__q", q).groupBy(*keys).agg(
        *[F.max(F.when(F.col("__t") == i, F.col("__q"))).alias(n) for i, n in enumerate(names)])
    return join_null_safe(groups.select(*keys), wide, keys, "left")
