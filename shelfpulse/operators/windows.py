"""Window operators: share of total, contribution, ranking, running share, Pareto tags.

All windows run on aggregates (few rows per partition) and are partitioned by
at least (platform, category): at scale the exchange feeding a window hashes on
those keys, so they lead every ``partitionBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def contribution(df: DataFrame, part_keys: Sequence[str], value: str,
                 out: str = "contribution_pct") -> DataFrame:
    """Share of each row's value in its partition, in percent."""
    w = Window.partitionBy(*part_keys)
    return df.withColumn(out, F.try_divide(100 * F.col(value).cast("double"),
                                           F.sum(F.col(value).cast("double")).over(w)))


def rank_in(df: DataFrame, part_keys: Sequence[str], order: Sequence[Column],
            out: str = "rn") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY ... ORDER BY ...)`` as bigint (E5).

    ``order`` must end with tie-breakers on the remaining keys (X10).
    """
    w = Window.partitionBy(*part_keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def running_share(df: DataFrame, part_keys: Sequence[str], order: Sequence[Column], value: str,
                  out: str = "cum_share") -> DataFrame:
    """Running sum over ROWS UNBOUNDED PRECEDING .. CURRENT ROW divided by the total."""
    w_run = (Window.partitionBy(*part_keys).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w_all = Window.partitionBy(*part_keys)
    v = F.col(value).cast("double")
    return df.withColumn(out, F.try_divide(F.sum(v).over(w_run), F.sum(v).over(w_all)))


def pareto_tag(cum_share: str, rank: str, value: str,
               cuts=((0.25, 2, "high"), (0.50, 4, "medium")), default: str = "low") -> Column:
    """Pareto tag (E7): first cut whose share or rank bound holds and value > 0.

    Cumulative share is compared unrounded.
    """
    expr = None
    for share_cut, rank_cut, tag in cuts:
        cond = ((F.col(cum_share) <= share_cut) | (F.col(rank) <= rank_cut)) & (F.col(value) > 0)
        expr = F.when(cond, tag) if expr is None else expr.when(cond, tag)
    return expr.otherwise(default)


def pareto_tags(df: DataFrame, part_keys: Sequence[str], value: str, tie_keys: Sequence[str],
                cuts=((0.25, 2, "high"), (0.50, 4, "medium"))) -> DataFrame:
    """Rank by ``value`` desc, running share, tag (E5 + E6 + E7) in one window spec."""
    order = [F.col(value).desc_nulls_first()] + [F.col(k).asc_nulls_last() for k in tie_keys]
    d = rank_in(df, part_keys, order, "impact_rank")
    d = running_share(d, part_keys, order, value, "cum_share")
    return d.withColumn("pareto_tag", pareto_tag("cum_share", "impact_rank", value, cuts))


def ranked_running_share(df: DataFrame, part_keys: Sequence[str], order_value: str,
                         sum_value: str, tie: Sequence[str], buckets: int = 32,
                         rank_out: str = "rank", cum_out: str = "cum_share") -> DataFrame:
    """Exact rank and running share in ``order_value`` descending order (NULL
    first, then ``tie`` ascending), computed in parallel inside each partition.

    A running sum needs a total order, so a plain window sorts a whole
    partition in one task; when one partition holds a large share of the rows
    that task becomes the job.  Here each partition is cut into ``buckets``
    value ranges (approximate quantiles -- the cut points only split the work,
    they never change the result because equal values always share a bucket):

    1. per-bucket row counts and sums (a small aggregate),
    2. prefix offsets over the buckets of a partition (a window over the small aggregate),
    3. row number and running sum inside each (partition, bucket) -- parallel tasks,
    4. rank = offset count + row number; share = (offset sum + running sum) / total.

    ``sum_value`` should be exact (DECIMAL) so the share does not depend on the
    order additions happen in.
    """
    v = F.col(order_value)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*part_keys).agg(
        F.percentile_approx(v, F.array(*[F.lit(p) for p in probs]), 1000).alias("__cuts"))
    from shelfpulse.operators.joins import join_null_safe  # NULL keys form a partition too
    d = join_null_safe(df, cuts, list(part_keys), "left")
    d = d.withColumn("__b", F.when(v.isNull(), F.lit(-1)).otherwise(
        F.coalesce(F.size(F.filter("__cuts", lambda q: q > v)), F.lit(0)))).drop("__cuts")
    bt = d.groupBy(*part_keys, "__b").agg(F.count("*").alias("__n"), F.sum(sum_value).alias("__s"))
    before = Window.partitionBy(*part_keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bt = (bt.withColumn("__off_n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
          .withColumn("__off_s", F.coalesce(F.sum("__s").over(before), F.lit(0)))
          .withColumn("__tot", F.sum("__s").over(Window.partitionBy(*part_keys)))
          .drop("__n", "__s"))
    order = [v.desc_nulls_first()] + [F.col(t).asc_nulls_last() for t in tie]
    w = Window.partitionBy(*part_keys, "__b").orderBy(*order)
    d = (d.withColumn("__rn", F.row_number().over(w))
         .withColumn("__run", F.sum(sum_value).over(
             w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    d = join_null_safe(d, bt, [*part_keys, "__b"], "left")
    return (d.withColumn(rank_out, (F.col("__off_n") + F.col("__rn")).cast("bigint"))
            .withColumn(cum_out, F.try_divide((F.col("__off_s") + F.col("__run")).cast("double"),
                                              F.col("__tot").cast("double")))
            .drop("__b", "__rn", "__run", "__off_n", "__off_s", "__tot"))


def with_group_totals(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                      prefix: str = "__tot_") -> DataFrame:
    """Attach ``sum(value)`` over ``keys`` to every row as ``<prefix><value>``.

    Same numbers as ``sum(value) OVER (PARTITION BY keys)``, computed as a
    partially aggregated ``groupBy`` joined back on the keys (NULL keys match,
    like a window partition).  A window puts a whole partition in one task; the
    join lets AQE split a hot partition of the large side (skew join) while the
    totals side holds one row per key.  Use it where partitions grow with the
    data (SKUs or keywords per category x city); windows over brand-level
    aggregates stay windows.
    """
    from shelfpulse.operators.joins import join_null_safe
    tots = df.groupBy(*keys).agg(*[F.sum(v).alias(f"{prefix}{v}") for v in values])
    return join_null_safe(df, tots, list(keys), "inner")
