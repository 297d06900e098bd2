"""Price tiers per platform x category (H7): brand PPU -> tier -> tier bounds.

The brand-level weighted PPU is an aggregate computed by Spark (one row per
platform x category x brand).  Tiering is per (platform, category) group:

* ``kmeans`` when the group has at least ``bins`` brands: PPU clipped to its
  5 %..95 % quantiles (linear interpolation), ``log1p``, then one-dimensional
  k-means started from the middles of equal-width bins, centres sorted, cut at
  their midpoints, bins narrower than 1e-8 dropped.
* ``quantile`` otherwise (or when forced): cut at the 1/3 and 2/3 quantiles
  of the unclipped PPU.

k-means is a recursive query over all groups at once (``lloyd_centres``).  In one dimension
a cluster is an interval between two midpoints, so its count and sum are differences of
prefix sums over the group's distinct values: a step joins each group's centres to the
prefix rows at the midpoints and no row of the group is touched again.

Tier bounds: ``floor(min/5)*5`` and ``ceil(max/5)*5`` of PPU per tier (D20).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.functions.exprs import null_greatest, safe_div
from shelfpulse.operators.joins import join_null_safe
from shelfpulse.operators.selection import group_quantiles
from shelfpulse.session import written

# Tier names in ascending price order.
TIER_NAMES = ("cost_effective", "mid_range", "premium")
GROUP = ("account", "gc_platform", "bgr")


def brand_ppu(facts: DataFrame, dim: DataFrame, l1) -> DataFrame:
    """Weighted PPU per platform x category x brand over L1 (D7), rounded to 0.

    Weight ``greatest(estimated_offtake_mrp, 1)``; only ``ppu_flag = 1`` rows
    count; category from the product dimension.  Rows without a PPU are
    dropped and the value made absolute, like the reference.
    """
    d = dim.select("product_id", F.lower("bgr").alias("__bgr")).dropDuplicates(["product_id"])
    f = (facts.where(F.col("snapshot_date").between(F.to_date(F.lit(str(l1[0]))),
                                                    F.to_date(F.lit(str(l1[1])))))
         .join(d, "product_id", "left"))
    w = null_greatest("estimated_offtake_mrp", F.lit(1))
    ppu = F.col("ppu_flag") == 1
    g = f.groupBy("account", F.lower("gc_platform").alias("gc_platform"),
                  F.col("__bgr").alias("bgr"), "brand").agg(
        F.sum(F.when(ppu, F.col("price_per_100_units") * w).otherwise(0)).alias("__n"),
        F.sum(F.when(ppu, w).otherwise(0)).alias("__d"))
    g = g.select("account", "gc_platform", "bgr", "brand",
                 F.round(safe_div(F.col("__n").cast("double"), F.col("__d").cast("double")), 0)
                 .alias("wt_ppu"))
    flags = (dim.select(F.lower("bgr").alias("bgr"), "brand", "is_own_brand").distinct())
    return (g.join(flags, ["bgr", "brand"], "left")
            .where(F.col("wt_ppu").isNotNull())
            .withColumn("wt_ppu", F.abs("wt_ppu")))


# Stop rule of the usual k-means (tolerance as a share of the variance, most
# steps) and the width below which a bin is dropped.
TOLERANCE, MOST_STEPS, NARROWEST = 1e-4, 300, 1e-8


def prefix_rows(z: DataFrame) -> DataFrame:
    """Per ``gid`` and distinct value: z, n and s (count and exact sum up to z), nx (the next
    value).  A row below all values has n = s = 0; the last one's nx is infinite."""
    d = z.groupBy("gid", "z").agg(F.count("*").alias("c"))
    w = Window.partitionBy("gid").orderBy("z")
    total = F.sum(F.col("z") * F.col("c").cast("decimal(18,0)")).over(w).cast("decimal(38,12)")
    rows = d.select("gid", F.col("z").cast("double").alias("z"), F.sum("c").over(w).alias("n"), total.alias("s"),
                    F.coalesce(F.lead("z").over(w).cast("double"), F.lit(float("inf"))).alias("nx"))
    bottom = d.groupBy("gid").agg(F.min("z").cast("double").alias("nx"))
    return rows.unionByName(bottom.select("gid", F.lit(float("-inf")).alias("z"), F.lit(0).cast("long").alias("n"),
                                          F.lit(0).cast("decimal(38,12)").alias("s"), "nx"))


def lloyd_centres(z: DataFrame, bins: int, once: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Sorted k-means centres ``c`` and range ``lo``, ``hi`` per ``gid`` of (gid, z).

    A value at a midpoint belongs to the lower cluster.  An empty cluster takes the value that
    is farthest from its centre (the lowest of several as far to nine places), which leaves its own;
    one per step.  A
    group is done when its centres move by the tolerance or less, all others go on.
    """
    spark = z.sparkSession
    prefix = once(prefix_rows(z))
    ends = (z.groupBy("gid").agg(F.min("z").cast("double").alias("lo"), F.max("z").cast("double").alias("hi"),
                                 F.count("*").alias("n"), F.sum("z").cast("decimal(38,12)").alias("s"),
                                 (F.var_pop(F.col("z").cast("double")) * TOLERANCE).alias("tol")))
    ends = once(ends.withColumn("c", F.array(*[
        F.col("lo") + (F.col("hi") - F.col("lo")) * ((2 * k + 1) / (2 * bins)) for k in range(bins)])))
    middle = [f"(r.c[{k}] + r.c[{k + 1}]) / 2" for k in range(bins - 1)]
    found = "\n".join(f"JOIN {{prefix}} p{k} ON p{k}.gid = r.gid AND p{k}.z <= {m} AND {m} < p{k}.nx" for k, m in enumerate(middle))

    def cut(of: str) -> list[str]:
        return [f"p{k}.{of}" for k in range(bins - 1)]

    def array(*items: str) -> str:
        return f"array({', '.join(items)})"
    query = f"""
    WITH RECURSIVE lloyd(gid, step, c, moving) MAX RECURSION LEVEL {MOST_STEPS + 1} AS (
      SELECT gid, 0, c, true FROM {{ends}}
      UNION ALL
      SELECT gid, step + 1, array_sort(new), step + 1 < {MOST_STEPS} AND
             aggregate(zip_with(new, c, (a, b) -> (a - b) * (a - b)), 0D, (a, b) -> a + b) > tol
      FROM (
        SELECT gid, step, c, tol, transform(sequence(0, {bins - 1}), k -> CASE
            WHEN empty > 0 AND far.d > 0 AND k = empty - 1 THEN far.x
            WHEN empty > 0 AND far.d > 0 AND k = far.k AND n[k] > 1 THEN (CAST(s[k] AS DOUBLE) - far.x) / (n[k] - 1)
            WHEN empty > 0 AND far.d > 0 AND k = far.k OR n[k] = 0 THEN c[k]
            ELSE CAST(s[k] AS DOUBLE) / n[k] END) AS new
        FROM (
          SELECT *, array_position(n, 0L) AS empty, array_max(flatten(transform(sequence(0, {bins - 1}), k ->
              IF(n[k] = 0, array(), transform(array(first[k], last[k]), x ->
                 named_struct('d', round(abs(x - c[k]), 9), 'low', -x, 'k', k, 'x', x)))))) AS far
          FROM (
            SELECT r.gid, r.step, r.c, e.tol,
                   zip_with({array(*cut('n'), 'e.n')}, {array('0L', *cut('n'))}, (b, a) -> b - a) AS n,
                   zip_with({array(*cut('s'), 'e.s')}, {array('CAST(0 AS DECIMAL(38,12))', *cut('s'))}, (b, a) -> b - a) AS s,
                   {array('e.lo', *cut('nx'))} AS first, {array(*cut('z'), 'e.hi')} AS last
            FROM lloyd r JOIN {{ends}} e ON e.gid = r.gid {found}
            WHERE r.moving))))
    SELECT l.gid, l.c, e.lo, e.hi FROM lloyd l JOIN {{ends}} e ON e.gid = l.gid WHERE NOT l.moving"""
    return spark.sql(query, prefix=prefix, ends=ends)


def kmeans_codes(z: DataFrame, bins: int, once: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Adds ``code`` (0 for the lowest bin) to (gid, z, ...).  A value at a cut is above it."""
    centres = once(lloyd_centres(z, bins, once))
    edges = F.concat(F.array("lo"), F.transform(F.sequence(F.lit(0), F.lit(bins - 2)), lambda k: (
        F.get("c", k) + F.get("c", k + 1)) / 2), F.array("hi"))
    wide = F.filter("edges", lambda e, i: (i == 0) | (e - F.get("edges", i - 1) > NARROWEST))
    cuts = centres.withColumn("edges", edges).withColumn("wide", wide).select(
        "gid", F.slice("wide", 2, F.greatest(F.size("wide") - 2, F.lit(0))).alias("cuts"))
    coded = z.join(cuts, "gid").withColumn("code", F.size(F.filter("cuts", lambda e: e <= F.col("z").cast("double"))))
    return coded.drop("cuts")


def tier_bounds(tiers: DataFrame, keys=(*GROUP, "ppu_category"), step: int = 5) -> DataFrame:
    """Lower/upper PPU bound per tier rounded out to multiples of ``step``."""
    return tiers.groupBy(*keys).agg(
        (F.floor(F.min("wt_ppu") / step) * step).cast("double").alias("ppu_lower_bound"),
        (F.ceil(F.max("wt_ppu") / step) * step).cast("double").alias("ppu_upper_bound"))


def tier_names(bins: int) -> tuple[str, ...]:
    return TIER_NAMES[:bins] if bins <= len(TIER_NAMES) else tuple(f"tier_{i}" for i in range(bins))


def quantile_tiers(ppu: DataFrame, once: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Quantile branch for every group."""
    ppu = once(ppu)
    d = join_null_safe(ppu, group_quantiles(ppu, GROUP, "wt_ppu", [1 / 3, 2 / 3], once=once)
                       .toDF(*GROUP, "__q1", "__q2"), GROUP, "inner")
    return (d.withColumn("binning_method", F.lit("quantile"))
            .withColumn("ppu_category", _by_quantile()).drop("__q1", "__q2"))


def _by_quantile():
    return (F.when(F.col("wt_ppu") <= F.col("__q1"), TIER_NAMES[0])
            .when(F.col("wt_ppu") <= F.col("__q2"), TIER_NAMES[1]).otherwise(TIER_NAMES[2]))


def kmeans_tiers(ppu: DataFrame, bins: int = 3, clip=(0.05, 0.95),
                 once: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """k-means for groups of ``bins`` brands or more, the quantile cut for the others."""
    ppu = once(ppu.select(*GROUP, "brand", "is_own_brand", "wt_ppu"))
    cuts = group_quantiles(ppu, GROUP, "wt_ppu", [*clip, 1 / 3, 2 / 3], once=once).toDF(*GROUP, "__lo", "__hi", "__q1", "__q2")
    sizes = ppu.groupBy(*GROUP).agg(F.count("*").alias("__brands"))
    d = join_null_safe(join_null_safe(ppu, cuts, GROUP, "inner"), sizes, GROUP, "inner")
    # twelve places make the sums of the prefixes exact, in whatever order they are added
    z = F.log1p(F.least(F.greatest("wt_ppu", "__lo"), F.col("__hi"))).cast("decimal(18,12)")
    d = once(d.withColumn("gid", F.to_json(F.struct(*GROUP))).withColumn("z", z))
    names = F.array(*[F.lit(n) for n in tier_names(bins)])
    many = (kmeans_codes(d.where(F.col("__brands") >= bins), bins, once)
            .withColumn("binning_method", F.lit("kmeans")).withColumn("ppu_category", F.get(names, F.col("code"))))
    few = (d.where(F.col("__brands") < bins).withColumn("binning_method", F.lit("quantile"))
           .withColumn("ppu_category", _by_quantile()))
    cols = [*GROUP, "brand", "is_own_brand", "wt_ppu", "binning_method", "ppu_category"]
    return many.select(*cols).unionByName(few.select(*cols))


def price_tiers(facts: DataFrame, dim: DataFrame, l1, bins: int = 3, clip=(0.05, 0.95),
                method: str = "auto", once: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Brand tiers with method and bounds (H7).

    ``method='auto'`` follows the reference (k-means when the group has at
    least ``bins`` brands, quantile otherwise); ``'quantile'`` forces the
    quantile cut for every group.  ``once`` writes a frame that is read more than
    once and returns it read back.
    """
    ppu = brand_ppu(facts, dim, l1)
    tiers = quantile_tiers(ppu, once) if method == "quantile" else kmeans_tiers(ppu, bins, clip, once)
    w = Window.partitionBy(*GROUP, "ppu_category")
    return (tiers
            .withColumn("ppu_lower_bound", (F.floor(F.min("wt_ppu").over(w) / 5) * 5).cast("double"))
            .withColumn("ppu_upper_bound", (F.ceil(F.max("wt_ppu").over(w) / 5) * 5).cast("double")))
