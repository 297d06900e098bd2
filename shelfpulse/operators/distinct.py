"""Exact distinct counts at many grains from one aggregate: bitmaps that merge.

``count(DISTINCT)`` cannot be merged from a finer grain to a coarser one, so every grain costs
another aggregate of the facts.  A bitmap per group can: the facts are reduced once, to the
finest grain, and every grain is the OR of its bitmaps.

Values of any type are numbered first, so that a bit stands for exactly one value and bitmaps
are dense.  A bitmap is kept in words of 64 numbers, one row per group and word that has any: a
group of few values costs as many rows at most, a group of many one row per 64 of them.  Words
are plain numbers, so their aggregates are hash aggregates of fixed width that spill; no row and
no task holds a whole group, and a hot group's merge is partial on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 100_000         # distinct values numbered in one sorted partition
WORD = 64               # numbers per row of a bitmap


def _unchanged(df: DataFrame) -> DataFrame:
    return df


def dense_numbers(df: DataFrame, col: str, once: Callable[[DataFrame], DataFrame] = _unchanged) -> DataFrame:
    """(value, number): the distinct non-NULL values of ``col``, numbered from 1 without gaps.

    Numbers run within shards of some ``SHARD`` values (by hash) and continue from shard to
    shard; only the shards' sizes pass through one task.  ``once`` may write the distinct
    values, which are read three times.
    """
    values = once(df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct())
    shards = max(1, -(-values.count() // SHARD))
    dealt = values.withColumn("__shard", F.pmod(F.xxhash64("value"), F.lit(shards)))
    before = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    start = (dealt.groupBy("__shard").agg(F.count("*").alias("__n"))
             .select("__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return (dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__shard").orderBy("value")))
            .join(F.broadcast(start), "__shard")            # one row per SHARD values
            .select("value", (F.col("__start") + F.col("__at")).alias("number")))


def bitmaps(df: DataFrame, keys: Sequence[str], col: str, numbers: DataFrame,
            where: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, __bucket, one word per entry of ``where``): the numbers that occur per group.

    ``where`` names the counts and the rows each one takes (default: ``n``, all rows).
    Groups without a value have a row with empty words, so that they are counted as 0.
    """
    where = where or {"n": F.lit(True)}
    at = (df.select(*keys, F.col(col).alias("value"), *[c.alias(f"__{n}") for n, c in where.items()])
          .join(numbers, "value", "left")
          .withColumn("__bucket", F.coalesce(F.expr(f"(number - 1) DIV {WORD}"), F.lit(0).cast("long")))
          .withColumn("__bit", F.expr(f"shiftleft(1L, CAST((number - 1) % {WORD} AS INT))")))
    return at.groupBy(*keys, "__bucket").agg(
        *[F.coalesce(F.bit_or(F.when(F.col(f"__{n}"), F.col("__bit"))), F.lit(0).cast("long")).alias(n) for n in where])


def merged_counts(maps: DataFrame, grain: Sequence[str], names: Sequence[str] = ("n",)) -> DataFrame:
    """Distinct values per group of a grain that is coarser than (or equal to) the bitmaps' one."""
    merged = maps.groupBy(*grain, "__bucket").agg(*[F.bit_or(n).alias(n) for n in names])
    return merged.groupBy(*grain).agg(*[F.sum(F.bit_count(n)).cast("bigint").alias(n) for n in names])
