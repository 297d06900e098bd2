"""Facts laid out by platform and month.

One table for all platforms, in folders ``<platform>/<month>``, replaces one table per
platform.  A date window prunes months before any file is listed for reading; a join to the
accounts' platforms prunes platforms at run time (dynamic partition pruning).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "month_key"


def month_key(day) -> Column:
    """Year and month of a day as one number, 200011 for November 2000."""
    d = F.col(day) if isinstance(day, str) else day
    return (F.year(d) * 100 + F.month(d)).cast("int")


def write_platform_months(df: DataFrame, path: str, platform: str = "gc_platform", day: str = "snapshot_date",
                          derive: Callable[[DataFrame], DataFrame] | None = None) -> T.StructType:
    """Write ``df`` in folders of platform and month; the schema to read it with.

    Rows are rebalanced by folder before the write, so a folder gets few files and a
    platform that holds a third of the rows is split over many tasks.  A NULL platform or
    day has a folder of its own; an empty platform name reads back as NULL.

    ``derive`` makes the rows to write out of ``df``'s, row by row; it keeps ``platform`` and
    ``day``.  It runs after the rebalance, so only the columns it starts from are shuffled.
    """
    d = df.withColumn(MONTH, month_key(day)).hint("rebalance", platform, MONTH)
    if derive:
        d = derive(d).withColumn(MONTH, month_key(day))
    d.write.partitionBy(platform, MONTH).parquet(path)
    return T.StructType([f for f in d.schema if f.name not in (platform, MONTH)]
                        + [d.schema[platform], d.schema[MONTH]])


def read_platform_months(spark: SparkSession, path: str, schema: T.StructType, windows=(),
                         platforms: DataFrame | None = None, platform: str = "gc_platform",
                         day: str = "snapshot_date") -> DataFrame:
    """The rows in any of ``windows`` (pairs of days; none: all) of the platforms in
    ``platforms`` (its column ``platform``; None: all).

    Months outside the windows and platforms that are not asked for are never opened.
    """
    d = spark.read.schema(schema).parquet(path)
    months = days = F.lit(False)
    for lo, hi in windows:
        a, b = F.to_date(F.lit(str(lo))), F.to_date(F.lit(str(hi)))
        months = months | F.col(MONTH).between(month_key(a), month_key(b))
        days = days | F.col(day).between(a, b)
    if windows:
        d = d.where(months & days)
    if platforms is not None:
        d = d.join(platforms.select(platform), platform, "left_semi")
    return d.drop(MONTH)
