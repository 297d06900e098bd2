"""Table scans (op A1) and the platform union (op A10)."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(base: str, name: str) -> str:
    """``<base>/<name>.parquet`` when that exists, else ``<base>/<name>`` (a folder)."""
    p = f"{base.rstrip('/')}/{name}.parquet"
    if ":" in base.split("/", 1)[0] or os.path.exists(p):       # any URI scheme: only Spark can look
        return p
    return os.path.join(base, name)


def scan_table(spark: SparkSession, base: str, name: str, lower_names: bool = True) -> DataFrame:
    """Read one parquet table lazily; column names lower-cased like the reference.

    Unlike the reference (which returns an empty frame on a query error) a
    missing table raises: a silent empty frame would turn into wrong shares.
    """
    df = spark.read.parquet(table_path(base, name))
    if lower_names and any(c != c.lower() for c in df.columns):
        df = df.toDF(*[c.lower() for c in df.columns])
    return df


def register_views(spark: SparkSession, base: str, names=TEST_TABLES) -> None:
    """Register every table as a temp view so ``spark.sql`` can address it."""
    for n in names:
        scan_table(spark, base, n).createOrReplaceTempView(n)


def scan_platforms(frames: dict[str, DataFrame], platform_col: str = "gc_platform",
                   account: str | None = None) -> DataFrame:
    """Union same-shaped per-platform tables, tagging the platform (A10).

    The reference scans one table per platform in a thread pool and skips the
    ones that fail or come back empty; here the union is one lazy plan, so
    Spark schedules the scans and an empty input simply contributes no rows.
    """
    tagged = [df.withColumn(platform_col, F.lit(p)) for p, df in frames.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if account is not None:
        out = out.withColumn("account", F.lit(account))
    return out


def union_blocks(own: DataFrame, comp: DataFrame, flag: str = "is_own") -> DataFrame:
    """Own rows + competitor rows as one block list, missing columns NULL."""
    return own.withColumn(flag, F.lit(1)).unionByName(
        comp.withColumn(flag, F.lit(0)), allowMissingColumns=True)
