"""Sinks (A5-A7): overwrite, append, create-or-append.

The reference's "upsert" appends below existing rows (no key matching), so
``write_or_append`` is create-or-append, not MERGE.  Writes are Spark jobs:
each task writes its own part file, so a lost executor's task is retried and
the commit protocol keeps the output whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def _exists_non_empty(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    try:
        cur = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        # only a missing or empty path is the "create" case; any other error must not overwrite
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return cur if cur.columns and not cur.isEmpty() else None


def write_or_append(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Full write when the target is missing or empty, else append.

    New columns are appended with their schema; nothing is rewritten.  Read such
    a table with ``read_merged``.  Returns the action taken.
    """
    cur = _exists_non_empty(spark, path, fmt)
    if cur is None:
        write_table(df, path, "overwrite", fmt)
        return "created"
    if set(df.columns) <= set(cur.columns):
        write_table(df.select(*[c for c in cur.columns if c in df.columns]), path, "append", fmt)
        return "appended"
    write_table(df, path, "append", fmt)
    return "widened"


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose files may have different columns; missing ones read as NULL."""
    return spark.read.option("mergeSchema", True).parquet(path)
