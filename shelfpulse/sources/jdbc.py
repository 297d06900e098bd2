"""Relational-database source (A2): one reader for every connection URL.

With ``partition_col`` and bounds the read is split into ``num_partitions``
range queries running in parallel tasks; without it the query runs as one
task (fine for the small configuration tables the reference reads this way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              partition_col: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 8, properties: dict | None = None) -> DataFrame:
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_col:
        src = table if table else f"({query}) q"
        r = (r.option("dbtable", src).option("partitionColumn", partition_col)
             .option("lowerBound", lower).option("upperBound", upper)
             .option("numPartitions", num_partitions))
    elif query:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    return r.load()
