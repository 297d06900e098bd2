"""SparkSession settings shared by tests, the bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates, ANSI arithmetic (division by zero must
# go through try_divide), adaptive execution for shuffle-partition coalescing and
# skew-join splitting at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfpulse") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster the master and shuffle partitions come from spark-submit; the
    arguments are only for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        # local runs only: the whole job lives in the driver JVM
        builder = builder.master(master).config("spark.driver.memory", "16g")
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared (distributed) folder: without one this fails. Only a
    local session, whose executors are this machine, gets a temporary folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="shelfpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def written(df: DataFrame) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: it is worked out once,
    and a lost executor re-reads files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/derived/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
