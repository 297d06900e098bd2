"""Versioned tables and state that folds in only new days (A5-A7; D1, D10, H22).

A write goes to a folder of its own; the table changes only when a one-row commit, which names
the folders of the new version, appears beside it.  A job that fails half way, or a lost driver,
leaves no commit, so readers keep the version before.  Commits are written by Spark like any
file, so any store that Spark reads will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, folders array<string>, mark string"


class VersionedTable:
    """A table under ``root``: data/<id> folders and commits/<version>."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[Row]:
        """All commits, oldest first: one row per write."""
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.root}/commits/*").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def latest(self) -> Row | None:
        found = self.commits()
        return found[-1] if found else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or the one named; None if there is none.  Files with fewer columns
        read NULL in the others."""
        for c in reversed(self.commits()):
            if version in (None, c["version"]):
                return self.spark.read.option("mergeSchema", True).parquet(*c["folders"])
        return None

    def stage(self, df: DataFrame) -> str:
        """Write ``df`` beside the table; nobody reads it before a commit."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def commit(self, folders: Sequence[str], mark: str | None = None, after: int | None = None) -> int:
        """Make ``folders`` the next version.  ``after``: the version the writer started from; a
        commit by another writer since then, or at the same time, fails this one."""
        last = self.latest()
        now = last["version"] if last else 0
        if after is not None and after != now:
            raise RuntimeError(f"version {now} was committed since version {after} was read")
        row = self.spark.createDataFrame([(now + 1, list(folders), mark)], COMMIT).coalesce(1)
        row.write.mode("error").json(f"{self.root}/commits/{now + 1:020d}")
        return now + 1

    def overwrite(self, df: DataFrame) -> int:
        """Replace the rows; ``df`` may read the table itself."""
        last = self.latest()
        return self.commit([self.stage(df)], after=last["version"] if last else 0)

    def append(self, df: DataFrame) -> int:
        """Add rows, or create the table; new columns widen it."""
        last = self.latest()
        folder = self.stage(df)
        return self.commit([*(last["folders"] if last else []), folder], last["mark"] if last else None,
                           last["version"] if last else 0)


def new_days(facts: DataFrame, date_col: str, mark: str | None) -> DataFrame:
    """The facts after ``mark``: a plain comparison, so the scan reads those days only."""
    known = facts.where(F.col(date_col).isNotNull())
    return known if mark is None else known.where(F.col(date_col) > F.lit(mark).cast("date"))


def fold_days(table: VersionedTable, facts: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    """First and last day and number of rows per key, folded into ``table``; returns the state.

    Only days after the table's mark (the last day folded in) are read; the state has one row
    per key, however many days it stands for.  The mark is part of the commit, so a failed fold
    is simply done again.  Rows of a day that was folded in do not come late: a day counts when
    it is complete.  Rows without a day are ignored.
    """
    last = table.latest()
    mark = last["mark"] if last else None
    part = new_days(facts, date_col, mark).groupBy(*keys).agg(
        F.min(date_col).alias("first_seen"), F.max(date_col).alias("last_seen"), F.count("*").alias("n_rows"))
    if last:
        part = table.read(last["version"]).unionByName(part).groupBy(*keys).agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_rows").alias("n_rows"))
    folder = table.stage(part)
    state = table.spark.read.schema(part.schema).parquet(folder)
    upto = state.agg(F.max("last_seen")).first()[0]
    if upto is not None and str(upto) != mark:          # else there was no new day
        table.commit([folder], str(upto), last["version"] if last else 0)
    return state


def uploaded_till(state: DataFrame, keys: Sequence[str] = ("account", "gc_platform")) -> DataFrame:
    """Latest day per platform (D1), from the folded state."""
    return state.groupBy(*keys).agg(F.max("last_seen").alias("last_updated"))


def first_seen_between(state: DataFrame, start, end) -> DataFrame:
    """Keys first seen in [start, end] (D10), from the folded state."""
    return state.where(F.col("first_seen").between(F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end)))))
