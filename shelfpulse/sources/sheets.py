"""Spreadsheet-like sources: header row + all-string cells, '' = missing (A3, A4)."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _headers(spark: SparkSession, paths: dict[str, str]) -> dict[str, list[str]]:
    """The header cells of every sheet, in one query: the first line with text of each file, from
    the file's first block.  Files of one sheet must have the same header."""
    tops = []
    for name, path in paths.items():
        lines = (spark.read.text(path)
                 .select("value", F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block"))
                 .withColumn("at", F.monotonically_increasing_id())
                 .where((F.col("block") == 0) & (F.trim("value") != "")))
        tops.append(lines.groupBy("file").agg(F.min_by("value", "at").alias("top"))
                    .select(F.lit(name).alias("sheet"), "top").distinct())
    found: dict[str, list[str]] = {name: [] for name in paths}
    for r in reduce(DataFrame.unionAll, tops).collect():         # one short line per sheet
        if found[r["sheet"]]:
            raise ValueError(f"files of sheet {r['sheet']!r} have different headers")
        found[r["sheet"]] = next(csv.reader([r["top"]], escapechar="\\"))
    return found


def _names(cells: list[str]) -> list[str | None]:
    """Trimmed column names; None where the header cell is blank.  A name that came before
    (in any case) gets its place appended."""
    out: list[str | None] = []
    for i, c in enumerate(cells):
        c = c.strip()
        seen = {n.lower() for n in out if n}
        out.append(None if not c else f"{c}{i}" if c.lower() in seen else c)
    return out


def _cell(c: str) -> Column:
    """The cell, NULL when it is blank."""
    return F.when(F.trim(F.col(f"`{c}`").cast("string")) == "", None).otherwise(F.col(f"`{c}`"))


def _filled(sheets: dict[str, DataFrame]) -> dict[str, list[str]]:
    """The columns of every sheet that have a value, in one query for all sheets."""
    rows = [d.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(d.columns)])
            .select(F.lit(name).alias("sheet"), F.array(*[f"n{i}" for i in range(len(d.columns))]).alias("n"))
            for name, d in sheets.items() if d.columns]
    counts = {r["sheet"]: r["n"] for r in reduce(DataFrame.unionAll, rows).collect()} if rows else {}
    return {name: [c for c, n in zip(d.columns, counts.get(name, [])) if n > 0] for name, d in sheets.items()}


def clean_sheet(df: DataFrame) -> DataFrame:
    """Trim header names, blank cells -> NULL, drop all-NULL rows, then drop
    all-NULL columns and columns with an empty header (A3).

    Finding all-NULL columns takes one ``count(col)`` aggregate (a one-row
    result); the column list is schema, not data.
    """
    named = [c for c in df.columns if c is not None and c.strip() != ""]
    d = df.select(*[_cell(c).alias(c.strip()) for c in named]).dropna(how="all")
    return d.select(*[F.col(f"`{c}`") for c in _filled({"": d})[""]])


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, every cell a string, cleaned as above (A3)."""
    return read_sheets(spark, {"": path})[""]


def read_sheets(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Every sheet of a workbook (a file or folder of files per sheet) into a dict, cleaned (A4).

    Two queries for the whole workbook, however many sheets: one reads all headers, one finds
    the columns with nothing in them.  The schemas are given, so no sheet is inferred.  A sheet
    without a line has no column.
    """
    rows = {}
    for name, cells in (_headers(spark, paths) if paths else {}).items():
        names = _names(cells)
        if not names:
            rows[name] = spark.createDataFrame([], StructType([]))
            continue
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        raw = spark.read.schema(schema).option("header", True).csv(paths[name])
        rows[name] = raw.select(*[_cell(f"c{i}").alias(n) for i, n in enumerate(names) if n]).dropna(how="all")
    return {name: rows[name].select(*[F.col(f"`{c}`") for c in keep]) for name, keep in _filled(rows).items()}


def union_sheets(sheets: dict[str, DataFrame], name_col: str = "sheet") -> DataFrame:
    """All sheets as one frame with the sheet name as a column (A4)."""
    tagged = [df.withColumn(name_col, F.lit(n)) for n, df in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
