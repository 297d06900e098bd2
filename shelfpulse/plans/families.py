"""Report families (H15, H24, H25): the frames behind the marker blocks of one
account's report row, each still one row per platform, category or launch.

``plans.report`` flattens them to (account, marker, value) rows; every frame here
covers all accounts, so one job builds all reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpulse.plans.recommendations import psl_text
from shelfpulse.plans.summaries import CAT, py_num

# Fields of the marker blocks in the report's order, and the drainer
# block's field numbers (five is not used).
SUMMARY_FIELDS = ("offtake_text", "share_delta", "gainers", "drainers", "psl", "listing_pct", "new_stores")
OSA_FIELDS = ("name", "share_dr1", "pct_change", "wt_osa_dr1", "change_wt_osa", "potential_sales_loss",
              "top_geo", "recommendation")
SOV_FIELDS = ("name", "share_dr1", "pct_change", "sov_dr1_text", "change_sov_text", "rca", "recommendation")
DISCOUNT_FIELDS = ("name", "share_dr1", "pct_change", "wt_discounting_dr1", "change_wt_discounting",
                   "what_happened", "why_it_matters")
DRAINER_FIELDS = ("bgr", "impact", "ms", "geo_text", "gc_city", "what_happened1", "what_happened2",
                  "what_happened3", "recommendation")
DRAINER_NUMBERS = (1, 2, 3, 4, 6, 7, 8, 9, 10)
GAINER_FIELDS = ("bgr", "offtake", "ms", "geo_text", "what_worked")
LAUNCH_FIELDS = ("gc_platform", "bgr", "gc_city", "brand", "title", "osa", "share")


def report_summary(offtake: DataFrame, psl: DataFrame, coverage: DataFrame) -> DataFrame:
    """Platform summary with potential loss and new-store coverage.

    ``offtake`` is ``report.offtake_summary``, ``psl`` the current period's loss per
    platform, ``coverage`` the new stores per platform; a platform that the last two do
    not know keeps its row with those texts NULL (blank in the report).
    """
    on = ["account", "gc_platform"]
    d = (offtake.join(psl.select(*on, "psl_mrp"), on, "left")
         .join(coverage.select(*on, F.col("new_stores").alias("__n"), F.col("listed_in_new_stores").alias("__l")),
               on, "left"))
    share = py_num(F.try_divide(100 * F.col("psl_mrp"), F.col("offtake")))
    listed = F.rint(F.try_divide(100.0 * F.col("__l"), F.col("__n"))).cast("bigint").cast("string")
    x = F.col("offtake")
    return d.select(
        *on,
        F.when(x >= 1e7, F.concat(F.lit("₹"), py_num(x / 1e7), F.lit(" Cr ")))
         .otherwise(F.concat(F.lit("₹"), py_num(x / 1e5), F.lit(" L"))).alias("offtake_text"),
        "share_delta", "gainers", "drainers",
        F.concat(psl_text("psl_mrp"), F.lit("\n("), share, F.lit("% of offtake)")).alias("psl"),
        F.concat(listed, F.lit("%")).alias("listing_pct"),
        F.concat(F.lit("out of "), F.col("__n").cast("string"), F.lit(" stores")).alias("new_stores"))


def with_impact(rows: DataFrame, drivers: DataFrame) -> DataFrame:
    """The sales impact each driver's row is ranked by, and its ``category (platform)`` name."""
    d = drivers.select(*CAT, F.col("sales_impact").alias("rank_impact"))
    return rows.join(d, CAT).withColumn("name", F.concat("bgr", F.lit(" ("), "gc_platform", F.lit(")")))


def worst_first() -> list[Column]:
    return [F.col("rank_impact").asc_nulls_last(), F.col("gc_platform"), F.col("bgr"), F.col("brand")]


def best_first() -> list[Column]:
    return [F.col("rank_impact").desc_nulls_last(), F.col("gc_platform"), F.col("bgr"), F.col("brand")]


def recommended(rows: DataFrame, column: str = "recommendation") -> DataFrame:
    """Rows whose text says something."""
    return rows.where(F.trim(F.translate(F.coalesce(F.col(column), F.lit("")), "\n", " ")) != "")


def drainer_rows(merged: DataFrame, happened: DataFrame, impact: DataFrame) -> DataFrame:
    """Losing categories that have a merged recommendation, with what happened and their
    impact (C19): one row per account x platform x category x brand."""
    texts = happened.select(*CAT, "gc_city", *[f"what_happened{i}" for i in (1, 2, 3)])
    i = impact.select(*CAT, "geo_text", F.col("sales_impact").alias("rank_impact"),
                      F.concat(py_num(F.abs("sales_impact") / 100000), F.lit(" L")).alias("impact"),
                      F.concat(F.col("share_dr1").cast("string"), F.lit("% ("), py_num("pct_change"),
                               F.lit("%)")).alias("ms"))
    return texts.join(recommended(merged).select(*CAT, "recommendation"), CAT).join(i, CAT, "left")


def gainer_rows(gains: DataFrame, drivers: DataFrame) -> DataFrame:
    """Gaining categories; those whose "what worked" came out empty are left out, those
    without a brand row stay with a blank text."""
    return with_impact(gains, drivers).where(F.col("what_worked").isNull() | (F.col("what_worked") != ""))


def launch_rows(launches: DataFrame) -> DataFrame:
    """Availability and share texts of the new launches."""
    return launches.withColumns({
        "osa": F.concat(py_num("wt_osa_dr1"), F.lit("% ("), py_num("change_wt_osa"), F.lit("%)")),
        "share": F.concat(py_num("market_share_dr1"), F.lit("%"))})
