"""Literal rows for rules that went wrong before."""

import datetime as dt

import pytest

L1 = ("2000-01-01", "2000-12-31")


def test_each_loss_counts_once(spark):
    from shelfpulse.plans.stores import psl_by, psl_by_store
    osa = spark.createDataFrame([("dr1", "a", "p", "7", "s"), ("dr2", "a", "p", "7", "s")],
                                "date_period string, account string, gc_platform string, product_id string, store_id string")
    psl = spark.createDataFrame([("a", "P", "7", "s", 10.0, dt.date(2000, 5, 1)), ("a", "P", "7", "s", 5.0, dt.date(1999, 5, 1))],
                                "account string, gc_platform string, product_id string, store_id string, "
                                "potential_sales_loss_mrp double, gc_crawl_date date")
    own = spark.createDataFrame([("7", 1)], "product_id string, is_own_brand int")
    rows = psl_by_store(osa, psl, own, L1)
    assert [(r.date_period, r.psl_mrp) for r in rows.collect()] == [("dr1", 10.0)]
    assert psl_by(rows, ["gc_platform"]).first().psl_mrp == 10.0


def test_no_platform_of_the_spine_is_missing(spark):
    from pyspark.sql import functions as F

    from shelfpulse.plans.report import on_spine, platform_markers, report_row, to_markers
    df = spark.createDataFrame([("a", "z", 1.0), ("a", "x", 2.0), ("b", "q", 3.0)], "account string, gc_platform string, v double")
    long = to_markers(on_spine(df, ["x", "y", "z"]), "1*", [F.col("place")], ["gc_platform", "v"], 3)
    got = {r["account"]: [r[f"1*{i}"] for i in range(1, 7)] for r in report_row(long, [f"1*{i}" for i in range(1, 7)]).collect()}
    assert got == {"a": ["x", "2.0", "y", "", "z", "1.0"], "b": ["x", "", "y", "", "z", ""]}
    drivers = spark.createDataFrame([("a", p, f"{p}{i}", -float(i)) for p in "xyz" for i in (1, 2, 3)],
                                    "account string, gc_platform string, bgr string, impact double")
    marks = {r["marker"]: r["value"] for r in platform_markers(
        drivers, {"x": "XD", "y": "YD", "z": "ZD"}, [F.col("impact").asc()], ["bgr", "impact"]).collect()}
    assert marks == {f"{p.upper()}D{s}_{f}": v for p in "xyz" for s, i in ((1, 3), (2, 2))
                     for f, v in ((1, f"{p}{i}"), (2, f"-{i}.0"))}


def test_competitors_of_each_tier(spark):
    """Two own brands of different tiers in one city get two competitors each."""
    from shelfpulse.plans.drilldown import rising_competitors
    key = "account string, gc_platform string, bgr string"
    own = spark.createDataFrame([("a", "p", "c", "city", t) for t in ("low", "high")], f"{key}, gc_city string, ppu_category string")
    comp = spark.createDataFrame([("a", "p", "c", "city", f"{t}{i}", float(10 * (t == "high") + i)) for t in ("low", "high") for i in (1, 2, 3)],
                                 f"{key}, gc_city string, brand string, pct_change double")
    tiers = spark.createDataFrame([("a", "p", "c", f"{t}{i}", t) for t in ("low", "high") for i in (1, 2, 3)],
                                  f"{key}, brand string, ppu_category string")
    got = {r.brand for r in rising_competitors(own, comp, tiers).collect()}
    assert got == {"low2", "low3", "high2", "high3"}


def test_share_change_keeps_its_decimals(spark):
    from shelfpulse.operators.periods import share_impact
    df = spark.createDataFrame([("dr1", "x", 5.123456, 1000.0, 1.0), ("dr2", "x", 2.0, 900.0, 1.0)],
                               "date_period string, k string, market_share double, category_size double, actual_sum double")
    assert share_impact(df, ["k"]).first().sales_impact == pytest.approx(31.23456, abs=1e-6)


def test_columns_that_start_like_a_blank_header_stay(spark, tmp_path):
    from shelfpulse.sources.sheets import read_sheet
    (tmp_path / "s.csv").write_text("_city,_c1,,b\nx,y,z,1\n")
    out = read_sheet(spark, str(tmp_path / "s.csv"))
    assert out.columns == ["_city", "_c1", "b"]


def test_a_read_error_does_not_overwrite(spark, tmp_path):
    from shelfpulse.sources.sinks import read_merged, write_or_append
    target = tmp_path / "t"
    df = spark.range(3)
    assert write_or_append(spark, df, str(target)) == "created"
    assert write_or_append(spark, df.withColumn("note", df.id.cast("string")), str(target)) == "widened"
    assert read_merged(spark, str(target)).count() == 6
    with pytest.raises(Exception, match="no_such_format"):
        write_or_append(spark, df, str(target), fmt="no_such_format")
    assert read_merged(spark, str(target)).count() == 6


def test_inverted_windows_are_refused(spark):
    from shelfpulse.operators.periods import filter_periods
    df = spark.createDataFrame([(dt.date(2000, 1, 1),)], "d date")
    with pytest.raises(ValueError):
        filter_periods(df, "d", ("2000-12-31", "2000-01-01"), ("1999-01-01", "1999-12-31"))
