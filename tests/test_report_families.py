"""Literal rows for the report's marker families."""

from pyspark.sql import functions as F

CAT = "account string, gc_platform string, bgr string, brand string"


def test_numbers_without_a_value_print_nothing(spark):
    from shelfpulse.functions.text import fixed
    from shelfpulse.plans.recommendations import psl_text
    from shelfpulse.plans.summaries import py_num
    r = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 1.25D AS y").select(
        py_num("x"), fixed("x"), psl_text("x"), py_num("y"), psl_text("y")).first()
    assert list(r) == [None, None, None, "1.2", "₹0.0 L"]


def test_summary_has_loss_and_coverage(spark):
    from shelfpulse.plans.families import report_summary
    off = spark.createDataFrame([("a", "x", 2e7, "(↑ ₹1.0 L)", "g", "d"), ("a", "y", 5e5, "(↓ ₹1.0 L)", "", "")],
                                "account string, gc_platform string, offtake double, share_delta string, gainers string, drainers string")
    psl = spark.createDataFrame([("a", "x", 3e5)], "account string, gc_platform string, psl_mrp double")
    cover = spark.createDataFrame([("a", "x", 8, 3), ("a", "y", 0, 0)],
                                  "account string, gc_platform string, new_stores long, listed_in_new_stores long")
    got = {r.gc_platform: r for r in report_summary(off, psl, cover).collect()}
    x, y = got["x"], got["y"]
    assert (x.offtake_text, x.psl, x.listing_pct, x.new_stores) == ("₹2.0 Cr ", "₹3.0 L\n(1.5% of offtake)", "38%", "out of 8 stores")
    assert (y.offtake_text, y.psl, y.listing_pct, y.new_stores) == ("₹5.0 L", None, None, "out of 0 stores")


def test_drainers_need_a_recommendation_and_keep_their_numbers(spark):
    from shelfpulse.plans import families as FA
    from shelfpulse.plans.report import platform_markers
    merged = spark.createDataFrame([("a", "x", "c1", "b", "do it"), ("a", "x", "c2", "b", "\n"), ("a", "x", "c3", "b", None)],
                                   f"{CAT}, recommendation string")
    happened = spark.createDataFrame([("a", "x", f"c{i}", "b", "city", "w1", None, "w3") for i in (1, 2, 3)],
                                     f"{CAT}, gc_city string, what_happened1 string, what_happened2 string, what_happened3 string")
    impact = spark.createDataFrame([("a", "x", f"c{i}", "b", "geo", -250000.0, 5.5, -1.25) for i in (1, 2, 3)],
                                   f"{CAT}, geo_text string, sales_impact double, share_dr1 double, pct_change double")
    rows = FA.drainer_rows(merged, happened, impact)
    marks = {r.marker: r.value for r in platform_markers(rows, {"x": "XD"}, FA.worst_first(), FA.DRAINER_FIELDS,
                                                         numbers=FA.DRAINER_NUMBERS).collect()}
    assert marks == {"XD1_1": "c1", "XD1_2": "2.5 L", "XD1_3": "5.5% (-1.2%)", "XD1_4": "geo", "XD1_6": "city",
                     "XD1_7": "w1", "XD1_8": "", "XD1_9": "w3", "XD1_10": "do it"}


def test_gainers_without_a_line_are_left_out(spark):
    from shelfpulse.plans.families import gainer_rows
    gains = spark.createDataFrame([("a", "x", "c1", "b", ""), ("a", "x", "c2", "b", None), ("a", "x", "c3", "b", "• ok")],
                                  f"{CAT}, what_worked string")
    drivers = spark.createDataFrame([("a", "x", f"c{i}", "b", float(i)) for i in (1, 2, 3)], f"{CAT}, sales_impact double")
    assert sorted(r.bgr for r in gainer_rows(gains, drivers).collect()) == ["c2", "c3"]


def test_launch_texts(spark):
    from shelfpulse.plans.families import LAUNCH_FIELDS, launch_rows
    from shelfpulse.plans.report import to_markers
    rows = spark.createDataFrame([("a", p, "c", "city", "b", "t", 80.0, 12.34, 3.25) for p in ("z", "x", "y")],
                                 "account string, gc_platform string, bgr string, gc_city string, brand string, title string, "
                                 "wt_osa_dr1 double, change_wt_osa double, market_share_dr1 double")
    got = {r.marker: r.value for r in to_markers(launch_rows(rows), "NL_", [F.col("gc_platform")], LAUNCH_FIELDS, 2).collect()}
    assert [got[f"NL_{i}"] for i in range(1, 15)] == ["x", "c", "city", "b", "t", "80.0% (12.3%)", "3.2%",
                                                      "y", "c", "city", "b", "t", "80.0% (12.3%)", "3.2%"]


def test_every_marker_has_one_name():
    from shelfpulse.checks.q_report import MARKERS, PLATFORMS
    n = len(PLATFORMS)
    assert len(MARKERS) == len(set(MARKERS)) == 3 + 7 * n + 16 + 14 + 14 + 18 * n + 10 * n + 14


def test_kmeans_drilldown_uses_the_kmeans_tiers(spark):
    from shelfpulse.checks import registry
    registry.load_all()
    small = "/root/testdata/sf0.001"
    key = ["account", "gc_platform", "bgr", "brand"]
    tiers = {tuple(r[k] for k in key): r.ppu_category for r in registry.QUERIES["price_tier_kmeans"](spark, small).collect()}
    rows = registry.QUERIES["drilldown_down_kmeans"](spark, small).collect()
    plain = registry.QUERIES["drilldown_down"](spark, small)
    assert rows and all(r.ppu_category == tiers.get(tuple(r[k] for k in key)) for r in rows)
    drop = [c for c in ("ppu_category", "wt_ppu") if c in plain.columns]
    as_rows = lambda rs, cols: sorted(str([r[c] for c in cols]) for r in rs)
    cols = [c for c in plain.columns if c not in drop]
    assert as_rows(rows, cols) == as_rows(plain.collect(), cols)
