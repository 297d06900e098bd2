"""Literal-row tests for the NULL, rounding, period and rule semantics (FIXTURES part 2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfpulse.functions import exprs as X
from shelfpulse.functions import text as T
from shelfpulse.operators import periods as P
from shelfpulse.operators import windows as WN
from shelfpulse.plans import keywords as K
from shelfpulse.plans import tiers as TR


def d(s):
    return dt.date.fromisoformat(s)


def test_weight_null_rule(spark):
    df = spark.createDataFrame([(5.0, None, None), (5.0, None, 0.4)], "a double, l double, c double")
    out = df.select((F.col("a") * X.row_weight("l", "c")).alias("w")).collect()
    assert out[0].w is None
    assert out[1].w == 5.0


def test_cap_drops_null_till_and_clamps_months(spark):
    rows = [(d("2024-03-05"), None), (d("2024-02-29"), d("2024-03-31")), (d("2024-03-09"), d("2024-03-10")),
            (d("2024-03-11"), d("2024-03-10")), (d("2024-02-10"), d("2024-03-10")), (d("2024-02-11"), d("2024-03-10"))]
    df = spark.createDataFrame(rows, "snapshot_date date, till date")
    l1 = ("2024-03-01", "2024-03-31")
    l2 = ("2024-02-01", "2024-02-29")
    kept = {r.snapshot_date for r in P.filter_periods_capped(df, "snapshot_date", l1, l2, "till").collect()}
    assert d("2024-03-05") not in kept          # NULL cap drops the row (N1)
    assert d("2024-02-29") in kept              # Mar 31 - 1 month = Feb 29 (N11)
    assert d("2024-03-09") in kept and d("2024-03-11") not in kept
    assert d("2024-02-10") in kept and d("2024-02-11") not in kept


def test_overlapping_windows_label_order(spark):
    df = spark.createDataFrame([(d("2024-01-15"),)], "snapshot_date date")
    l1 = ("2024-01-01", "2024-01-31")
    l2 = ("2024-01-10", "2024-02-10")
    assert P.label_period(df, "snapshot_date", l1, l2, "dr1").first().date_period == "dr1"
    assert P.label_period(df, "snapshot_date", l1, l2, "dr2").first().date_period == "dr2"


def test_compare_keeps_dr1_only_and_matches_null_keys(spark):
    df = spark.createDataFrame(
        [("dr1", "a", None, 10.0), ("dr2", "a", None, 7.75), ("dr1", "b", "x", 3.0)],
        "date_period string, k1 string, k2 string, m double")
    out = {(r.k1, r.k2): r for r in P.compare_periods(df, ["k1", "k2"], ["m"]).collect()}
    assert out[("a", None)].change_m == 2.2      # 2.25 -> 2.2 (half to even), NULL keys matched
    assert out[("b", "x")].change_m is None       # key only in dr1 kept


def test_impact_drops_missing_dr2(spark):
    df = spark.createDataFrame(
        [("dr1", "a", 10.0, 1000.0, 1.0), ("dr2", "a", 8.0, 900.0, 1.0), ("dr1", "b", 5.0, 100.0, 1.0)],
        "date_period string, k string, market_share double, category_size double, actual_sum double")
    out = P.share_impact(df, ["k"]).collect()
    assert [r.k for r in out] == ["a"]
    assert out[0].pct_change == 2.0 and out[0].sales_impact == 20.0


def test_round_rules(spark):
    df = spark.createDataFrame([(0.25,), (4.9 / 4.0,)], "x double")
    r = df.select(X.sql_round("x", 1).alias("s"), X.pandas_round("x", 1).alias("p"),
                  X.pandas_round("x", 2).alias("p2")).collect()
    assert r[0].s == 0.3 and r[0].p == 0.2
    assert r[1].p2 == 1.23


def test_pareto_tags(spark):
    df = spark.createDataFrame([(v, f"s{i}") for i, v in enumerate([50.0, 30.0, 15.0, 5.0, 0.0])],
                               "impact double, sku string")
    df = df.withColumn("g", F.lit(1))
    out = WN.pareto_tags(df, ["g"], "impact", ["sku"]).orderBy("impact_rank").collect()
    assert [r.pareto_tag for r in out] == ["high", "high", "medium", "medium", "low"]
    neg = spark.createDataFrame([(-5.0, "a", 1)], "impact double, sku string, g int")
    assert WN.pareto_tags(neg, ["g"], "impact", ["sku"]).first().pareto_tag == "low"


def test_safe_division_and_zero_category(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    r = df.select(X.safe_div("a", "b").alias("q"), X.ratio_or_zero("a", "b").alias("z")).first()
    assert r.q is None and r.z == 0.0


def test_amount_and_change_text(spark):
    df = spark.createDataFrame([(12345678.0,), (123456.0,), (0.0,), (-250000.0,)], "x double")
    r = df.select(T.fmt_amount("x").alias("a"), T.fmt_change("x").alias("c")).collect()
    assert [x.a for x in r[:3]] == ["₹1.2 Cr ", "₹1.2 L", "₹0.0 L"]
    assert r[3].c == "(↓ ₹2.5 L)"


def test_relevance_zero_volume(spark):
    df = spark.createDataFrame([(5.0, 0.0)], "c double, v double")
    assert df.select(T.relevance("c", "v").alias("r")).first().r == 0.0


def test_keyword_recs(spark):
    rows = [("p", "k1", 3.0, 1.0, 2.0), ("p", "k2", 2.0, 1.0, 2.0), ("p", "k3", 1.0, 1.0, 2.0),
            ("q", "k4", 3.0, 5.0, 2.0), ("q", "k5", 2.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, keyword string, final_score double, sov_dr1 double, sov_dr2 double")
    out = {r.g: r.recommended_keywords for r in K.keyword_recs(df, ["g"]).collect()}
    assert out["p"] == ["k1", "k2"] and out["q"] == ["k4"]


def test_json_flags_broken(spark):
    df = spark.createDataFrame([("{",), ("{}",), ('{"dbt":{"variables":[{"name":"build_normalized_offtake_zepto","value":true}]},"redshift":{"database":"db1"}}',)], "c string")
    r = df.select(*T.json_flags("c")).collect()
    assert (r[0].name, r[0].build_zepto, r[0].build_blinkit) == ("", False, False)
    assert r[1].build_instamart is False
    assert (r[2].name, r[2].build_zepto, r[2].build_blinkit) == ("db1", True, False)


def test_quantile_tiers_two_brands(spark):
    from pyspark.sql import Row
    ppu = spark.createDataFrame([Row(account="a", gc_platform="p", bgr="c", brand="b1", is_own_brand=1, wt_ppu=10.0),
                                 Row(account="a", gc_platform="p", bgr="c", brand="b2", is_own_brand=0, wt_ppu=20.0)])
    out = TR.kmeans_tiers(ppu).collect()
    assert {r.binning_method for r in out} == {"quantile"}
    assert {r.brand: r.ppu_category for r in out} == {"b1": "cost_effective", "b2": "premium"}


@pytest.mark.parametrize("month", [13, 0])
def test_html_month_argument(spark, month):
    from shelfpulse.sources.pages import extract_table_rows
    df = spark.createDataFrame([("<table></table>",)], "html string")
    with pytest.raises(ValueError):
        extract_table_rows(df, 2024, month)


def test_ranked_running_share_matches_plain_window(spark):
    from shelfpulse.operators.windows import ranked_running_share, rank_in, running_share
    rows = [(None if i % 7 == 0 else f"g{i % 3}", float((i * 37) % 11) if i % 5 else None, f"k{i}")
            for i in range(120)]
    df = spark.createDataFrame(rows, "g string, v double, k string").selectExpr(
        "*", "cast(v as decimal(10,2)) as dv")
    order = [F.col("v").desc_nulls_first(), F.col("k").asc_nulls_last()]
    plain = running_share(rank_in(df, ["g"], order, "r"), ["g"], order, "dv", "c")
    split = ranked_running_share(df, ["g"], "v", "dv", ["k"], buckets=4, rank_out="r2", cum_out="c2")
    a = {(r.g, r.k): (r.r, r.c) for r in plain.collect()}
    b = {(r.g, r.k): (r.r2, r.c2) for r in split.collect()}
    assert a.keys() == b.keys()
    for key, (r, c) in a.items():
        r2, c2 = b[key]
        assert r == r2
        assert (c is None and c2 is None) or abs(c - c2) < 1e-12


def test_salted_top_k_is_exact(spark):
    from shelfpulse.operators.topk import top_k
    rows = [(f"g{i % 2}", float((i * 53) % 17), f"k{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, k string")
    order = [F.col("v").desc(), F.col("k").asc()]
    a = sorted(tuple(r) for r in top_k(df, ["g"], order, 3).collect())
    b = sorted(tuple(r) for r in top_k(df, ["g"], order, 3, salt=8).collect())
    assert a == b


HTML_TABLE = """
<table><thead><tr><th>January 2024</th></tr></thead><tbody>
<tr><td>26 Friday</td><td>Republic Day</td></tr>
<tr><td>14 Sunday</td><td><b>Makar</b> Sankranti</td></tr>
</tbody></table>
<table><thead><tr><th>February</th></tr></thead><tbody>
<tr><td>31 Saturday</td><td>Not a day</td></tr>
<tr><td>14 Wednesday</td><td>Vasant Panchami</td></tr>
</tbody></table>"""

DAY_CELLS = """
<td class="single-day" data-date="2024-03-25"><div class="holidayCal">Holi</div></td>
<td class="single-day" data-date="2024-03-26"><div class="holidayCal"> </div></td>
<td class="single-day" data-date="not-a-date"><div class="holidayCal">Bad</div></td>"""


def test_html_month_tables(spark):
    from shelfpulse.sources.pages import extract_table_rows
    df = spark.createDataFrame([(HTML_TABLE,)], "html string")
    rows = [(r.date.isoformat(), r.name) for r in extract_table_rows(df, 2024).collect()]
    assert rows == [("2024-01-14", "Makar Sankranti"), ("2024-01-26", "Republic Day"),
                    ("2024-02-14", "Vasant Panchami")]          # 31 February skipped, sorted
    feb = [r.name for r in extract_table_rows(df, 2024, 2).collect()]
    assert feb == ["Vasant Panchami"]


def test_html_day_cells(spark):
    from shelfpulse.sources.pages import extract_day_cells
    df = spark.createDataFrame([(DAY_CELLS,)], "html string")
    rows = [(r.date.isoformat(), r.name) for r in extract_day_cells(df).collect()]
    assert rows == [("2024-03-25", "Holi")]                     # blank name and bad date dropped


def test_merge_recommendations_moves_restore_lines(spark):
    from shelfpulse.plans.recommendations import merge_recommendations
    rows = [("Sov Recommendation:\n• Soap: Restore OSA to 95.0% to improve organic SOV\n• Increase Ad SOV on “x” KWs",
             "OSA Recommendations:\n- Soap:\n• Fix DS listing in 7 stores in Pune"),
            ("Sov Recommendation:\n• Gel: Restore OSA to 90.0% to improve organic SOV",
             "OSA Recommendations:\n- Soap:\n• Fix DS listing in 7 stores in Pune"),
            ("Sov Recommendation:", "OSA Recommendations:")]
    df = spark.createDataFrame(rows, "recommendation_sov string, recommendation_osa string")
    out = merge_recommendations(df).collect()
    assert len(out) == 2                                        # header-only blocks dropped
    assert out[0].recommendation_osa.endswith("• Restore OSA to 95.0% to improve organic SOV")
    assert out[0].recommendation_sov == "Sov Recommendation:\n• Increase Ad SOV on “x” KWs"
    assert out[1].recommendation_osa.endswith("- Gel: Restore OSA to 90.0% to improve organic SOV")
    assert out[1].recommendation_sov is None                   # only its header was left


def test_sheet_cleaning(spark, tmp_path):
    from shelfpulse.sources.sheets import read_sheet
    p = tmp_path / "s.csv"
    p.write_text(" a ,b,,c\n1,,, \n,,,\n2,x,,\n")
    out = read_sheet(spark, str(p))
    assert out.columns == ["a", "b"]                            # trimmed; blank-header and all-blank columns dropped
    assert [tuple(r) for r in out.collect()] == [("1", None), ("2", "x")]   # all-blank row dropped


def test_template_render(spark):
    from shelfpulse.plans.report import render_templates
    t = spark.createDataFrame([("a", 1, "Hi {{ Brand }}, {{m1}} {{nope}}"), ("a", 2, "{{nope}}"),
                               ("a", 3, "no keys")], "account string, slide_id int, text string")
    v = spark.createDataFrame([("a", "Brand", "Acme"), ("a", "m1", "May")], "account string, marker string, value string")
    out = {r.slide_id: r for r in render_templates(t, v).collect()}
    assert out[1].rendered == "Hi Acme, May " and out[1].keep
    assert out[2].rendered == "" and not out[2].keep            # every placeholder blank -> dropped
    assert out[3].keep                                          # no placeholders -> kept
    kept = {r.slide_id: r.rendered for r in render_templates(t, v, leave_missing=True).collect()}
    assert kept[1] == "Hi Acme, May {{nope}}"


def test_template_render_odd_rows(spark):
    """Slides that come twice are one slide, values that come twice are both shown, NULL texts make
    no slide, NULL accounts and NULL values have no value."""
    from shelfpulse.plans.report import render_templates
    t = spark.createDataFrame([("a", 1, "x {{m}} y"), ("a", 1, "x {{m}} z"), ("a", 2, "{{two}}."), ("a", 3, None),
                               (None, 4, "{{m}}"), ("b", 5, "{{m}}"), ("a", 6, "{{null}}"), ("a", None, "n {{m}}"), ("a", 7, "")],
                              "account string, slide_id int, text string")
    v = spark.createDataFrame([("a", "m", "M"), ("a", "two", "1"), ("a", "two", "2"), ("a", "null", None), (None, "m", "no"),
                               ("a", None, "no")], "account string, marker string, value string")
    out = {(r.account, r.slide_id): (r.rendered, r.keep) for r in render_templates(t, v, leave_missing=True).collect()}
    assert out == {("a", 1): ("x Mx M y z", True), ("a", 2): ("12.", True), (None, 4): ("{{m}}", False), ("b", 5): ("{{m}}", False),
                   ("a", 6): ("{{null}}", False), ("a", None): ("n M", True), ("a", 7): ("", True)}


def test_template_render_deals_texts_by_slide(spark):
    """Texts are filled row by row in the tasks of their slides: none is exploded, and none is
    dealt by marker, of which there are few."""
    from shelfpulse.plans.report import render_templates
    t = spark.createDataFrame([("a", 1, "x {{m}}")], "account string, slide_id int, text string")
    v = spark.createDataFrame([("a", "m", "M")], "account string, marker string, value string")
    plan = render_templates(t, v)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression [account" in plan
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "marker" not in joins[0]


def test_osa_rule_lines(spark):
    from shelfpulse.plans.recommendations import osa_recommendations
    key = ("a", "p", "c", "B1")
    brand_rows = spark.createDataFrame([(*key, 40.0, -10.0)],
                                       "account string, gc_platform string, bgr string, brand string, "
                                       "wt_osa_dr1 double, change_wt_osa double")
    drivers = spark.createDataFrame([(*key, 5.0, -2.0, -200000.0)],
                                    "account string, gc_platform string, bgr string, brand string, "
                                    "share_dr1 double, pct_change double, sales_impact double")
    cat = spark.createDataFrame([(*key, 1, 41.0, -9.0)],
                                "account string, gc_platform string, bgr string, brand string, "
                                "is_own_brand int, wt_osa_dr1 double, change_wt_osa double")
    cities = spark.createDataFrame([(*key, 1, "Pune", -150000.0), (*key, 2, "Goa", -30000.0)],
                                   "account string, gc_platform string, bgr string, brand string, "
                                   "city_rank bigint, gc_city string, sales_impact double")
    psl = spark.createDataFrame([("a", "p", "c", "Pune", "s1", "Soap", 120000.0),
                                 ("a", "p", "c", "Pune", "s2", "Gel", 5000.0)],
                                "account string, gc_platform string, bgr string, gc_city string, "
                                "product_id string, title string, psl_mrp double")
    counts = spark.createDataFrame([("a", "p", "c", "Pune", "s1", "Soap", 12, 4)],
                                   "account string, gc_platform string, bgr string, gc_city string, "
                                   "product_id string, title string, high_psl_stores bigint, listed_in bigint")
    doi = spark.createDataFrame([("a", "p", "c", "Pune", "s1", 3.0, 1.0)],
                                "account string, gc_platform string, bgr string, gc_city string, "
                                "product_id string, backend_doi double, frontend_doi double")
    r = osa_recommendations(brand_rows, drivers, cat, cities, psl, counts, doi).first()
    assert r.top_geo == "Pune (75%) , Goa (15%)"
    assert r.what_happened.startswith("OSA dropped from 50% to 40.0%")
    assert r.potential_sales_loss == "₹1.2 L"
    assert r.recommendation == ("OSA Recommendations:\n- Soap:\n"
                                "• Fix DS listing in 8 stores in Pune\n"
                                "• Stock-out risk, Only 3.0 days of stock left in Pune; "
                                "backend inventory needs to be refilled\n")
    # no rule fires -> blank block
    quiet = doi.withColumn("backend_doi", F.lit(9.0)).withColumn("frontend_doi", F.lit(5.0))
    calm = counts.withColumn("listed_in", F.lit(10).cast("bigint"))
    assert osa_recommendations(brand_rows, drivers, cat, cities, psl, calm, quiet).first().recommendation == ""


def test_group_totals_equal_window_sums(spark):
    from pyspark.sql import Window

    from shelfpulse.operators.windows import with_group_totals
    rows = [(None if i % 5 == 0 else f"g{i % 3}", f"k{i}", i * 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k string, v double").selectExpr(
        "*", "cast(v as decimal(10,2)) as dv")
    a = {r.k: r.t for r in df.withColumn("t", F.sum("dv").over(Window.partitionBy("g"))).collect()}
    b = {r["k"]: r["__tot_dv"] for r in with_group_totals(df, ["g"], ["dv"]).collect()}
    assert a == b                                 # NULL keys form one group, as in a window
