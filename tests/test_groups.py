"""The report's lookups: whole groups of its drivers, and no others."""

import datetime as dt

from pyspark.sql import functions as F

L1, L2 = ("2000-01-01", "2000-12-31"), ("1999-01-01", "1999-12-31")
CAT = ["account", "gc_platform", "bgr"]
WHERE = [*CAT, "gc_city"]


def test_kept_groups_are_whole_and_null_matches_nothing(spark):
    from shelfpulse.operators.joins import keep_groups
    rows = [("a", "P", 1), ("a", "p", 2), ("a", "p", 2), ("a", "q", 4), (None, "p", 8), ("a", None, 16)]
    df = spark.createDataFrame(rows, "account string, gc_platform string, v int")
    wanted = spark.createDataFrame([("a", "p"), ("a", "p"), (None, "p"), ("a", None)], "account string, gc_platform string")
    keys = ["account", "gc_platform"]
    assert sorted(r.v for r in keep_groups(df, wanted, keys).collect()) == [2, 2]
    read = keep_groups(df, wanted, keys, {"gc_platform": F.lower("gc_platform")})
    assert read.columns == df.columns and sorted(r.v for r in read.collect()) == [1, 2, 2]


class _Rows:
    """The views the recommendation blocks read, from literal rows."""

    def __init__(self, slices, psl):
        self.slices, self.psl = slices, psl

    def window_slice(self, view, l1, l2):
        return self.slices[view]

    def materialize(self, key, build):
        return self.psl if key[0] == "psl_rows" else self.slices.get(key[0], None) if key[0] in self.slices else build()

    pid_slice = product_dim = lambda self, *_: None


def _inputs(spark, slices, psl):
    from shelfpulse.checks.q_recs import Inputs
    i = object.__new__(Inputs)
    i.v = _Rows(slices, psl)
    i.fr = {"brand_rows": spark.createDataFrame([("a", "p", "soap", "x", "B", -1.0)],
                                                "account string, gc_platform string, bgr string, gc_city string, brand string, change_sov double")}
    i.dim = spark.createDataFrame([("7", "B", 1), ("8", "C", 0)], "product_id string, brand string, is_own_brand int")
    return i


def test_brand_changes_are_those_of_the_drivers_groups(spark):
    from shelfpulse.operators.periods import compare_periods
    from shelfpulse.plans import keywords as K
    day = {1: dt.date(2000, 5, 1), 2: dt.date(1999, 5, 1)}
    rows = [("a", day[d], p, g, c, k, b, n) for d in (1, 2) for p in "Ppq" for g in ("soap", "gel") for c in "xy"
            for k in ("k1", "k2") for b, n in (("B", 3 * d), ("C", 5), ("D", 2))]
    kw = spark.createDataFrame(rows, "account string, snapshot_date date, gc_platform string, bgr string, gc_city string, "
                                     "keyword string, brand string, ad_impressions int")
    totals = spark.createDataFrame([], "date_period string, account string, gc_platform string, bgr string, gc_city string, "
                                       "keyword string, ad_sov double, cat_share double, vol_share double")
    i = _inputs(spark, {"keyword_impressions": kw, "kwt": totals, "kw_scores": totals.withColumn(
        "final_score", F.lit(0.0)).withColumns({"sov_dr1": F.lit(0.0), "sov_dr2": F.lit(0.0)})}, None)
    got = i.keyword_frames()[3]
    keys = ["account", "gc_platform", "bgr", "brand", "keyword", "gc_city"]
    # read in full and then looked up
    whole = compare_periods(K.keyword_brand_sov(kw, i.dim, L1, L2), keys, ["ad_sov"]).join(i.fr["brand_rows"], WHERE, "left_semi")
    want = sorted(map(tuple, whole.select(*got.columns).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 6


def test_days_and_losses_are_those_of_the_drivers_categories(spark):
    psl = spark.createDataFrame([("a", p, g, c, "7", "t", f"l{n}", 2.0, 1, "high") for p in "pq" for g in ("soap", "gel") for c in "xy" for n in (1, 2)],
                                "account string, gc_platform string, bgr string, gc_city string, product_id string, title string, "
                                "locality string, psl_mrp double, total_listed int, psl_tags_pf string")
    doi = spark.createDataFrame([("a", dt.date(2000, 5, 1), p, g, c, "7", float(n), 2.0 * n) for p in "pq" for g in ("Soap", "gel") for c in "xy" for n in (1, 2)],
                                "account string, snapshot_date date, gc_platform string, bgr string, gc_city string, product_id string, "
                                "backend_doi_value double, frontend_doi_value double")
    losses, counts, days = _inputs(spark, {"facility_doi": doi}, psl).store_frames()
    assert {tuple(r) for r in losses.select(*CAT).collect()} == {("a", "p", "soap")} and losses.count() == 4
    assert sorted((r.gc_city, r.high_psl_stores, r.listed_in) for r in counts.collect()) == [("x", 2, 2), ("y", 2, 2)]
    assert sorted((r.bgr, r.gc_city, r.backend_doi, r.frontend_doi) for r in days.collect()) == [("soap", "x", 2.0, 3.0), ("soap", "y", 2.0, 3.0)]
