"""Four-grain impacts, item mapping, default windows, layout pruning, blocks, mixed configs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shelfpulse.checks.registry import L1, L2
from shelfpulse.functions import text as T
from shelfpulse.operators import joins as J
from shelfpulse.operators import periods as P
from shelfpulse.plans import metrics as M
from shelfpulse.plans.impacts import share_impact_grains
from shelfpulse.sources import layout, tables
from shelfpulse.sources.views import Views

SMALL = "/root/testdata/sf0.001"
FACT = ("account string, snapshot_date date, gc_platform string, product_id string, gc_city string, brand string, "
        "is_own_brand int, reported_offtake_mrp decimal(12,2), normalized_offtake decimal(12,2), "
        "platform_offtake_uploaded_till date")
NEW, OLD, TILL = dt.date(2000, 5, 1), dt.date(1999, 5, 1), dt.date(2000, 11, 30)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fact(day, city, brand, own, value, product="p"):
    return ("a", day, "X", product, city, brand, own, value, value, TILL)


def money(rows):
    from decimal import Decimal
    return [(*r[:7], Decimal(r[7]), Decimal(r[8]), r[9]) for r in rows]


def test_grains_by_hand(spark):
    rows = [fact(OLD, "c1", "own", 1, 50), fact(OLD, "c1", "other", 0, 50),
            fact(OLD, "c2", "own", 1, 30), fact(OLD, "c2", "other", 0, 70),
            fact(NEW, "c1", "own", 1, 20), fact(NEW, "c1", "other", 0, 80),
            fact(NEW, "c2", "own2", 1, 60), fact(NEW, "c2", "other", 0, 40)]
    dim = spark.createDataFrame([("p", "Cat")], "product_id string, bgr string")
    got = {(r["grain"], r["gc_city"], r["brand"]): (r["share_dr1"], r["share_dr2"], r["size_dr1"], r["sales_impact"])
           for r in share_impact_grains(spark.createDataFrame(money(rows), FACT), dim, L1, L2).collect()}
    assert got == {
        ("category", None, None): (40.0, 40.0, 200.0, 0.0),
        ("city", "c1", None): (20.0, 50.0, 100.0, -30.0),
        ("city", "c2", None): (60.0, 30.0, 100.0, 30.0),
        ("brand", None, "own"): (10.0, 40.0, 200.0, -60.0),
        ("city_brand", "c1", "own"): (20.0, 50.0, 100.0, -30.0)}


def test_grains_keep_null_keys_and_empty_sizes(spark):
    rows = [fact(OLD, None, "own", 1, 0), fact(NEW, None, "own", 1, 0), fact(OLD, "c", None, 1, 5),
            fact(NEW, "c", None, 1, 5, "unlisted")]
    dim = spark.createDataFrame([("p", "Cat")], "product_id string, bgr string")
    got = share_impact_grains(spark.createDataFrame(money(rows), FACT), dim, L1, L2).collect()
    # the unlisted product has no category, so "c" has a partner in no grain; the NULL city is a key
    assert {(r["grain"], r["bgr"], r["gc_city"], r["brand"], r["share_dr1"]) for r in got} == {
        ("category", "cat", None, None, 0.0), ("city", "cat", None, None, 0.0),
        ("brand", "cat", None, "own", 0.0), ("city_brand", "cat", None, "own", 0.0)}
    empty = share_impact_grains(spark.createDataFrame([], FACT), dim, L1, L2)
    assert empty.count() == 0


def test_grains_scan_facts_once_and_have_unique_keys(spark):
    v = Views(spark, SMALL)
    df = share_impact_grains(v.pid_metrics(), v.product_dim(), L1, L2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate#") and plan.count("Expand") == 1
    assert sum("l_extendedprice" in line for line in plan.splitlines() if "Relation" in line) == 1
    keys = ["grain", "account", "gc_platform", "bgr", "gc_city", "brand"]
    assert df.count() == df.select(*keys).distinct().count() > 0


def test_grain_city_brand_equals_share_impact(spark):
    v = Views(spark, SMALL)
    keys = ["account", "gc_platform", "bgr", "gc_city", "brand"]
    ms = M.market_share(v.pid_metrics(), v.product_dim(), L1, L2).where(F.col("is_own_brand") == 1)
    want = {tuple(r) for r in P.share_impact(ms, keys).select(*keys, "pct_change", "sales_impact").collect()}
    got = share_impact_grains(v.pid_metrics(), v.product_dim(), L1, L2).where("grain = 'city_brand'")
    assert {tuple(r) for r in got.select(*keys, "pct_change", "sales_impact").collect()} == want


def test_mapping_taken_from_the_facts_keeps_every_product(spark):
    """A mapping derived from the facts shares their columns; unmapped products stay."""
    facts = Views(spark, SMALL).pid_metrics()
    mapping = facts.select("product_id", "gc_platform", F.concat(F.lit("i"), "product_id").alias("item_id"),
                           F.when(F.col("product_id").endswith("1"), "combo").otherwise("single").alias("type")).distinct()
    plain = M.product_metrics(facts, None, L1, L2)
    got = M.product_metrics(facts, mapping, L1, L2)
    assert got.drop("item_id").exceptAll(plain).isEmpty() and plain.exceptAll(got.drop("item_id")).isEmpty()
    want = F.when(~F.col("product_id").endswith("1"), F.concat(F.lit("i"), "product_id"))
    assert got.where(~F.col("item_id").eqNullSafe(want)).isEmpty()


def test_default_windows(spark):
    rows = [("a", dt.date(2024, 3, 10)), ("a", dt.date(2024, 2, 29)), ("a", dt.date(2024, 1, 30)),
            ("a", dt.date(2024, 1, 29)), ("b", dt.date(2023, 1, 1)), (None, dt.date(2020, 1, 5)), ("c", None)]
    df = spark.createDataFrame(rows, "account string, snapshot_date date")
    got = {r["account"]: tuple(r)[1:] for r in P.default_windows(df).collect()}
    assert got["a"] == (dt.date(2024, 3, 1), dt.date(2024, 3, 10), dt.date(2024, 1, 31), dt.date(2024, 2, 29))
    assert got["b"] == (dt.date(2023, 1, 1), dt.date(2023, 1, 1), dt.date(2022, 12, 2), dt.date(2022, 12, 31))
    assert None in got and "c" not in got
    labelled = {tuple(r) for r in P.label_default_windows(df).collect()}
    assert labelled == {("a", rows[0][1], "dr1"), ("a", rows[1][1], "dr2"), ("b", rows[4][1], "dr1"),
                        (None, rows[5][1], "dr1")}


def test_layout_prunes_months_and_platforms(spark, tmp_path):
    days = [dt.date(2000, m, 15) for m in range(1, 13)]
    df = spark.createDataFrame([(p, d, i) for i, d in enumerate(days) for p in ("x", "y", "z", None)],
                               "gc_platform string, snapshot_date date, v int")
    schema = layout.write_platform_months(df, str(tmp_path / "t"))
    enabled = spark.createDataFrame([("x", 1), ("y", 0)], "gc_platform string, live int")
    enabled.write.parquet(str(tmp_path / "dim"))
    live = spark.read.parquet(str(tmp_path / "dim")).where("live = 1")
    windows = (("2000-03-01", "2000-04-20"), ("2000-01-16", "2000-02-15"))
    got = layout.read_platform_months(spark, str(tmp_path / "t"), schema, windows, live)
    plan = _plan(got)
    filters = plan.split("PartitionFilters: [")[1].split("], ")[0]
    assert "month_key" in filters and "dynamicpruning" in filters
    rows = got.collect()
    assert {(r["gc_platform"], r["snapshot_date"].month) for r in rows} == {("x", 2), ("x", 3), ("x", 4)}
    every = layout.read_platform_months(spark, str(tmp_path / "t"), schema)
    assert every.select(*df.columns).exceptAll(df).isEmpty() and every.count() == df.count()


def test_platform_union_is_one_scan(spark):
    from shelfpulse.checks import registry
    registry.load_all()
    plan = registry.QUERIES["platform_union"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan


def test_blocks_fill_missing_columns(spark):
    own = spark.createDataFrame([("a", 1.0)], "brand string, sales_impact double")
    comp = spark.createDataFrame([("b",)], "brand string")
    assert sorted(map(tuple, tables.union_blocks(own, comp).select("brand", "sales_impact", "is_own").collect())) == [
        ("a", 1.0, 1), ("b", None, 0)]


def test_semi_join_filters_the_facts_by_a_bloom_filter(spark, tmp_path):
    """A large semi join gets a Bloom filter of the kept keys before the facts are shuffled."""
    spark.range(0, 20000).selectExpr("id AS k", "id % 7 AS v").write.parquet(str(tmp_path / "facts"))
    spark.range(0, 5000).selectExpr("id AS k", "id % 100 AS live").write.parquet(str(tmp_path / "dim"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        facts = spark.read.parquet(str(tmp_path / "facts"))
        dim = spark.read.parquet(str(tmp_path / "dim"))
        df = J.keep_valid(facts, dim, "k", F.col("live") == 3)
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 50
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("odd", [5, "text", None, [1], {"name": ["x"], "value": {"y": 1}}, {"value": True}])
def test_one_odd_entry_spoils_no_flag(spark, odd):
    good = {"name": "build_normalized_offtake_zepto", "value": True}
    cfg = json.dumps({"redshift": {"database": "db"}, "dbt": {"variables": [odd, good, odd]}})
    r = spark.createDataFrame([(cfg,)], "c string").select(*T.json_flags("c")).first()
    assert (r["name"], r["build_zepto"], r["build_blinkit"]) == ("db", True, False)


@pytest.mark.parametrize("text", [None, "", "{", "[]", "7", '{"dbt": 4}', '{"dbt": {"variables": {"name": 1}}}',
                                  '{"redshift": null}'])
def test_broken_configs_give_no_flags(spark, text):
    r = spark.createDataFrame([(text,)], "c string").select(*T.json_flags("c")).first()
    assert tuple(r) == ("", False, False, False)
