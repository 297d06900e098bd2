"""Plan checks: window filters reach the scan, one fact scan per fused aggregate."""

from shelfpulse.checks.registry import L1, L2
from shelfpulse.operators.periods import filter_periods
from shelfpulse.plans import metrics as M
from shelfpulse.sources.views import Views

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_pushed_to_scan(spark):
    v = Views(spark, SMALL)
    li = v.table("lineitem")
    from pyspark.sql import functions as F
    d = filter_periods(li.withColumn("d", F.col("l_shipdate")), "l_shipdate", L1, L2).select("l_orderkey")
    plan = _plan(d)
    pushed = plan.split("PushedFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThanOrEqual(l_shipdate" in pushed


def test_brand_metrics_scans_facts_once(spark):
    v = Views(spark, SMALL)
    df = M.brand_metrics(v.pid_metrics(), v.product_dim(), L1, L2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 2   # one relation (path mentioned once per scan node)


def test_market_share_reads_only_needed_columns(spark):
    v = Views(spark, SMALL)
    df = M.market_share(v.pid_metrics(), v.product_dim(), L1, L2)
    plan = _plan(df)
    assert "l_comment" not in plan and "o_totalprice" not in plan


def test_shared_aggregates_are_read_instead_of_the_facts(spark):
    """Rows and group totals start from the written aggregate; no fact column is read again."""
    from shelfpulse.checks import registry
    registry.load_all()
    for key, fact in (("product_metrics", "l_partkey"), ("keyword_scores", "ad_impressions"), ("sku_osa", "total_scrapes")):
        plan = _plan(registry.QUERIES[key](spark, SMALL))
        schemas = [part.split(">")[0] for part in plan.split("ReadSchema: ")[1:]]
        assert schemas and not any(fact in s for s in schemas), key


def test_lineitems_are_joined_twice_and_laid_out_before_they_widen(spark, monkeypatch):
    """Customers are joined to the orders, not to the lineitems; the layout shuffles raw columns."""
    import re

    from shelfpulse.sources import layout
    v = Views(spark, SMALL)
    plan = v.base_facts()._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = {re.search(r"Join Inner, \((\w+)#", line).group(1): line.index("Join") for line in plan if "Join Inner, (" in line}
    assert joins["l_partkey"] < joins["l_orderkey"] < joins["o_custkey"]          # deeper and deeper in the tree
    hinted = []
    frame = type(v.base_facts())
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda d, *a: hinted.append(d.columns) or hint(d, *a))
    got = v.platform_months()
    assert layout.MONTH in hinted[0] and "l_extendedprice" in hinted[0] and "reported_offtake_mrp" not in hinted[0]
    assert sorted(got.columns) == sorted(v.pid_metrics().columns)
    cols = sorted(got.columns)
    assert got.select(cols).exceptAll(v.pid_metrics().select(cols)).isEmpty() and got.count() == v.pid_metrics().count()


def test_product_metrics_sums_partitions_of_bounded_size(spark):
    """The rows are rebalanced below the first sums, by columns that spread a crowded SKU."""
    v = Views(spark, SMALL)
    plan = M.product_metrics(v.pid_metrics(), None, L1, L2)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.split("\n") if "RebalancePartitions" in line]
    assert dealt and all("product_id" in line and "snapshot_date" in line for line in dealt)
