"""Property tests on the smallest driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfpulse.checks.registry import L1, L2
from shelfpulse.operators.periods import compare_periods, share_impact
from shelfpulse.plans import metrics as M
from shelfpulse.plans import stores as ST
from shelfpulse.plans import tiers as TR
from shelfpulse.sources.views import Views

SMALL = "/root/testdata/sf0.001"


def _views(spark):
    return Views.shared(spark, SMALL)


def test_unrounded_shares_add_up_to_100(spark):
    v = _views(spark)
    ms = M.market_share(v.pid_metrics(), v.product_dim(), L1, L2)
    # shares are rounded to 0.1: 25 brands per partition can drift by at most 25 * 0.05
    tot = ms.groupBy("date_period", "account", "gc_platform", "bgr", "gc_city").agg(
        F.sum("market_share").alias("s")).collect()
    assert tot and all(abs(r.s - 100) <= 1.3 or r.s == 0 for r in tot)


def test_period_swap_flips_every_impact_sign(spark):
    v = _views(spark)
    ms = M.market_share(v.pid_metrics(), v.product_dim(), L1, L2).where("is_own_brand = 1")
    keys = ["account", "gc_platform", "bgr", "gc_city", "brand"]
    a = share_impact(ms, keys).select(*keys, "pct_change")
    swapped = ms.withColumn("date_period", F.when(F.col("date_period") == "dr1", "dr2").otherwise("dr1"))
    b = share_impact(swapped, keys).select(*keys, F.col("pct_change").alias("pct_swapped"))
    rows = a.join(b, keys).collect()
    assert rows and all(abs(r.pct_change + r.pct_swapped) < 1e-9 for r in rows)


def test_compare_keeps_dr1_rows_when_keys_unique(spark):
    v = _views(spark)
    pm = M.product_metrics(v.pid_metrics(), None, L1, L2)
    keys = ["account", "gc_platform", "bgr", "gc_city", "brand", "product_id", "title"]
    n1 = pm.where("date_period = 'dr1'").select(*keys).distinct().count()
    assert compare_periods(pm, keys, ["wt_osa"]).count() == n1


def test_pareto_share_ends_at_one_and_never_falls(spark):
    v = _views(spark)
    spm = ST.store_period_metrics(v.locality_metrics(), L1, L2)
    t = ST.pareto_tags(spm.where(F.col("total_mtd_impact_pf") > 0))
    part = list(ST.PARETO_PART)
    w = Window.partitionBy(*part).orderBy("sku_rank_pf")
    d = t.withColumn("prev", F.lag("contribution_weight_pf").over(w))
    assert d.where(F.col("prev") > F.col("contribution_weight_pf")).count() == 0
    last = t.groupBy(*part).agg(F.max_by("contribution_weight_pf", "sku_rank_pf").alias("c")).collect()
    assert last and all(abs(r.c - 1.0) < 1e-9 for r in last)


def test_kmeans_tiers_ordered_and_disjoint(spark):
    v = _views(spark)
    tiers = TR.price_tiers(v.pid_metrics(), v.product_dim(), L1, method="auto")
    order = {"cost_effective": 0, "mid_range": 1, "premium": 2}
    b = tiers.groupBy("account", "gc_platform", "bgr", "ppu_category").agg(
        F.min("wt_ppu").alias("lo"), F.max("wt_ppu").alias("hi")).collect()
    groups = {}
    for r in b:
        groups.setdefault((r.account, r.gc_platform, r.bgr), []).append((order[r.ppu_category], r.lo, r.hi))
    for tiers_of in groups.values():
        tiers_of.sort()
        for (_, _, hi), (_, lo2, _) in zip(tiers_of, tiers_of[1:]):
            assert hi < lo2                      # higher tier starts above the lower tier's end


def test_report_row_has_full_marker_list(spark):
    from shelfpulse.checks import q_report
    row = q_report.q_report_row(spark, SMALL)
    assert row.columns == ["account", *q_report.MARKERS]
    assert row.count() == 1


def test_kmeans_tiers_match_brute_force(spark):
    """The distributed tiering equals a plain single-machine computation on the
    collected brand aggregate (small fixture)."""
    import math

    import numpy as np
    from test_tiers import kmeans_bins
    v = _views(spark)
    ppu = TR.brand_ppu(v.pid_metrics(), v.product_dim(), L1)
    got = {(r.gc_platform, r.bgr, r.brand): (r.ppu_category, r.ppu_lower_bound, r.ppu_upper_bound)
           for r in TR.price_tiers(v.pid_metrics(), v.product_dim(), L1, method="auto").collect()}
    rows = ppu.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.gc_platform, r.bgr), []).append((r.brand, r.wt_ppu))
    names = ["cost_effective", "mid_range", "premium"]
    expected = {}
    for (plat, bgr), items in groups.items():
        items.sort()
        x = np.array([p for _, p in items], dtype=float)
        if len(x) >= 3:
            z = np.log1p(np.clip(x, np.quantile(x, 0.05), np.quantile(x, 0.95)))
            codes = kmeans_bins(z, 3)
            cats = [names[k] for k in codes]
        else:
            q1, q2 = np.quantile(x, 1 / 3), np.quantile(x, 2 / 3)
            cats = [names[0] if p <= q1 else names[1] if p <= q2 else names[2] for p in x]
        by_cat = {}
        for (brand, p), cat in zip(items, cats):
            by_cat.setdefault(cat, []).append(p)
        for (brand, p), cat in zip(items, cats):
            expected[(plat, bgr, brand)] = (cat, float(math.floor(min(by_cat[cat]) / 5) * 5),
                                            float(math.ceil(max(by_cat[cat]) / 5) * 5))
    assert got == expected
