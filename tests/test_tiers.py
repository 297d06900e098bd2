"""Exact group quantiles and k-means tiers against single-machine computations."""

import random

import numpy as np
import pandas as pd
import pytest

from shelfpulse.operators.selection import group_quantiles
from shelfpulse.plans import tiers as TR

PROBS = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]


def kmeans_bins(z, bins):
    """Bin numbers of one group: Lloyd steps from bin middles, an empty cluster takes the value
    farthest from its centre, stop by the tolerance; cuts at midpoints of the sorted centres."""
    z = np.round(np.asarray(z, float), 12)
    lo, hi = z.min(), z.max()
    c = lo + (hi - lo) * (2 * np.arange(bins) + 1) / (2 * bins)
    for _ in range(300):
        c = np.sort(c)
        lab = np.searchsorted((c[1:] + c[:-1]) / 2, z, side="left")
        n = np.bincount(lab, minlength=bins).astype(float)
        s = np.bincount(lab, z, bins)
        empty = np.flatnonzero(n == 0)
        far = np.round(np.abs(z - c[lab]), 9)
        new = np.where(n > 0, s / np.where(n > 0, n, 1), c)
        if len(empty) and far.max() > 0:
            i = min(np.flatnonzero(far == far.max()), key=lambda j: z[j])
            j = lab[i]
            new[empty[0]] = z[i]
            new[j] = (s[j] - z[i]) / (n[j] - 1) if n[j] > 1 else c[j]
        shift = ((new - c) ** 2).sum()
        c = new
        if shift <= 1e-4 * z.var():
            break
    c = np.sort(c)
    edges = np.r_[lo, (c[1:] + c[:-1]) / 2, hi]
    edges = edges[np.ediff1d(edges, to_begin=np.inf) > 1e-8]
    return np.searchsorted(edges[1:-1], z, side="right")


@pytest.mark.parametrize("small", [50_000, 300, 20])
def test_quantiles_by_narrowing_equal_pandas(spark, small):
    rng = np.random.default_rng(1)
    g = rng.choice(["hot", "b", "none"], 3000, p=[.7, .2, .1])
    v = np.where(rng.random(3000) < .5, 7.0, rng.lognormal(2, 3, 3000))      # half of the rows tie
    v[rng.random(3000) < .05] = np.nan
    rows = [(None if a == "none" else a, None if b != b else float(b)) for a, b in zip(g, v)] + [("null", None), ("one", 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r[0]: tuple(r)[1:] for r in group_quantiles(df, ["g"], "v", PROBS, small=small).collect()}
    assert set(got) == {"hot", "b", None, "null", "one"}
    for key in got:
        want = pd.Series([b for a, b in rows if a == key and b is not None], dtype=float).quantile(PROBS)
        for a, b in zip(got[key], want):
            assert (a is None and b != b) or a == pytest.approx(b, rel=1e-12)


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert group_quantiles(df, ["g"], "v", [0.5]).collect() == []


def test_quantiles_hold_no_group_in_a_buffer(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id * 1.0 AS v")
    out = group_quantiles(df, ["g"], "v", [0.5], small=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_" not in plan
    assert [r[1] for r in out.orderBy("g").collect()] == [499.5, 499.0, 500.0]


def test_kmeans_of_known_groups(spark):
    groups = {"three levels": [10, 11, 12, 50, 52, 55, 200, 210, 220], "empty middle": [10, 11, 100], "two values": [10, 10, 10, 80, 80],
              "flat": [5, 5, 5, 5], "far apart": [1, 2, 3, 5000, 9000, 9001], "zero": [0, 0, 3, 9, 9], "wide": [1, 10, 100, 1000, 10000],
              "few": [10, 20]}
    rng = random.Random(4)
    groups |= {f"random {i}": [float(rng.choice([rng.randint(1, 30), rng.randint(100, 999)])) for _ in range(rng.randint(3, 25))]
               for i in range(40)}
    rows = [("a", "p", None if k == "flat" else k, f"b{i:02d}", 0, float(x)) for k, xs in groups.items() for i, x in enumerate(xs)]
    ppu = spark.createDataFrame(rows, "account string, gc_platform string, bgr string, brand string, is_own_brand int, wt_ppu double")
    got = {(r.bgr, r.brand): (r.binning_method, r.ppu_category) for r in TR.kmeans_tiers(ppu).collect()}
    assert len(got) == len(rows)
    for name, xs in groups.items():
        x = np.array(xs, float)
        mine = [got[None if name == "flat" else name, f"b{i:02d}"] for i in range(len(xs))]
        if len(x) < 3:
            assert mine == [("quantile", "cost_effective"), ("quantile", "premium")]
            continue
        codes = kmeans_bins(np.log1p(np.clip(x, np.quantile(x, 0.05), np.quantile(x, 0.95))), 3)
        assert mine == [("kmeans", TR.TIER_NAMES[k]) for k in codes], name
    assert [got["empty middle", b][1] for b in ("b00", "b02")] == ["cost_effective", "premium"]
    assert {got[None, f"b0{i}"][1] for i in range(4)} == {"cost_effective"}


def test_kmeans_with_other_bin_counts(spark):
    rng = np.random.default_rng(7)
    z = [(str(g), float(round(x, 6))) for g in range(6) for x in rng.gamma(2, 2, 60)]
    df = spark.createDataFrame(z, "gid string, z double").selectExpr("gid", "CAST(z AS DECIMAL(18,12)) AS z")
    for bins in (2, 5):
        got = TR.kmeans_codes(df, bins).toPandas()
        for gid, d in got.groupby("gid"):
            assert d.code.tolist() == kmeans_bins(d.z.astype(float).to_numpy(), bins).tolist()
