"""Distinct stores from bitmaps at several grains; platforms of the report."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfpulse.checks.registry import L1
from shelfpulse.operators import distinct as D
from shelfpulse.plans import report as R
from shelfpulse.plans import stores as ST


def test_numbers_are_dense_over_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD", 50)
    df = spark.createDataFrame([(f"s{i % 333}",) for i in range(2_000)] + [(None,)], "s string")
    rows = D.dense_numbers(df, "s").collect()
    assert sorted(r["number"] for r in rows) == list(range(1, 334)) and len({r["value"] for r in rows}) == 333
    assert D.dense_numbers(df.limit(0), "s").count() == 0


def test_merged_counts_equal_count_distinct(spark, monkeypatch):
    """Many buckets (numbers over 32,768), a hot group, NULL keys and values, empty groups."""
    monkeypatch.setattr(D, "SHARD", 7_000)
    df = (spark.range(200_000).withColumn("a", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")))
          .withColumn("a", F.when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("a")))
          .withColumn("b", F.col("id") % 5)
          .withColumn("v", F.when(F.col("id") % 13 != 0, F.concat(F.lit("v"), F.xxhash64("id") % 60_000)))
          .union(spark.createDataFrame([(0, "empty", 9, None)], "id long, a string, b long, v string")))
    keep = {"n": F.lit(True), "even": F.col("id") % 2 == 0, "never": F.lit(None).cast("boolean")}
    maps = D.bitmaps(df, ["a", "b"], "v", D.dense_numbers(df, "v"), keep).cache()
    for grain in (["a", "b"], ["a"], ["b"], []):
        got = {tuple(r) for r in D.merged_counts(maps, grain, list(keep)).collect()}
        want = {tuple(r) for r in df.groupBy(*grain).agg(
            F.count_distinct("v"), F.count_distinct(F.when(F.col("id") % 2 == 0, F.col("v"))), F.lit(0)).collect()}
        assert got == want
    maps.unpersist()


def test_store_reach_reads_the_facts_for_one_table(spark):
    rng = random.Random(2)
    day = dt.date.fromisoformat(str(L1[0]))
    rows = [(rng.choice("ab"), "X", rng.choice(["c1", "c2", None]), rng.choice("pq"), rng.choice("mno"),
             rng.choice([None, "s1", "s2", "s3", "s4"]), day, rng.choice([0, 1, None]), rng.choice([0, 2])) for _ in range(300)]
    facts = spark.createDataFrame(rows + [("a", "X", "c1", "p", "m", "late", dt.date(1900, 1, 1), 1, 1)],
                                  "account string, gc_platform string, gc_city string, bgr string, product_id string, "
                                  "store_id string, snapshot_date date, total_listed long, total_available long")
    written = []

    def once(df):
        written.append(df)
        return spark.createDataFrame(df.collect(), df.schema)
    out = ST.store_reach(facts, L1, once)
    assert len(written) == 2                        # the numbering and the bitmaps; no grain reads the facts
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "snapshot_date" not in plan
    got = {(r["grain"], r["account"], r["gc_city"], r["bgr"], r["product_id"]): tuple(r)[6:] for r in out.collect()}
    assert len(got) == out.count()
    for name, at in (("platform", None), ("city", 2), ("category", 3), ("sku", 4)):
        for account in "ab":
            for value in ({None} if at is None else {r[at] for r in rows}):
                part = [r for r in rows if r[0] == account and (at is None or r[at] == value)]
                key = [name, account, None, None, None]
                if at is not None:
                    key[at] = value
                assert got[tuple(key)] == tuple(len({r[5] for r in part if r[5] and ok(r)}) for ok in (
                    lambda r: True, lambda r: (r[7] or 0) > 0, lambda r: r[8] > 0))


def test_prefixes_tell_platforms_apart():
    assert R.platform_prefixes(["blink", "zed"]) == {"blink": "B", "zed": "Z"}
    assert R.platform_prefixes(["blink", "big", "zed"]) == {"blink": "BL", "big": "BI", "zed": "Z"}
    for bad in (["big", "bigger"], ["zed", "ZED"]):
        with pytest.raises(ValueError):
            R.platform_prefixes(bad)


def test_a_platform_without_a_place_is_not_left_out_silently(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None)], "account string, gc_platform string")
    assert R.known_platforms(df, ["x", "y"]).count() == 2 and R.known_platforms(df, ["x"]).collect() == df.collect()
    with pytest.raises(Exception, match="platform without a place in the report: x"):
        R.known_platforms(df, ["y"]).collect()


def test_sparse_groups_cost_rows_by_their_values(spark):
    """Many groups of one value each out of a large numbering: a group has a few bytes, not a page of bits."""
    df = spark.range(3_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    maps = D.bitmaps(df, ["k"], "v", D.dense_numbers(df, "v"))
    assert dict(maps.dtypes)["n"] == "bigint" and maps.count() == 3_000
    assert "SortAggregate" not in maps._jdf.queryExecution().executedPlan().toString()
    assert D.merged_counts(maps, []).first()["n"] == 3_000 and D.merged_counts(maps, ["k"]).where("n = 1").count() == 3_000
