"""Versioned tables survive failed writes; folded state equals one pass and reads new days only."""

import pytest
from pyspark.sql import functions as F

from shelfpulse.sources.versioned import VersionedTable, first_seen_between, fold_days, new_days, uploaded_till


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_write_that_fails_half_way_leaves_the_version_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.commits() == []
    assert table.overwrite(spark.range(10)) == 1
    bad = spark.range(0, 1000, 1, 8).withColumn("id", F.when(F.col("id") > 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    for write in (table.overwrite, table.append):
        with pytest.raises(Exception, match="lost"):
            write(bad)
        assert ids(table.read()) == list(range(10)) and len(table.commits()) == 1
    table.stage(spark.range(5))                           # written, never committed
    assert ids(table.read()) == list(range(10))
    assert table.overwrite(table.read().where("id < 3")) == 2
    assert ids(table.read()) == [0, 1, 2] and ids(table.read(1)) == list(range(10))
    assert table.read(9) is None


def test_append_creates_and_widens(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(spark.range(2))
    table.append(spark.range(2, 3).withColumn("note", F.lit("x")))
    assert sorted((r["id"], r["note"]) for r in table.read().collect()) == [(0, None), (1, None), (2, "x")]


def test_two_writers_of_one_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.overwrite(spark.range(1))
    mine = table.stage(spark.range(2))
    table.overwrite(spark.range(3))
    with pytest.raises(RuntimeError, match="since version 1"):
        table.commit([mine], after=1)
    assert ids(table.read()) == [0, 1, 2]


@pytest.fixture
def facts(spark, tmp_path):
    rows = [("a", None if i % 7 == 0 else f"k{i % 7}", f"2000-01-{i % 28 + 1:02d}") for i in range(200)] + [("b", "late", "2000-01-28"), ("b", "none", None)]
    df = spark.createDataFrame(rows, "account string, product string, d string").select("account", "product", F.to_date("d").alias("day"))
    df.write.parquet(str(tmp_path / "facts"))
    return spark.read.parquet(str(tmp_path / "facts"))


def test_folding_in_steps_equals_one_pass(spark, tmp_path, facts):
    keys = ["account", "product"]
    table = VersionedTable(spark, str(tmp_path / "s"))
    for upto in ("2000-01-05", "2000-01-05", "2000-01-20", "2000-01-28"):
        state = fold_days(table, facts.where(F.col("day") <= F.lit(upto).cast("date")), keys, "day")
    assert [c["mark"] for c in table.commits()] == ["2000-01-05", "2000-01-20", "2000-01-28"]     # no version without a new day
    whole = facts.where("day IS NOT NULL").groupBy(*keys).agg(F.min("day"), F.max("day"), F.count("*"))
    want = sorted(map(tuple, whole.collect()), key=repr)
    assert sorted(map(tuple, state.collect()), key=repr) == want
    assert sorted(map(tuple, table.read().collect()), key=repr) == want
    assert {(r[0], str(r[1])) for r in uploaded_till(state, ["account"]).collect()} == {("a", "2000-01-28"), ("b", "2000-01-28")}
    assert [r["product"] for r in first_seen_between(state, "2000-01-28", "2000-02-01").collect()] == ["late"]


def test_a_later_fold_scans_new_days_only(spark, facts):
    plan = new_days(facts, "day", "2000-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(day,2000-01-20)" in plan.split("PushedFilters")[1]


def test_folding_an_empty_table(spark, tmp_path, facts):
    table = VersionedTable(spark, str(tmp_path / "e"))
    assert fold_days(table, facts.limit(0), ["account"], "day").collect() == [] and table.commits() == []
