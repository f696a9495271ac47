"""Mergeable profiles and frequent keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.operators import features, frequent, quality, sketches


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(20_000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") * 7919 % 10_007).cast("double")).alias("x"),
        F.concat(F.lit("c"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)).alias("code"),
        F.lit(None).cast("int").alias("gone"),
        F.array("id").alias("list"),
    )


def test_merged_profiles_are_within_their_bounds(spark, table, tmp_path):
    for k in range(5):
        sketches.sketch_profile(table.where(F.col("key") % 5 == k), "t", f"r{k}").write.mode("append").parquet(str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    assert tuple(store.columns) == sketches.STORED and store.count() == 20
    probs = [0.05, 0.25, 0.5, 0.9]
    merged = {r.column_name: r for r in sketches.read_profile(sketches.merge_profiles(store), probs).collect()}
    x = sorted(r.x for r in table.where("x IS NOT NULL").select("x").collect())
    row = merged["x"]
    assert (row.n, row.n_null, row.low, row.high, row.missing_rate) == (20_000, 2_000, x[0], x[-1], 0.1)
    for p, q in zip(probs, row.at, strict=True):
        assert abs(sum(v <= q for v in x) / len(x) - p) < 0.02
    assert abs(row.n_distinct / len(set(x)) - 1) < 0.08
    code = merged["code"]
    assert code.at is None and code.low is None and abs(code.n_distinct / 500 - 1) < 0.08
    assert code.top[0].item == "c0" and code.top[0]["count"] == pytest.approx(6_667 + 26, abs=60)
    assert merged["gone"].n_null == 20_000 and merged["gone"].at is None and merged["gone"].n_distinct == 0


def test_drift_between_runs(spark, table):
    moved = table.withColumn("x", F.col("x") + 5_000).withColumn("code", F.when(F.col("key") % 2 == 0, F.col("code")))
    store = sketches.sketch_profile(table, "t", "a").union(sketches.sketch_profile(table, "t", "same")).union(sketches.sketch_profile(moved, "t", "b"))
    same = {r.column_name: r for r in sketches.drift(store, "a", "same").collect()}
    assert all(r.missing_change == 0.0 for r in same.values()) and same["x"].rank_shift < 0.02 and same["code"].rank_shift is None
    there = {r.column_name: r for r in sketches.drift(store, "a", "b").collect()}
    assert there["x"].rank_shift > 0.4 and there["code"].missing_change == 0.5 and there["key"].rank_shift < 0.02


def test_empty_tables_and_nan(spark, table):
    empty = {r.column_name: r for r in sketches.read_profile(sketches.sketch_profile(table.limit(0), "t", "r")).collect()}
    assert empty["x"].n == 0 and empty["x"].at is None and empty["x"].missing_rate == 0.0
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    row = sketches.read_profile(sketches.sketch_profile(odd, "t", "r"), [0.5]).first()
    assert (row.n, row.n_null, row.low, row.high, row.at) == (3, 1, 1.0, 1.0, [1.0])
    with pytest.raises(ValueError, match="no columns"):
        sketches.sketch_profile(table.select("list"), "t", "r")


@pytest.fixture(scope="module")
def skewed(spark):
    """A few frequent keys, many rare ones, ties around the tenth and NULLs."""
    key = F.when(F.col("id") % 4 == 0, F.col("id") % 12).when(F.col("id") % 97 == 0, None).otherwise(1_000 + F.col("id") % 7_001)
    return spark.range(60_000).select(key.alias("k"), (F.col("id") % 2).cast("string").alias("s"))


@pytest.mark.parametrize("n", [1, 5, 40, 20_000])
@pytest.mark.parametrize("buckets", [1, 64, 65_536])
def test_top_counts_are_those_of_all_keys(skewed, n, buckets):
    order = [F.desc("n"), F.col("k").asc_nulls_last(), F.col("s").asc_nulls_last()]
    wanted = skewed.groupBy("k", "s").agg(F.count("*").alias("n")).orderBy(*order).limit(n)
    got = frequent.top_counts(skewed, ["k", "s"], n, buckets=buckets)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in wanted.collect()]


def test_buckets_below_the_bar_are_not_looked_into(skewed, monkeypatch):
    counted = []
    true = F.broadcast
    monkeypatch.setattr(frequent.F, "broadcast", lambda df: counted.append(df.count()) or true(df))
    assert frequent.top_counts(skewed, ["k"], 3).count() == 3
    assert sum(counted) < 60  # of some thousand buckets with rows
    assert frequent.top_counts(skewed.limit(0), ["k"], 3).collect() == []


def test_bounded_forms_give_the_same_reports(spark):
    rows = [(f"c{k % 7}" if k % 5 else None, f"label {k % 3}" if k % 4 else "", float(k) if k % 6 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "LBTESTCD string, LBTEST string, LBSTRESN double")
    plain, bounded = (sorted(map(tuple, features.top_codes(df, n=4, bounded=b).collect()), key=str) for b in (False, True))
    assert plain == bounded
    specs = [("LB", df, "LBTESTCD", "LBTEST")]
    assert [tuple(r) for r in quality.top_unmapped(specs, 5).collect()] == [tuple(r) for r in quality.top_unmapped(specs, 5, bounded=True).select(*quality.top_unmapped(specs, 5).columns).collect()]
