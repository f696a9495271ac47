"""Work on hot groups and wide rows that is spread over tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import duplicates, profile, quarantine, references, spread, visits


@pytest.fixture(scope="module")
def hot(spark):
    """Nine of ten rows are one subject's; ties, NULL times and a NULL subject."""
    key = F.when(F.col("id") % 10 != 0, F.lit("hot")).otherwise(F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 40)))
    at = F.when(F.col("id") % 31 == 0, None).otherwise(F.col("id") * 7919 % 500)
    return spark.range(5_000).select(key.alias("g"), at.alias("t"), F.col("id").alias("u")).repartition(3)


@pytest.mark.parametrize("rows", [50, 700, 10_000])
def test_numbers_and_next_rows_are_those_of_windows(hot, rows):
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_last(), F.col("u").asc_nulls_last())
    wanted = hot.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.lead("t").over(w).alias("next_t"), F.lead("u").over(w).alias("next_u"))
    got = spread.along(hot, "g", ["t", "u"], "n", {"t": "next_t", "u": "next_u"}, rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_a_hot_group_is_many_ranges(hot):
    sizes = [r["count"] for r in spread.ranges(hot, "g", ["t", "u"], 100).groupBy("g", "_part").count().collect()]
    assert max(sizes) < 300 and sum(sizes) == 5_000


def test_ties_have_one_place_each_and_empty_tables_none(spark, hot):
    tied = hot.select("g", F.lit(1).alias("t"))
    got = spread.along(tied, "g", ["t"], "n", rows=100)
    assert got.groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m")).where("c <> d OR c <> m").count() == 0
    assert spread.along(hot.limit(0), "g", ["t"], "n", {"t": "x"}).collect() == []
    assert visits.sequence(hot, "g", ["t", "u"], 3, spread=True).where("SEQ > 3").count() == 0


@pytest.fixture(scope="module")
def wide(spark):
    rows = spark.range(3_000).select(
        (F.col("id") % 2_500).alias("a"),
        F.concat(F.lit("a long text that makes rows wide "), F.col("id") % 2_500).alias("b"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 2_500).alias("c"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("z"),
        F.array((F.col("id") % 2).cast("int")).alias("list"),
        F.lit(None).cast("string").alias("gone"),
    )
    return rows.unionByName(rows.limit(1).withColumn("z", F.lit(float("nan")))).unionByName(rows.limit(1).withColumn("z", -F.lit(float("nan")))).repartition(4)


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_KEYS": 0}, {"BROADCAST_KEYS": 0, "FILTER_KEYS": 0}])
def test_repeats_are_those_of_grouping(wide, monkeypatch, bounds):
    for name, bound in bounds.items():
        monkeypatch.setattr(references, name, bound)
    assert duplicates.width(wide.schema) > duplicates.NARROW
    wanted = wide.groupBy(*wide.columns).count().where("count > 1")
    got = duplicates.repeats(wide)
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("count=", "_n=") for r in wanted.collect())
    assert got.count() > 0
    assert profile.duplicate_rows(wide).first()[0] == wide.count() - wide.distinct().count()


def test_no_repeats_no_rows_and_narrow_rows(spark, wide):
    single = wide.dropDuplicates(["a"]).drop("list")
    assert duplicates.repeats(single).collect() == [] and duplicates.repeats(single.limit(0)).collect() == []
    narrow = wide.select("a", "c")
    assert duplicates.repeats(narrow).count() == narrow.groupBy("a", "c").count().where("count > 1").count()
    swapped = spark.createDataFrame([(None, "x", "t" * 50), ("x", None, "t" * 50)], "p string, q string, r string")
    assert duplicates.repeats(swapped).collect() == []
    assert quarantine.dup_groups(wide, [F.col("b"), F.col("c"), F.col("gone")]).first()[0] > 0
