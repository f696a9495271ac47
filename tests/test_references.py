"""References to parents: the ways to find orphans agree, and rows stay where they are."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lamina.operators import quality, references


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parents 0, 3, 6, ...; children with orphans, repeated keys and a third of all keys NULL."""
    at = str(tmp_path_factory.mktemp("references"))
    spark.range(6_000).select((F.col("id") * 3).alias("p"), F.lit("x").alias("other")).union(spark.sql("SELECT NULL, 'x'")).write.parquet(f"{at}/parent")
    key = F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 7 == 0, 1).otherwise(F.col("id") * 3 % 18_300))
    spark.range(20_000).select(F.col("id"), key.alias("p")).write.parquet(f"{at}/child")
    return spark.read.parquet(f"{at}/child"), spark.read.parquet(f"{at}/parent")


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("only_nonnull", [False, True])
@pytest.mark.parametrize("limits", [{}, {"broadcast_keys": 0}, {"broadcast_keys": 0, "filter_keys": 0}])
def test_every_way_finds_the_same_orphans(tables, only_nonnull, limits):
    child, parent = tables
    have = {r.p for r in parent.collect()}
    wanted = sorted(r.id for r in child.collect() if (not only_nonnull if r.p is None else r.p not in have))
    found = references.orphans(child, parent, "p", "p", only_nonnull, **limits)
    assert found.columns == child.columns
    assert sorted(r.id for r in found.collect()) == wanted
    assert wanted


def test_rows_are_not_shuffled(spark, tables):
    child, parent = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for Spark to broadcast by itself
    try:
        _plans(child, parent)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plans(child, parent):
    assert "hashpartitioning(p" not in plan_of(references.orphans(child, parent, "p", "p", broadcast_keys=0))
    assert "hashpartitioning(p" in plan_of(references.orphans(child, parent, "p", "p", broadcast_keys=0, filter_keys=0))


def test_false_hits_are_found_out(tables, monkeypatch):
    child, parent = tables
    wanted = sorted(r.id for r in references.orphans(child, parent, "p", "p").collect())
    monkeypatch.setattr(references, "KEY_BITS", 1)  # one block for all keys: most foreign keys pass it
    keys = references.parent_keys(parent, "p")
    flags = references.key_filter(keys, "_pk", 1)
    passed = references.maybe_in(child, "p", flags, 1).where("_maybe").count()
    inside = child.join(keys, F.col("p") == F.col("_pk")).count()
    assert passed > inside
    for bound in (references.BROADCAST_KEYS, 1):
        monkeypatch.setattr(references, "BROADCAST_KEYS", bound)
        assert sorted(r.id for r in references.orphans(child, parent, "p", "p", broadcast_keys=0).collect()) == wanted


def test_filter_passes_all_its_keys_and_few_others(spark):
    keys = spark.range(30_000).select((F.col("id") * 2).alias("k"))
    blocks = references.blocks_for(30_000)
    flags = references.key_filter(keys, "k", blocks)
    seen = references.maybe_in(spark.range(60_000).select(F.col("id").alias("k")), "k", flags, blocks)
    row = seen.agg(F.count_if(~F.col("_maybe") & (F.col("k") % 2 == 0)).alias("lost"), F.count_if(F.col("_maybe") & (F.col("k") % 2 == 1)).alias("false")).first()
    assert row["lost"] == 0 and row["false"] < 600
    texts = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    one = references.key_filter(texts, "t", 1)
    assert {r.t: r._maybe for r in references.maybe_in(texts, "t", one, 1).collect()} == {"a": True, None: False, "b": True}
    assert references.maybe_in(texts, "t", one.limit(0), 1).where("_maybe").count() == 0


def test_counts_shuffle_each_key_once_for_a_task(spark):
    child = spark.range(90_000, numPartitions=3).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 5).alias("p"))
    parent = spark.createDataFrame([(0,), (1,), (1,), (None,)], "p long")
    counted = child.groupBy("p").count()
    assert quality.ri_rate(child, parent, "p", "p").first()[:4] == (90_000, 60_000, 18_000, 78_000)
    assert quality.ri_rate(child, parent, "p", "p", only_nonnull=True).first()[3:] == (18_000, 0.4)
    assert quality.ri_rate(child.limit(0), parent, "p", "p").first()[:4] == (0, 0, 0, 0)
    assert counted.count() == 6
    plan = plan_of(quality.ri_rate(child, parent, "p", "p"))
    first = plan[: plan.index("\n\n\n")] if "\n\n\n" in plan else plan
    assert first.count("HashAggregate") >= 4
