"""Stored tables updated by key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.sources import registry

SCHEMA = "k long, v string, d decimal(10,2)"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    at = f"file://{tmp_path}/registry"
    df = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("old"), "id").alias("v"), F.lit(1).cast("decimal(10,2)").alias("d"))
    assert registry.create(df.union(spark.sql("SELECT NULL, 'none', NULL")), at, ["k"], 16) == 1
    return at


def folders(spark, path):
    return registry._commit_of(spark, path)["folders"]


def test_merge_rewrites_only_touched_buckets(spark, path):
    before, kept = folders(spark, path), rows_of(registry.read(spark, path))
    updates = spark.createDataFrame([(7, "new", 2), (500, "more", 3)], "k int, v string, d int")  # other types, cast
    assert registry.merge(updates, path) == 2
    after = folders(spark, path)
    assert 1 <= sum(before[b] != f for b, f in after.items() if b in before) <= 2
    wanted = [r for r in kept if r[0] != 7]
    got = rows_of(registry.read(spark, path))
    assert len(got) == 202 and set(wanted) < set(got)
    assert {(k, v, str(d)) for k, v, d in set(got) - set(wanted)} == {(7, "new", "2.00"), (500, "more", "3.00")}
    assert registry.read(spark, path).schema.simpleString() == registry.read(spark, path, 1).schema.simpleString()
    assert rows_of(registry.read(spark, path, 1)) == kept


def test_null_keys_are_added_and_no_updates_are_no_version(spark, path):
    assert registry.merge(spark.createDataFrame([(None, "none", None)] * 2, SCHEMA), path) == 2
    assert registry.read(spark, path).where("k IS NULL").count() == 3
    assert registry.merge(spark.createDataFrame([], SCHEMA), path) == 2


@pytest.mark.parametrize("where", ["_write", "_commit"])
def test_a_writer_that_dies_half_way_leaves_the_old_table(spark, path, monkeypatch, where):
    kept, true = rows_of(registry.read(spark, path)), getattr(registry, where)

    def dies(*args):
        if where == "_write":
            true(*args)  # all files are there, nothing is committed
        raise OSError("lost")

    updates = spark.createDataFrame([(k, "new", None) for k in range(100)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(registry, where, dies)
        with pytest.raises(OSError, match="lost"):
            registry.merge(updates, path)
    assert rows_of(registry.read(spark, path)) == kept
    assert registry.vacuum(spark, path) > 0  # what was left behind
    assert rows_of(registry.read(spark, path)) == kept
    assert registry.merge(updates, path) == 2
    assert registry.read(spark, path).where("v = 'new'").count() == 100
    registry.vacuum(spark, path)
    assert registry.versions(spark, path) == [2] and registry.read(spark, path).count() == 201


def test_only_one_of_two_writers_commits(spark, path, monkeypatch):
    stale = registry._commit_of(spark, path)
    registry.merge(spark.createDataFrame([(1, "first", None)], SCHEMA), path)
    monkeypatch.setattr(registry, "_commit_of", lambda *a: stale)
    with pytest.raises(registry.ConflictError):
        registry.merge(spark.createDataFrame([(1, "second", None)], SCHEMA), path)
    monkeypatch.undo()
    assert registry.read(spark, path).where("k = 1").first().v == "first"
    with pytest.raises(registry.ConflictError):
        registry.create(registry.read(spark, path), path, ["k"])


def test_runs_are_inserted_or_replaced(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    registry.record_run(spark, at, "r1", "2024-01-01T00:00:00", "a")
    registry.record_run(spark, at, "r2", "2024-01-02T00:00:00", "b")
    registry.record_run(spark, at, "r1", "2024-01-03T00:00:00", "c")
    assert sorted((r.run_id, str(r.started_at), r.source) for r in registry.read(spark, at).collect()) == [("r1", "2024-01-03 00:00:00", "c"), ("r2", "2024-01-02 00:00:00", "b")]


def test_empty_tables_and_missing_ones(spark, tmp_path):
    at = f"file://{tmp_path}/empty"
    registry.create(spark.createDataFrame([], SCHEMA), at, ["k"])
    assert registry.read(spark, at).collect() == []
    registry.merge(spark.createDataFrame([(1, "a", None)], SCHEMA), at)
    assert registry.read(spark, at).count() == 1
    with pytest.raises(ValueError, match="no committed"):
        registry.read(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(ValueError, match="clash"):
        registry.create(spark.range(1).withColumnRenamed("id", "bucket"), f"file://{tmp_path}/b", ["bucket"])
