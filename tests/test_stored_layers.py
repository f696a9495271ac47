"""Layers stored by subject: the same results, and no exchange on the subject."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.operators import features, visits
from lamina.plans import roles
from lamina.plans.checks import CODES
from lamina.sources import tables


@pytest.fixture
def shuffled_joins(spark):
    """As with tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    at, r = tmp_path_factory.mktemp("layers"), roles.Roles(spark, sf)
    lb, vs = r.lb(), r.vs()
    made = {"sv": r.sv(), "long": r.long(), "adsl": r.adsl(), "findings": lb.union(vs.toDF(*lb.columns))}
    return r, {n: tables.write_layer(df, f"stored_{n}", "USUBJID", f"file://{at}/{n}", 4) for n, df in made.items()}


def test_windows_and_pivots_need_no_exchange(stored, shuffled_joins):
    r, t = stored
    wide = visits.visits_wide(t["sv"])
    assert "Exchange" not in plan_of(wide) and "Bucketed: true" in plan_of(wide)
    assert "Exchange" in plan_of(visits.visits_wide(r.sv()))
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, visits.visits_wide(r.sv()).collect()), key=str)
    for made in (features.history_features(t["long"]), features.history_iqr(t["long"]), features.last_visit_target(t["long"]), visits.visit_los(t["sv"]), features.history_by_category(t["long"], ["a"])):
        assert "Exchange" not in plan_of(made)


def test_merges_need_no_exchange(stored, shuffled_joins):
    _, t = stored
    merged = features.merged_features(features.last_visit_target(t["long"]), features.subject_demo(t["adsl"]), features.finding_features(t["findings"], codes=CODES))
    assert "Exchange" not in plan_of(merged)
    assert "Exchange" not in plan_of(features.finding_cells(t["findings"]))
    assert merged.count() == features.last_visit_target(t["long"]).count()


def test_one_file_for_a_bucket_and_a_second_write(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 7).alias("USUBJID"), "id")
    path = f"file://{tmp_path}/layer"
    tables.write_layer(df, "stored_twice_a", "USUBJID", path, 4)
    again = tables.write_layer(df.where("id < 50"), "stored_twice_b", "USUBJID", path, 4)
    assert again.count() == 50 and len(list(tmp_path.glob("layer/part-*.parquet"))) <= 4
    plain = tables.write_layer(df.drop("USUBJID"), "stored_plain", "USUBJID", f"file://{tmp_path}/plain")
    assert plain.count() == 100


def test_findings_are_read_once(spark, sf):
    """The wide form from the cells is that of the raw rows with the same codes."""
    r = roles.Roles(spark, sf)
    lb, vs = r.lb(), r.vs()
    findings = lb.union(vs.toDF(*lb.columns)).unionByName(spark.createDataFrame([("SYN-1", "click", float("nan"))], "USUBJID string, LBTESTCD string, LBSTRESN double"), allowMissingColumns=True)
    for top in (25, 2):
        cells = features.finding_features(findings, top)
        chosen = [x["code"] for x in features.top_codes(findings, n=top).collect()]
        raw = features.finding_features(findings, codes=chosen)
        assert cells.columns == raw.columns
        assert sorted(map(tuple, cells.collect()), key=str) == sorted(map(tuple, raw.collect()), key=str)
