"""Sparse marts of many codes."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from lamina.operators import features, model, sparse


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"s{k % 60}", f"code {k * 7 % 2500}", float(k % 11)) for k in range(6_000)] + [(None, "code 1", 1.0), ("s1", None, 1.0), ("s1", "code 2", None), ("s1", "code 2", float("nan"))]
    findings = spark.createDataFrame(rows, "USUBJID string, LBTESTCD string, LBSTRESN double")
    return features.finding_cells(findings)


def test_vectors_hold_the_cells(spark, cells):
    dictionary = sparse.code_dictionary(cells)
    codes = [r.code for r in dictionary.orderBy("index").collect()]
    assert codes == sorted(set(codes)) and len(codes) > features.MAX_VALUES
    assert [r["index"] for r in dictionary.orderBy("index").collect()] == list(range(len(codes)))
    made = sparse.sparse_features(cells, dictionary)
    wanted = {(r.USUBJID, r.code): r["mean"] for r in cells.where("USUBJID IS NOT NULL").collect()}
    got = {}
    for r in sparse.as_vectors(made).collect():
        assert r.features.size == len(codes) and list(r.features.indices) == sorted(r.features.indices)
        got |= {(r.USUBJID, codes[i]): v for i, v in zip(r.features.indices, r.features.values, strict=True)}
    assert got == wanted
    assert {(r.USUBJID, r.code): r.value for r in sparse.as_cells(made, dictionary).collect()} == wanted


def test_models_read_the_vectors(cells):
    dictionary = sparse.code_dictionary(cells)
    vectors = sparse.as_vectors(sparse.sparse_features(cells, dictionary))
    rows = vectors.withColumn("y", F.length("USUBJID").cast("double"))
    for made in (LinearRegression(labelCol="y", maxIter=3), RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=2)):
        assert model.regression_metrics(made.fit(rows).transform(rows), "y", "prediction").first().n == 60


def test_codes_out_of_the_dictionary_and_empty_marts(spark, cells):
    some = sparse.code_dictionary(cells.where("code < 'code 11'"))
    assert sparse.as_cells(sparse.sparse_features(cells, some), some).where("code >= 'code 11'").count() == 0
    none = sparse.code_dictionary(cells.limit(0))
    assert none.count() == 0 and sparse.sparse_features(cells, none).count() == 0
    assert sparse.as_vectors(sparse.sparse_features(cells.limit(0), some)).count() == 0
