"""Every query with SQL gives the same rows as DuckDB on the same Parquet files."""

from __future__ import annotations

import math

import duckdb
import pytest

from lamina.plans import ORACLE, QUERIES, checks

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def spelled(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name, monkeypatch):
    monkeypatch.setattr(checks, "TREES", 2)  # tests fit few trees; the registered queries take the number of the module
    df = QUERIES[name](spark, sf)
    found = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    mine = sorted(tuple(spelled(row[c]) for c in columns) for row in df.collect())
    at = [found.columns.index(c) for c in columns]
    assert mine == sorted(tuple(spelled(row[k]) for k in at) for row in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, sf, name, monkeypatch):
    monkeypatch.setattr(checks, "TREES", 2)
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if name == "cv_compare":
        assert {(r.model, r.feature_set, r.fold) for r in rows} == {(m, s, k) for m in ("gbt", "rf") for s in "AB" for k in range(5)}
    if name == "holdout_predictions":
        assert all(abs(r.residual - (r.y - r.yhat)) < 1e-9 for r in rows) and len({r.yhat for r in rows}) > 3
    if name == "holdout_metrics":
        assert rows[0].n > 0 and 0 <= rows[0].mae <= rows[0].rmse
