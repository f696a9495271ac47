from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, divisor, k):
    """Every pair, in Python's whole numbers; rows with an id count as often as they appear."""
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or i % divisor:
            continue
        others = [(-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, j) for b, (j, w) in enumerate(whole) if b != a]
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 16)


def test_same_rows_as_all_pairs(spark, small_blocks):
    draw = np.random.default_rng(3)
    rows = [(k, [float(x) for x in draw.normal(size=20)]) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(60)]  # ties by the dozen
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    assert found(search.top_k(df, F.col("vec_id") % 10 == 0, k=8)) == brute(rows, 10, 8)


def test_nulls_ties_repeats_and_lengths(spark, small_blocks):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v), (0, v), (0, [0.1, 0.1, 0.1]), (1, v), (None, v), (None, [9.0, 9.0, 9.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 0.0, 0.0]), (10, []), (12, [1.0]), (13, [0.0, 0.0, 0.0, 7.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumns({c: F.lit("own") for c in ("rank", "score", "query_id", "v", "q", "block")})
    assert found(search.top_k(df, F.col("vec_id") % 10 == 0, k=4)) == brute(rows, 10, 4)
    assert found(search.top_k(df, F.col("vec_id") % 10 == 0, k=50)) == brute(rows, 10, 50)
    assert found(search.top_k(df, F.lit(None).cast("boolean"))) == []
    assert found(search.top_k(df.limit(0), F.col("vec_id") % 10 == 0)) == []
    only = spark.createDataFrame([(0, v, 1)], SCHEMA)
    assert found(search.top_k(only, F.col("vec_id") % 10 == 0)) == []


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(0, [3e30], 1), (1, [1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        search.top_k(df, F.col("vec_id") % 10 == 0).collect()


def test_bounds_hold_and_part_smooth_vectors(monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.normal(scale=60, size=(40, 8)).repeat(8, axis=1)
    rows = (centres[draw.integers(0, 40, 2_000)] + draw.normal(scale=6, size=(2_000, 64))).astype(np.int64)
    q, c = rows[:100], rows[100:]
    exact = q @ c.T
    least = np.sort(exact, 1)[:, -21].astype(float)
    for share in (0.15, 0.0, 2.0):  # from whole products to lists at once, never, always
        monkeypatch.setattr(search, "DENSE", share)
        i, j, score, left = search.survivors(q, search._features(q), c, search._features(c), least)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= least[:, None])), strict=True))
        assert (score == exact[i, j]).all()
        assert left == sorted(left, reverse=True)
        assert left[-1] < 0.1 * exact.size
    for a, b in zip(search._features(q), search._features(c), strict=True):
        assert (a @ b.T >= exact - 1e-6).all()
    # whole numbers beyond what doubles hold
    big = np.full((2, 3), 1 << 26, dtype=np.int64) + np.arange(6).reshape(2, 3)
    i, j, score, _ = search.survivors(big, search._features(big), big, search._features(big), np.full(2, -np.inf))
    assert [int(s) for s in score] == [sum(int(x) * int(y) for x, y in zip(big[a], big[b], strict=True)) for a, b in zip(i, j, strict=True)]
