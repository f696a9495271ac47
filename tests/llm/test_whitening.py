from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, most=32):
    """(n, deviations, whitened up to sign, shares) from a dense eigendecomposition of the covariance of centred rows."""
    d = max(map(len, vectors))
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, deviations, centred @ axes / np.sqrt(values), values / (centred**2).sum() * n


def whitened(rows, d):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], np.zeros(d))[r["component"] - 1] = r["whitened"]
    return out


def rotated(draw, n, values):
    base = np.linalg.qr(draw.normal(size=(n, len(values))))[0] * values
    return base @ np.linalg.qr(draw.normal(size=(len(values),) * 2))[0]


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "two values", "near", "cluster", "low rank", "few rows", "blocks", "diagonal"])
def test_solver_against_dense_decomposition(kind):
    draw = np.random.default_rng(2)
    a = {
        "plain": lambda: draw.normal(size=(300, 48)),
        "graded": lambda: draw.normal(size=(300, 30)) * 10.0 ** -np.linspace(0, 8, 30),
        "equal": lambda: rotated(draw, 90, np.ones(24)),
        "two values": lambda: rotated(draw, 90, np.repeat([2.0, 1.0], 12)),
        "near": lambda: rotated(draw, 90, 1 + 1e-12 * np.arange(24)),
        "cluster": lambda: rotated(draw, 90, np.r_[10, 1 + 1e-8 * np.arange(22), 1e-3]),
        "low rank": lambda: draw.normal(size=(90, 4)) @ draw.normal(size=(4, 20)),
        "few rows": lambda: draw.normal(size=(6, 20)),
        "blocks": lambda: np.kron(np.eye(3), draw.normal(size=(8, 6))),
        "diagonal": lambda: np.diag([3.0, 0.0, 2.0, 2.0, 1.0]),
    }[kind]()
    d = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    values, axes = whitening.principal(np.concatenate([r, np.zeros((d - len(r), d))]), d)
    wanted = np.zeros(d)
    wanted[: min(a.shape)] = np.linalg.svd(a, compute_uv=False)
    assert np.abs(np.sqrt(values) - wanted).max() < 1e-13 * wanted[0]
    clear = wanted > 1e-7 * wanted[0]
    assert np.abs(values[clear] / wanted[clear] ** 2 - 1).max() < 1e-9
    alive = np.sqrt(values) > whitening.ZERO * wanted[0]
    assert np.abs(axes[alive] @ axes[alive].T - np.eye(alive.sum())).max() < 1e-11
    white = a @ axes[alive].T / np.sqrt(values[alive])
    assert np.abs(white.T @ white - np.eye(alive.sum())).max() < 1e-6


def test_bidiagonal_keeps_the_product():
    r = np.triu(np.random.default_rng(4).normal(size=(9, 9)))
    a, b, v = whitening.bidiagonal(r)
    band = np.diag(a) + np.diag(b, 1)
    assert np.allclose(v @ band.T @ band @ v.T, r.T @ r, atol=1e-12)


def test_same_as_dense_covariance(spark):
    draw = np.random.default_rng(6)
    vectors = (draw.normal(size=(400, 40)) @ draw.normal(size=(40, 40)) / 8).astype(np.float32).tolist()
    vectors += [vectors[3]] * 200  # one vector with a third of all rows
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA).repartition(7)
    rows = whitening.whiten(df).collect()
    n, deviations, white, shares = brute(vectors)
    assert len(rows) == 600 * 32 and {r["n"] for r in rows} == {n}
    assert all(r["deviation"] == deviations[r["vec_id"]] for r in rows)
    assert all(abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-10 for r in rows)
    got = whitened(rows, 32)
    got = np.array([got[k] for k in range(600)])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-11 and error == pytest.approx(np.abs(got.T @ got / n - np.eye(32)).max(), abs=1e-12)


def test_nulls_repeats_lengths_and_empty(spark):
    rows = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (None, [0.1, 0.2, 0.3]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("-inf"), 0.0, 0.0]), (6, []), (7, [1.0]), (8, [0.0, 3.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumns({c: F.lit("own") for c in ("n", "component", "whitened", "v", "w", "state", "deviation")})
    kept = [v for _, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n, deviations, white, shares = brute(kept)
    found = whitening.whiten(df).collect()
    assert len(found) == 6 * 3 and {r["n"] for r in found} == {6}
    assert sorted(r["deviation"] for r in found) == sorted(deviations * 3)
    assert sorted({round(r["explained"], 12) for r in found}) == sorted(round(float(s), 12) for s in shares)
    assert sorted(abs(round(r["whitened"], 9)) for r in found) == pytest.approx(sorted(np.abs(white).ravel()), abs=1e-8)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 6")).collect() == []


def test_no_variance_and_low_rank(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(4)], SCHEMA)
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in whitening.whiten(same).collect()} == {(None, None, None, 0)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0], 0) for k in range(5)], SCHEMA)
    found = whitening.whiten(line).collect()
    assert {r["component"]: (r["whitened"] is None, round(r["explained"], 12)) for r in found} == {1: (False, 1.0), 2: (True, 0.0), 3: (True, 0.0)}
    assert max(r["identity_error"] for r in found) < 1e-12


def test_deviation_stays_exact_beyond_doubles(spark):
    big = [[1e9], [-1e9], [3.0]]
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(big)], SCHEMA)
    _, deviations, _, _ = brute(big)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert got == {k: (x if x < 1 << 63 else None) for k, x in enumerate(deviations)}
    assert max(deviations) >= 1 << 63
