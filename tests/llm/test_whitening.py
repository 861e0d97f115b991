import math

import numpy as np
import pytest

from foliospark.llm import whitening

CLASH = "vec_id long, embedding array<float>, x long, component int, n long, m binary, deviation string"


def rows_of(spark, vectors, **more):
    full = [(i, v, *[None] * 5) for i, v in vectors]
    return whitening.whiten(spark.createDataFrame(full, CLASH), **more).collect()


def expected(vectors):
    """Components by a dense eigensolver in longer floats' stead: exact integers, then eigh."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    dev = [int(s) for s in ((n * x - sums) ** 2).sum(1)]
    y = (n * x - sums).astype(float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    return dev, y, e[::-1], q[:, ::-1]


@pytest.mark.parametrize(("n", "d"), [(60, 12), (40, 3), (300, 30)])
def test_against_dense_solver(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) * np.linspace(2, 0.5, d)).astype(np.float32).tolist()
    rows = rows_of(spark, list(enumerate(vectors)))
    dev, y, e, q = expected(vectors)
    k = min(8, d)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    w = np.zeros((n, k))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == dev[r["vec_id"]]
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-10 and r["identity_error"] < 1e-10
    want = y @ q[:, :k] / np.sqrt(e[:k])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-9


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, -1.0, 3.0]), (4, [2.0, 2.0, 2.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0]), (11, [1e30, 0.0, 0.0])]
    rows = rows_of(spark, good + bad)
    assert sorted(str(r["vec_id"]) for r in rows) == sorted(["1", "1", "None", "4"] * 3)
    assert {r["n"] for r in rows} == {4} and {r["component"] for r in rows} == {1, 2, 3}
    assert [r["whitened"] for r in rows if r["component"] == 3] == [None] * 4, "four vectors, two of them equal, span a plane"
    assert rows_of(spark, bad[:5]) == [] and rows_of(spark, []) == []


def test_without_variance(spark):
    rows = rows_of(spark, [(1, [0.25, 0.5]), (2, [0.25, 0.5])])
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in rows] == [(None, 0.0, 0, None)] * 4


def test_deviation_is_exact_or_null():
    x = np.array([[3_000_000_000], [0]], np.int64)
    assert whitening.deviations(x, 2, [3_000_000_000], np.array([1_500_000_000])) == [9 * 10**18] * 2
    assert whitening.deviations(x, 4, [3_000_000_000], np.array([750_000_000])) == [None, 9 * 10**18]


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 120), 1 / np.arange(1, 121), np.r_[np.ones(10), np.zeros(110)], np.r_[np.full(30, 5.0), np.full(90, 4.999)]])
def test_solver(spectrum):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.leading(lambda u: a @ u, 120, 8, subspace=40, kept=16)
    assert np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-12 * spectrum.max()
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * spectrum.max()
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    shifts = np.array([0.3, -1.7, 50.0])
    b = rng.standard_normal((20, 3))
    x = whitening.minres(lambda v: a @ v - v * shifts, b, 60)
    assert np.abs(a @ x - x * shifts - b).max() < 1e-6
