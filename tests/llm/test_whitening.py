"""Whitening against a dense eigensolver."""

import numpy as np
import pytest

from wardline.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, x string, `a.b` int, key string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "k", 2) for i, v in rows], COLUMNS)


def whitened(spark, rows):
    return whitening.whiten(whitening.integer_vectors(vectors(spark, rows))).toPandas()


def triangle(a):
    full = np.zeros((a.shape[1], a.shape[1]))
    r = np.linalg.qr(a, mode="r")
    full[: len(r)] = r
    return full


def cases():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(512, 64)))
    q, _ = np.linalg.qr(q - q.mean(0))
    o, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    steps = np.repeat([1.0, 2, 3, 4], 16)
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 20) + np.diag(np.ones(20), 1)
    return {
        "random": rng.normal(size=(500, 64)),
        "graded": rng.normal(size=(500, 64)) * 10.0 ** -np.arange(0, 6.4, 0.1),
        "low rank": rng.normal(size=(500, 10)) @ rng.normal(size=(10, 64)),
        "constant dimensions": np.hstack([rng.normal(size=(500, 30)), np.ones((500, 34))]),
        "fewer rows than dimensions": rng.normal(size=(20, 64)),
        "all equal": q,
        "equal in groups": q @ np.diag(steps) @ o,
        "nearly equal": q @ np.diag(steps + 1e-9 * np.arange(64)) @ o,
        "one": rng.normal(size=(50, 1)),
        "two": rng.normal(size=(50, 2)),
        "pairs": np.vstack([wilkinson, -wilkinson]),
    }


@pytest.mark.parametrize("name", list(cases()))
def test_solver(name):
    a = cases()[name]
    a = a - a.mean(0)
    e, v, trace = whitening.components(triangle(a), len(a), 64)
    want = np.linalg.svd(a, compute_uv=False)[: len(e)] ** 2 / len(a)
    assert np.allclose(e, want, rtol=1e-11, atol=0) and np.all(np.diff(e) <= 1e-14 * e[0])
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    assert np.abs(a.T @ a / len(a) @ v - v * e).max() < 1e-13 * e[0]
    y = a @ (v / np.sqrt(e))
    assert np.abs(y.T @ y / len(a) - np.eye(len(e))).max() < 1e-12
    assert abs(trace - (a * a).sum() / len(a)) < 1e-12 * trace


def test_small_values_keep_their_relative_accuracy():
    b = np.diag([1.0, 1e-3, 1e-6, 1e-9, 1e-12]) + np.diag([1e-4, 1e-7, 1e-10, 1e-13], 1)
    got = whitening.squared_values(np.diag(b).copy(), np.diag(b, 1).copy())
    assert np.allclose(got, [1.00000001, 9.9999999e-07, 1e-12, 1e-18, 1e-24], rtol=1e-6, atol=0)


def test_rows(spark):
    rng = np.random.default_rng(1)
    plain = rng.normal(size=(400, 8)) @ rng.normal(size=(8, 8))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(plain)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [float("nan")] * 8), (903, [None] * 8)]
    rows += [(904, [float("inf")] * 8), (905, [1.0] * 7), (906, [3e38] * 8)]
    got = whitened(spark, rows)
    usable = rows[:402]
    x = np.floor(64 * np.array([v for _, v in usable])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    y = centred @ v[:, ::-1] / np.sqrt(e[::-1])
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    wide = got[got.key.notna() & (got.key != 3)].pivot(index="key", columns="component", values="whitened")
    mine = y[[i for i in range(400) if i != 3]]
    signs = np.sign((wide.to_numpy() * mine).sum(0))
    assert np.abs(wide.to_numpy() * signs - mine).max() < 1e-9
    assert sorted(got.deviation[got.component == 1]) == sorted(((n * x - s) ** 2).sum(1).tolist())
    share = got[got.key == 0].sort_values("component").explained
    assert np.allclose(share, e[::-1] / e.sum(), rtol=1e-12)


def test_no_rows(spark):
    assert whitened(spark, []).empty
    assert whitened(spark, [(1, None), (2, [])]).empty
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).empty
    assert list(whitened(spark, []).columns) == list(whitened(spark, [(1, [1.0]), (2, [3.0])]).columns)


def test_deviations_beyond_a_long_are_null():
    mean = whitening.Mean(2**30, np.array([0]), np.array([1]))
    assert mean.deviations(np.array([[2], [2**40]])).to_pylist() == [(2**31 - 1) ** 2, None]
