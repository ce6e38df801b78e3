"""Whitening against numpy's dense eigenvectors, and what odd rows give."""

import numpy as np
import pytest

from textloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def dense(x, count=4):
    """By the definition: (n, deviations, whitened by eigh, shares) of whole-number rows."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (u * n - s) / n
    w, v = np.linalg.eigh(c.T @ c / n)
    w, v = w[::-1][:count], v[:, ::-1][:, :count]
    return n, ((x.astype(object) * n - s) ** 2).sum(axis=1), ((x * n - s) / n) @ v / np.sqrt(w), w / np.trace(c.T @ c / n)


def compare(got, ids, x, count=4):
    n, deviation, z, share = dense(x, count)
    assert len(got) == len(ids) * z.shape[1]
    by = {(r.id, r.component): r for r in got}
    for c in range(z.shape[1]):
        rows = [by[i, c + 1] for i in ids]
        values = np.array([r.whitened for r in rows])
        sign = np.sign(values @ z[:, c])
        assert np.allclose(values, sign * z[:, c], atol=1e-8)
        assert {r.n for r in rows} == {n} and [r.deviation for r in rows] == list(deviation)
        assert rows[0].explained == pytest.approx(share[c], rel=1e-9) and rows[0].identity_error < 1e-8


def test_equals_the_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((24, 24)) * np.geomspace(4, 0.1, 24)
    v = (rng.standard_normal((300, 24)) @ mix + 3).astype(np.float32)
    v[100:200] = v[7]  # a third of all rows are one vector
    v[0, 0], v[1, 0] = -0.0, 0.0
    ids = list(range(300))
    x = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    compare(whitening.whitened(frame(spark, zip(ids, v.tolist()))).collect(), ids, x)


def test_breakdown_and_restarts(spark):
    """Vectors of five directions only: the first block's images are dependent; a basis of few columns restarts."""
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, (200, 5)) @ rng.integers(-5, 6, (5, 40))
    ids = list(range(200))
    got = whitening.whitened(frame(spark, zip(ids, (x / 256).tolist())), block=4).collect()
    compare(got, ids, x)
    fit = whitening.fit_rows(whitening.usable(frame(spark, zip(ids, (x / 256).tolist())), "vec_id", "embedding"), 256.0)
    m = whitening.moments(fit, 40)
    whole, _ = whitening.leading_pairs(fit, m, 40, block=6)
    assert len(whole) == 5  # the rest carries no variance
    v = rng.integers(-900, 900, (150, 60)) * np.geomspace(1, 40, 60).astype(np.int64)
    fit = whitening.fit_rows(whitening.usable(frame(spark, zip(range(150), (v / 256).tolist())), "vec_id", "embedding"), 256.0)
    m = whitening.moments(fit, 60)
    few, axes = whitening.leading_pairs(fit, m, 3, block=3, most_basis=12, tolerance=1e-12, most_passes=60)
    c = v - v.mean(axis=0)
    assert np.allclose(few, np.linalg.eigvalsh(c.T @ c / 150)[::-1][:3], rtol=1e-10)
    assert np.linalg.norm(c.T @ c / 150 @ axes - axes * few, axis=0).max() < 1e-10 * few[0]


def test_equal_eigenvalues(spark):
    """All directions alike: any orthonormal ones do."""
    x = np.vstack([np.eye(6, dtype=np.int64), -np.eye(6, dtype=np.int64)]) * 512
    got = whitening.whitened(frame(spark, zip(range(12), (x / 256).tolist()))).collect()
    z = np.array([r.whitened for r in sorted(got, key=lambda r: (r.id, r.component))]).reshape(12, 4)
    assert np.allclose(z.T @ z / 12, np.eye(4), atol=1e-12)
    assert all(r.explained == pytest.approx(1 / 6) for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0, 3.0]), (None, [2.0, 0.0, 1.0]), (5, [1.0, 1.0, 1.0])]
    bad = [(6, None), (7, [None, 1.0, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, []), (11, [1.0, 2.0])]
    got = whitening.whitened(frame(spark, good + bad)).collect()
    assert {r.id for r in got} == {1, 2, None, 5} and {r.n for r in got} == {4} and len(got) == 5 * 3
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(frame(spark, bad[:5])).count() == 0


def test_sums_beyond_64_bits():
    m = whitening.Moments(3, [3 * 2**59, 0, 7], 0.0)
    x = np.array([[2**60, -(2**60), 5]], dtype=np.int64)
    assert m.deviations(x) == [(3 * 2**60 - 3 * 2**59) ** 2 + (3 * 2**60) ** 2 + 64]
    assert np.allclose(m.centred(x), [[2.0**59, -(2.0**60), 5 - 7 / 3]])
    m = whitening.Moments(1 << 30, [5, -3, 1 << 40], 0.0)
    x = np.array([[2**20, 17, -4]], dtype=np.int64)
    assert m.deviations(x) == [((1 << 50) - 5) ** 2 + (17 * (1 << 30) + 3) ** 2 + (4 * (1 << 30) + (1 << 40)) ** 2]
