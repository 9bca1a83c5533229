"""Eigenvectors and singular vectors at sizes like the defaults, against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from sylva.operators import reduction as D
from sylva.session import written


def table(spark, k, names=("i", "j", "v")):
    i, j = np.nonzero(k)
    return written(spark.createDataFrame(pa.table([pa.array(i), pa.array(j), pa.array(k[i, j])], names)).repartition(8))


def space(rows):
    return np.array([r.x for r in rows.orderBy("id").collect()])


def test_hundred_components_of_two_thousand_rows(spark):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(2000, 300)))
    value = 100.0 * 0.97 ** np.arange(300)
    k = (q * value) @ q.T
    values, vectors = D.eigenvectors(table(spark, k), 100)
    x = space(vectors)
    assert x.shape == (2000, 100) and np.allclose(values, value[:100], rtol=1e-8)
    assert np.linalg.norm(k @ x - x * values, axis=0).max() <= 1e-6 * value[0]
    assert np.abs(x.T @ x - np.eye(100)).max() < 1e-8
    assert np.linalg.norm(x - q[:, :100] @ (q[:, :100].T @ x), axis=0).max() < 1e-4  # the same vectors


def test_negative_values_count_by_size(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40))
    k = a + a.T
    values, vectors = D.eigenvectors(table(spark, k), 5)
    want = sorted(np.linalg.eigvalsh(k), key=lambda v: -abs(v))[:5]
    assert np.allclose(values, want, rtol=1e-8)
    x = space(vectors)
    assert np.linalg.norm(k @ x - x * values, axis=0).max() < 1e-4


def test_sparse_singular_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 64)
    rng = np.random.default_rng(3)
    a = (rng.random((500, 300)) < 0.05) * rng.integers(1, 5, (500, 300)).astype(float) * (1.02 ** -np.arange(300))
    values, rows = D.singular_rows(table(spark, a, ("row", "col", "cnt")), 30)
    u, s, _ = np.linalg.svd(a)
    kept = np.flatnonzero(a.any(axis=1))
    assert np.allclose(values, s[:30], rtol=1e-5)
    assert np.allclose(np.abs(space(rows)[:, :3]), np.abs((u[kept][:, :3] * s[:3])), atol=1e-2)


def test_rank_below_what_is_asked(spark):
    rng = np.random.default_rng(4)
    b = rng.normal(size=(30, 3))
    values, vectors = D.eigenvectors(table(spark, b @ b.T), 6)
    assert np.allclose(values[:3], np.linalg.eigvalsh(b @ b.T)[::-1][:3]) and np.allclose(values[3:], 0, atol=1e-8)
    assert vectors.count() == 30


def test_no_convergence_is_an_error(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 60))
    with pytest.raises(RuntimeError, match="residual"):
        D.eigenvectors(table(spark, a + a.T), 10, tolerance=1e-12, rounds=1)
