"""Singular rows of few rows with many columns come from the rows' products."""

import numpy as np
from sylva.operators import reduction as D


def test_no_vectors_of_the_columns_length(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 4, (6, 300)).astype(float)
    rows = spark.createDataFrame([(i, f"c{j}", float(m[i, j])) for i in range(6) for j in range(300) if m[i, j]], "row long, col string, cnt double")
    lengths, drawn = [], D._drawn
    monkeypatch.setattr(D, "_drawn", lambda ids, k: lengths.append(ids.count()) or drawn(ids, k))
    for k in (2, 6):
        values, x = D.singular_rows(rows, k)
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        got = np.array([r.x for r in x.orderBy("id").collect()])
        assert np.allclose(values, s[:k], rtol=1e-5) and np.allclose(np.abs(got), np.abs(u[:, :k] * s[:k]), atol=1e-3)
    assert lengths == [6, 6]
