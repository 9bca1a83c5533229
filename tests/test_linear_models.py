"""Linear models on sparse features, and rankings by them, against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.operators import evaluation as E
from sylva.operators import labels as L
from sylva.operators import sparse_learners as N
from sylva.session import written


def plain(x, y, weight, c, loss):
    """Intercept and weights by Newton's method on the whole matrix; 30 times the class where there is one only."""
    if y.min() == y.max():
        return np.append(30.0 * y[0], np.zeros(x.shape[1]))
    x = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[0] = loss.penalised

    def objective(w):
        return c * weight @ loss(y * (x @ w))[0] + 0.5 * ridge @ (w * w)

    for _ in range(100):
        _, slope, curve = loss(y * (x @ w))
        g = c * (x.T @ (weight * slope * y)) + ridge * w
        p, t = -np.linalg.solve(c * (x.T * (weight * curve)) @ x + np.diag(ridge + 1e-12), g), 1.0
        while objective(w + t * p) > objective(w) + 1e-4 * t * (p @ g) and t > 1e-12:
            t /= 2
        w = w + t * p
    return w


def sparse(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "row long, col int, cnt double")


def drawn(rng, n, d, share=0.2):
    x = (rng.random((n, d)) < share) * rng.integers(1, 4, (n, d)).astype(float)
    return x, np.where(x @ rng.normal(size=d) + rng.normal(size=n) > 0, 1.0, -1.0)


@pytest.mark.parametrize("loss", [N.LOGISTIC, N.HINGE], ids=lambda x: x.name)
@pytest.mark.parametrize("newton", [256, 0])
def test_equals_plain_models(spark, monkeypatch, loss, newton):
    monkeypatch.setattr(N, "NEWTON", newton)
    monkeypatch.setattr(N, "NUMBERS", 60)  # several lots
    rng = np.random.default_rng(3)
    x, y = drawn(rng, 200, 20)
    x[5] = 0  # no features at all
    weight = rng.random(200)
    uses = [(i, b, float(y[i]), float(weight[i]) if i % 3 != b else 0.0, i % 3 == b) for i in range(200) for b in range(2)] + [(i, 2, 1.0, 1.0, True) for i in range(5)]
    uses = spark.createDataFrame(uses, "task long, base int, v double, weight double, asked boolean")
    models, decided = N.fit(N.packed(sparse(spark, x)).repartition(5), uses, [(b, c) for b in range(3) for c in (0.01, 1.0)], 20, loss)
    models = {(r.base, r.c): np.array(r.w) for r in models.collect()}
    for b in range(2):
        train = np.arange(200) % 3 != b
        for c in (0.01, 1.0):
            want = plain(x[train], y[train], weight[train], c, loss)
            assert np.abs(models[b, c] - want).max() < 1e-6
            got = {r.task: r.decision for r in decided.where((F.col("base") == b) & (F.col("c") == c)).collect()}
            assert set(got) == set(np.flatnonzero(~train)) and all(abs(got[i] - want[0] - x[i] @ want[1:]) < 1e-5 for i in got)
    assert models[2, 1.0][0] == 30 and not models[2, 1.0][1:].any()


def test_ten_thousand_columns(spark):
    rng = np.random.default_rng(4)
    rows, cols = np.repeat(np.arange(300), 30), rng.integers(0, 10_000, 9_000)
    features = spark.createDataFrame([(int(r), int(c), 1.0) for r, c in zip(rows, cols, strict=True)], "row long, col int, cnt double").distinct()
    x = np.zeros((300, 10_000))
    x[rows, cols] = 1
    y = np.where(x[:, :5000].sum(axis=1) > 15, 1.0, -1.0)
    uses = spark.createDataFrame([(i, 0, float(y[i]), 1.0, True) for i in range(300)], "task long, base int, v double, weight double, asked boolean")
    models, decided = N.fit(N.packed(features), uses, [(0, 0.1)], 10_000)
    w = np.array(models.first().w)
    _, slope, _ = N.LOGISTIC(y * (x @ w[1:] + w[0]))
    gradient = 0.1 * np.append((slope * y).sum(), x.T @ (slope * y)) + np.append(0, w[1:])
    assert models.first().converged and np.abs(gradient).max() < 1e-6
    assert np.mean([(r.decision > 0) == (y[r.task] > 0) for r in decided.collect()]) > 0.95


def test_no_convergence_is_an_error(spark):
    x, y = drawn(np.random.default_rng(5), 40, 6)
    uses = spark.createDataFrame([(i, 0, float(y[i]), 1.0, True) for i in range(40)], "task long, base int, v double, weight double, asked boolean")
    with pytest.raises(RuntimeError, match="did not converge"):
        N.fit(N.packed(sparse(spark, x)), uses, [(0, 10.0)], 6, rounds=1)
    assert not N.fit(N.packed(sparse(spark, x)), uses, [(0, 10.0)], 6, rounds=1, strict=False)[0].first().converged
    assert N.fit(N.packed(sparse(spark, x)), uses.limit(0), [], 6)[0].count() == 0


def digest(task):
    return hashlib.md5(str(task).encode()).hexdigest()


def inner_of(task, k):
    return int(hashlib.md5(f"inner{task}".encode()).hexdigest()[:8], 16) % k


def metric(v, z, name):
    said, true = z > 0, v > 0
    if name == "accuracy":
        return np.mean(said == true)
    return 2 * (said & true).sum() / (said.sum() + true.sum()) if said.any() or true.any() else 0.0


def tuned(x, train, grid, inner, name, loss):
    """w and c of one group; train is (task, v, weight)."""
    at, v, weight = (np.array(c) for c in zip(*train, strict=True))
    own = np.array([inner_of(t, inner) for t in at])
    score = {}
    for c in grid:
        each = []
        for f in range(inner):
            held = own == f
            if held.any() and not held.all():
                w = plain(x[at[~held]], v[~held].astype(float), weight[~held], c, loss)
                each.append(metric(v[held], x[at[held]] @ w[1:] + w[0], name))
            elif held.any():
                each.append(metric(v[held], np.zeros(held.sum()), name))
        score[c] = round(float(np.mean(each)), 12)
    c = min(grid, key=lambda c: (-score[c], c))
    return plain(x[at], v.astype(float), weight, c, loss), c


@pytest.mark.parametrize("loss", [N.LOGISTIC, N.HINGE], ids=lambda x: x.name)
def test_votes_equal_plain_version(spark, loss):
    rng = np.random.default_rng(6)
    n, k, inner, grid = 200, 2, 2, (0.05, 1.0)
    x, _ = drawn(rng, n, 8, 0.4)
    tools = ["a", "b", "c"]
    labels = []
    for i in range(n):
        for t, w in zip(tools, rng.normal(size=(3, 8)) if i == 0 else weights, strict=True):
            if i == 0:
                weights = [w] if t == "a" else [*weights, w]
            labels.append((i, t, int(x[i] @ w + rng.normal() > 0), float(np.exp(3 + 0.3 * (x[i] @ w) + rng.normal()) if rng.random() > 0.15 else 900.0)))
    table = {(i, t): (s, time) for i, t, s, time in labels}
    df = written(spark.createDataFrame(labels, "task long, tool string, solve int, time double"))
    fold = written(E.folds(df.select("task").distinct(), k))
    order = sorted(range(n), key=digest)
    of = {t: i % k for i, t in enumerate(order)}
    assert {r.task: r.fold for r in fold.collect()} == of
    tool_models, pair_models, votes = E.linear_votes(df, sparse(spark, x), fold, k, grid, inner, loss=loss)
    got = {(r.task, r.x, r.y): r.p for r in votes.collect()}
    chosen = {(r.x, r.fold): r.c for r in tool_models.collect()}
    chosen |= {(r.x, r.y, r.fold): r.c for r in pair_models.collect()}
    chance = (lambda z: 1 / (1 + np.exp(-z))) if loss.name == "logistic" else (lambda z: (z > 0).astype(float))
    quick = lambda a, b: a < 900 if b >= 900 else a < b
    want = {}
    for f in range(k):
        p = {}
        for t in tools:
            w, c = tuned(x, [(i, 1 if table[i, t][0] == 1 else -1, 1.0) for i in range(n) if of[i] != f], grid, inner, "f1", loss)
            assert chosen[t, f] == c
            p[t] = chance(x @ w[1:] + w[0])
        for a, b in [("a", "b"), ("a", "c"), ("b", "c")]:
            alike = p[a] * p[b] + (1 - p[a]) * (1 - p[b])
            rows = [(i, 1 if quick(table[i, a][1], table[i, b][1]) else -1, alike[i] if loss.name == "logistic" else 1.0) for i in range(n) if of[i] != f and min(table[i, a][1], table[i, b][1]) < 900]
            w, c = tuned(x, rows, grid, inner, "f1", loss)
            assert chosen[a, b, f] == c
            both = chance(x @ w[1:] + w[0])
            want |= {(i, a, b): p[a][i] * (1 - p[b][i]) + alike[i] * both[i] for i in range(n) if of[i] == f}
    assert got.keys() == want.keys() and max(abs(got[q] - want[q]) for q in want) < 1e-6
    assert L.CEILING == 900
