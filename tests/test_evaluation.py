"""Evaluation drivers against nested loops in numpy on 60 tasks: folds, machines, votes, rankings and scores."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.operators import evaluation as E
from sylva.operators import kernel_machines as V
from sylva.session import written
from test_linear_models import inner_of, metric

N, TOOLS = 60, ["a", "b", "c"]
PAIRS = [("a", "b"), ("a", "c"), ("b", "c")]


class Case:
    """Labels and a Gram, as numbers and as tables."""

    def __init__(self, spark, seed, n=N):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(n, 4))
        self.n, self.k = n, (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
        self.solve, self.time = {}, {}
        for j, t in enumerate(TOOLS):
            for i in range(n):
                self.solve[i, t] = int(x[i, j] + 0.7 * rng.normal() > 0)
                self.time[i, t] = round(float(np.exp(3 + x[i, 3] * (j - 1) + 0.4 * rng.normal())), 4) if rng.random() > 0.15 else 900.0
        self.labels = written(spark.createDataFrame([(i, t, self.solve[i, t], self.time[i, t]) for i in range(n) for t in TOOLS], "task long, tool string, solve int, time double"))
        self.gram = written(spark.createDataFrame([(i, j, float(self.k[i, j])) for i in range(n) for j in range(i, n)], "i long, j long, v double"))

    def quick(self, i, a, b):
        a, b = self.time[i, a], self.time[i, b]
        return a < 900 if b >= 900 else a < b

    def preferred(self, i, a, b):
        if self.solve[i, a] != self.solve[i, b]:
            return 1 if self.solve[i, a] > self.solve[i, b] else -1
        if self.time[i, a] >= 900 and self.time[i, b] >= 900:
            return 0
        return 1 if self.time[i, a] < self.time[i, b] else -1


def folds(tasks, k):
    order = sorted(tasks, key=lambda t: (hashlib.md5(str(t).encode()).hexdigest(), t))
    return {t: i % k for i, t in enumerate(order)}


def machine(k, tasks, v, grid, name="accuracy", inner=1):
    """(tasks, w, b, c) of one machine, C chosen as the library says."""
    tasks, v = zip(*sorted(zip(tasks, v, strict=True)), strict=True)
    tasks, y = np.array(tasks), np.array(v, float)
    c = grid[0]
    if len(grid) > 1:
        own = np.array([inner_of(t, inner if inner > 1 else 3) for t in tasks])
        scores = {}
        for c in grid:
            each = []
            for f in range(inner):
                held = own == f
                if held.any() and not held.all():
                    w, b, _ = V._trained(k[np.ix_(tasks[~held], tasks[~held])], y[~held], c)
                    each.append(metric(y[held], k[np.ix_(tasks[held], tasks[~held])] @ w + b, name))
            scores[c] = round(float(np.mean(each)), 12) if each else None
        c = min(grid, key=lambda c: (-scores[c], c)) if all(s is not None for s in scores.values()) else grid[0]
    w, b, _ = V._trained(k[np.ix_(tasks, tasks)], y, c)
    return tasks, w, b, c


def told(k, m, i):
    tasks, w, b, _ = m
    return k[i, tasks] @ w + b


def chance(k, m, v, i):
    tasks, _, _, c = m
    y = np.array([v[t] for t in tasks], float)
    slope, shift = (30.0, 0.0) if y.min() == y.max() else V.platt(V._apart(k[np.ix_(tasks, tasks)], y, c), y)
    return 1 / (1 + np.exp(-(slope * told(k, m, i) + shift)))


def pair_votes(case, fold, train_of, grid, chances=False, tested=None, **inner):
    """{(task, x, y): p} and {(x, y, fold): c} of machines of pairs; train_of(f) are the tasks that a fold's machines learn from."""
    votes, cs = {}, {}
    for f in sorted(set(fold.values())):
        for a, b in PAIRS:
            v = {i: case.preferred(i, a, b) for i in train_of(f)}
            v = {i: s for i, s in v.items() if s}
            m = machine(case.k, list(v), list(v.values()), grid, **inner)
            cs[a, b, f] = m[3]
            for i in fold:
                if fold[i] == f:
                    votes[i, a, b] = chance(case.k, m, v, i) if chances else float(told(case.k, m, i) > 0)
    return votes, cs


def hyper_votes(case, fold, train_of, grid, chances=False, tools=TOOLS, **inner):
    votes = {}
    for f in sorted(set(fold.values())):
        here = [i for i in fold if fold[i] == f]

        def say(v):
            m = machine(case.k, list(v), list(v.values()), grid, **inner)
            return {i: chance(case.k, m, v, i) if chances else float(told(case.k, m, i) > 0) for i in here}  # noqa: B023

        own = {t: say({i: 1 if case.solve[i, t] == 1 else -1 for i in train_of(f)}) for t in tools}
        for a, b in [p for p in PAIRS if p[0] in tools and p[1] in tools]:
            p = say({i: 1 if case.quick(i, a, b) else -1 for i in train_of(f) if min(case.time[i, a], case.time[i, b]) < 900})
            for i in here:
                x, y = own[a][i], own[b][i]
                votes[i, a, b] = x * (1 - y) + (x * y + (1 - x) * (1 - y)) * p[i]
    return votes


def ranking(votes, i):
    sums = dict.fromkeys(TOOLS, 0.0)
    for (t, a, b), p in votes.items():
        if t == i:
            sums[a] += p
            sums[b] += 1 - p
    return sorted(sorted(TOOLS, reverse=True), key=lambda t: -round(sums[t], 6))


def expected(case, i):
    votes = {}
    for a, b in PAIRS:
        s = case.solve[i, a] - case.solve[i, b]
        votes[i, a, b] = float(s > 0) if s else float(case.quick(i, a, b))
    return ranking(votes, i)


def spearman(e, p):
    n = len(e)
    return 1 - 6 * sum((e.index(t) - p.index(t)) ** 2 for t in e) / (n * (n * n - 1))


def right(case, i, guess):
    return float(case.solve[i, guess[0]] == 1 or not any(case.solve[i, t] == 1 for t in TOOLS))


def scores(case, votes, tasks):
    """{metric: {task: score}}."""
    guess = {i: ranking(votes, i) for i in tasks}
    return {
        "accuracy": {i: float(guess[i][0] == expected(case, i)[0]) for i in tasks},
        "spearman": {i: spearman(expected(case, i), guess[i]) for i in tasks},
        "correct": {i: right(case, i, guess[i]) for i in tasks},
    }


def over_folds(each, fold):
    by = {}
    for i, s in each.items():
        by.setdefault(fold[i], []).append(s)
    means = [np.mean(v) for v in by.values()]
    return np.mean(means), np.std(means), len(means)


NAMES = ["accuracy", "spearman", "correct"]


def same(got, want):
    """Summaries (metric, mean, std, n) against {metric: (mean, std, n)}."""
    got = {r.metric: (r.mean, r.std, r.n) for r in got.collect()}
    assert got.keys() == want.keys()
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=1e-6), m


@pytest.fixture(scope="module")
def case(spark):
    return Case(spark, 11)


def outside(fold):
    return lambda f: [i for i in fold if fold[i] != f]


@pytest.mark.parametrize(("how", "chances", "grid", "inner"), [
    ("pairs", False, (0.1, 1.0, 10.0), {}), ("pairs", False, (0.1, 10.0), {"metric": "f1", "inner": 3}), ("pairs", True, (1.0,), {}),
    ("hyper", False, (0.1, 10.0), {}), ("hyper", True, (1.0,), {}),
])
def test_crossed_machines(case, how, chances, grid, inner):
    fold = folds(range(N), 4)
    plain = {"name" if n == "metric" else n: v for n, v in inner.items()}
    out = E.Crossed(case.labels, case.gram, 4, how, grid, chances, NAMES, **inner)
    votes, cs = pair_votes(case, fold, outside(fold), grid, chances, **plain) if how == "pairs" else (hyper_votes(case, fold, outside(fold), grid, chances, **plain), None)
    got = {(r.task, r.x, r.y): r.p for r in out.votes.collect()}
    assert got.keys() == votes.keys() and max(abs(got[q] - votes[q]) for q in votes) < 1e-5
    each = scores(case, votes, range(N))
    same(out.summary(), {m: over_folds(each[m], fold) for m in NAMES})
    if cs:
        means = {f: round(np.mean([each["spearman"][i] for i in range(N) if fold[i] == f]), 12) for f in range(4)}
        best = min(means, key=lambda f: (-means[f], f))
        assert {(r.fold, r.x, r.y): r.c for r in out.best_fold("spearman").collect()} == {(best, a, b): cs[a, b, best] for a, b in PAIRS}
        by = {(r.x, r.y, r.metric): (r.mean, r.std, r.n) for r in out.pair_metrics().collect()}
        for a, b in PAIRS:
            for name in ("accuracy", "f1"):
                parts = []
                for f in range(4):
                    own = [i for i in range(N) if fold[i] == f and case.preferred(i, a, b)]
                    parts.append(metric(np.array([case.preferred(i, a, b) for i in own]), np.array([votes[i, a, b] - 0.5 for i in own]), name))
                assert by[a, b, name] == pytest.approx((np.mean(parts), np.std(parts), 4), abs=1e-9)


def test_in_sample(case):
    machines, got = E.in_sample(case.labels, case.gram, (1.0,), NAMES)
    votes, _ = pair_votes(case, dict.fromkeys(range(N), 0), lambda _: range(N), (1.0,))
    each = scores(case, votes, range(N))
    assert {r.metric: (r.mean, r.n) for r in got.collect()} == {m: (pytest.approx(np.mean(list(each[m].values()))), N) for m in NAMES}
    v = {i: case.preferred(i, "a", "b") for i in range(N) if case.preferred(i, "a", "b")}
    tasks, w, b, _ = machine(case.k, list(v), list(v.values()), (1.0,))
    rows = machines.where("x = 'a' and y = 'b' and coef <> 0").collect()
    assert {r.task: r.coef for r in rows} == pytest.approx({t: x for t, x in zip(tasks.tolist(), w, strict=True) if x}, abs=1e-9) and rows[0].offset == pytest.approx(b)


def test_quality_from_machines(case):
    fold = folds(range(N), 4)
    want = {m: {} for m in NAMES}
    for f in range(4):
        train = [i for i in range(N) if fold[i] != f]
        rate = {t: np.mean([case.solve[i, t] == 1 for i in train]) for t in TOOLS}
        ms = {t: machine(case.k, train, [1 if case.solve[i, t] == 1 else -1 for i in train], (0.1, 1.0)) for t in TOOLS}
        for i in range(N):
            if fold[i] == f:
                guess = sorted(TOOLS, key=lambda t: (-int(told(case.k, ms[t], i) > 0), -rate[t], t))  # noqa: B023
                want["accuracy"][i] = float(guess[0] == expected(case, i)[0])
                want["spearman"][i], want["correct"][i] = spearman(expected(case, i), guess), right(case, i, guess)
    same(E.cross_quality(case.labels, case.gram, 4, (0.1, 1.0), NAMES), {m: over_folds(want[m], fold) for m in NAMES})


def test_training_on_all_properties(spark, case):
    of = {i: (i // 2, "pq"[i % 2]) for i in range(N)}  # each file in both properties
    tasks = spark.createDataFrame([(i, f, p) for i, (f, p) in of.items()], "task long, file long, prop string")
    got = {(r.prop, r.metric): (r.mean, r.std, r.n) for r in E.cross_overall(case.labels, tasks, case.gram, 3, (1.0,), NAMES).collect()}
    fold = folds(range(N // 2), 3)
    for prop in "pq":
        here = {i: fold[f] for i, (f, p) in of.items() if p == prop}
        votes, _ = pair_votes(case, here, lambda f: [i for i in range(N) if fold[of[i][0]] != f], (1.0,))
        each = scores(case, votes, list(here))
        for m in NAMES:
            assert got[prop, m] == pytest.approx(over_folds(each[m], here), abs=1e-6)


def test_two_tools(case):
    fold = folds(range(N), 3)
    votes = hyper_votes(case, fold, outside(fold), (1.0,), tools=["a", "b"])
    got = {r.task: (r.predicted, r.expected) for r in E.two_tool_classes(case.labels, case.gram, "a", "b", 3, (1.0,)).collect()}
    assert got == {i: ("a" if votes[i, "a", "b"] > 0.5 else "b", truth(case, i)) for i in range(N)}


def truth(case, i):
    a, b = case.solve[i, "a"] == 1, case.solve[i, "b"] == 1
    if a != b:
        return "a" if a else "b"
    return "a" if case.time[i, "a"] < case.time[i, "b"] else "b"


def test_joint_grid(case):
    """All triples by loops over fits, for two settings of which one is a worse Gram."""
    grid, k, inner = (0.05, 5.0), 2, 2
    other = case.gram.withColumn("v", F.col("v") * F.col("v"))
    best, means = E.joint_grid(case.labels, {"own": case.gram, "squared": other}, "b", "a", k, inner, grid)
    fold = folds(range(N), k)
    grams = {"own": case.k, "squared": case.k**2}

    def decisions(gram, train, test, c):
        rows = {"sx": {i: 1 if case.solve[i, "a"] == 1 else -1 for i in train}, "sy": {i: 1 if case.solve[i, "b"] == 1 else -1 for i in train},
                "st": {i: 1 if case.quick(i, "a", "b") else -1 for i in train if min(case.time[i, "a"], case.time[i, "b"]) < 900}}
        out = {}
        for n, v in rows.items():
            m = machine(gram, list(v), list(v.values()), (c[n],))
            out[n] = {i: told(gram, m, i) > 0 for i in test}
        return out

    def share(gram, train, test, c):
        d = decisions(gram, train, test, c)
        take = {i: (d["sx"][i] and not d["sy"][i]) or (d["sx"][i] == d["sy"][i] and d["st"][i]) for i in test}
        return np.mean([("a" if take[i] else "b") == truth(case, i) for i in test])

    want = {}
    for f in range(k):
        train = [i for i in range(N) if fold[i] != f]
        for name, gram in grams.items():
            for cx in grid:
                for cy in grid:
                    for ct in grid:
                        c = {"sx": cx, "sy": cy, "st": ct}
                        parts = [share(gram, [i for i in train if inner_of(i, inner) != e], [i for i in train if inner_of(i, inner) == e], c) for e in range(inner)]
                        want[f, name, cx, cy, ct] = round(float(np.mean(parts)), 12)
    assert {(r.fold, r.setting, r.cx, r.cy, r.ct): r["mean"] for r in means.collect()} == pytest.approx(want, abs=1e-9)
    for r in best.collect():
        q = min((q for q in want if q[0] == r.fold), key=lambda q: (-want[q], q))
        assert (r.fold, r.setting, r.cx, r.cy, r.ct) == q
        test = [i for i in range(N) if fold[i] == r.fold]
        assert r.test == pytest.approx(share(grams[r.setting], [i for i in range(N) if fold[i] != r.fold], test, {"sx": r.cx, "sy": r.cy, "st": r.ct}))


def test_fronts(case):
    """Settings and the nested front: a Gram, its square and noise."""
    names = ("spearman", "correct")
    grams = {"own": case.k, "cube": case.k**3}
    tables = {"own": case.gram, "cube": case.gram.withColumn("v", F.pow("v", F.lit(3)))}

    def mean(gram, tasks, k):
        fold = folds(tasks, k)
        was, case.k = case.k, gram
        votes, _ = pair_votes(case, fold, outside(fold), (1.0,))
        case.k = was
        each = scores(case, votes, list(tasks))
        return tuple(over_folds(each[m], fold)[0] for m in names)

    def front(means):
        return {s for s, v in means.items() if not any(all(x >= y for x, y in zip(w, v, strict=True)) and w != v for t, w in means.items() if t != s)}

    means = {s: mean(g, range(N), 3) for s, g in grams.items()}
    got = {r.setting: (tuple(r[m] for m in names), r.front) for r in E.cross_settings(case.labels, tables, 3, (1.0,), names).collect()}
    for s in grams:
        assert got[s][0] == pytest.approx(means[s], abs=1e-9) and got[s][1] == (s in front(means))
    fold = folds(range(N), 2)
    want = {}
    for f in range(2):
        train, test = [i for i in range(N) if fold[i] != f], [i for i in range(N) if fold[i] == f]
        for s in front({s: mean(g, train, 2) for s, g in grams.items()}):
            was, case.k = case.k, grams[s]
            votes, _ = pair_votes(case, dict.fromkeys(test, f), lambda _: train, (1.0,))  # noqa: B023
            case.k = was
            each = scores(case, votes, test)
            want[f, s] = tuple(float(np.mean(list(each[m].values()))) for m in names)
    got = {(r.fold, r.setting): tuple(r[m] for m in names) for r in E.cross_front(case.labels, tables, 2, 2, (1.0,), names).collect()}
    assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q], abs=1e-9) for q in want)


def test_selected_labels(spark):
    """Machines on the labels that selection keeps of each fold's training bags."""
    rng = np.random.default_rng(9)
    case = Case(spark, 12, 30)
    counts = rng.integers(0, 4, (30, 6)) * (rng.random((30, 6)) < [1, 1, 0.9, 0.8, 0.1, 0.1])
    bags = spark.createDataFrame([(i, f"l{j}", float(counts[i, j])) for i in range(30) for j in range(6) if counts[i, j]], "graph long, label string, cnt double")
    from sylva.operators import selection as S

    got = E.cross_selected(case.labels, bags, [lambda b: S.by_sum(b, 3)], 2, (1.0,), ["spearman"])
    fold, votes = folds(range(30), 2), {}
    for f in range(2):
        train = [i for i in range(30) if fold[i] != f]
        kept = sorted(range(6), key=lambda j: (-counts[train, j].sum(), j))[:3]  # noqa: B023
        x = counts[:, kept].astype(float)
        norm = np.sqrt((x * x).sum(1))
        case.k = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((30, 30)), where=np.outer(norm, norm) > 0)
        votes |= hyper_votes(case, {i: f for i in range(30) if fold[i] == f}, lambda _: train, (1.0,))  # noqa: B023
    same(got, {"spearman": over_folds(scores(case, votes, range(30))["spearman"], fold)})
