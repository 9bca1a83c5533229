"""Machines on a Kernel (bags) against those on the Gram table of the same bags."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.operators import evaluation as E
from sylva.operators import kernel_machines as V
from sylva.operators import kernels as K
from sylva.plans import queries as Q


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    n, labels = 120, 6
    kinds = rng.integers(0, 4, (40, labels))
    kinds[:, 0] += 1  # no bag is empty
    bag = kinds[rng.integers(0, 40, n)]  # many equal bags
    cells = [(i, f"l{j}", float(bag[i, j])) for i in range(n) for j in range(labels) if bag[i, j]]
    bags = spark.createDataFrame(cells, "graph long, label string, cnt double")
    y = np.where(bag[:, 1] + rng.normal(0, 1.5, n) > 1.4, 1, -1)
    rows = [(x, i, int(y[i]) if x == "a" else 1) for x in "ab" for i in range(n)] + [("a", 500, 1), ("a", 501, -1)]  # tasks without a bag
    return bags, spark.createDataFrame(rows, "x string, task long, v int")


@pytest.mark.parametrize("kind", ["linear", "jaccard"])
@pytest.mark.parametrize("way", ["as it is", "no factors"])
def test_bags_give_the_machines_of_their_table(spark, case, monkeypatch, kind, way):
    bags, train = case
    table, kernel = V.written(K.normalized(K.KERNELS[kind](bags))), V.Kernel(bags, kind)
    if way != "as it is":
        monkeypatch.setattr(V, "WIDTH", 0)
    for c in (10.0,):
        given, made = V.fitted(train, table, "x", grid=(c,)), V.written(V.fitted(train, kernel, "x", grid=(c,)))
        assert made.agg(F.max("gap")).first()[0] < V.TOLERANCE
        coef = [sum(r.coef for r in made.where("x = 'a'").collect()), made.where("x = 'b'").select("coef", "offset").distinct().collect()]
        assert abs(coef[0]) < 1e-6 and [tuple(r) for r in coef[1]] == [(0.0, 1.0)]
        asked = train.select("x", "task").unionByName(spark.createDataFrame([("none", 1)], "x string, task long"))  # a machine that nobody has
        one, two = ({(r.x, r.task): r.decision for r in V.decided(m, g, asked, "x").collect()} for m, g in ((given, table), (made, kernel)))
        assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 0.02
    told = [{(r.x, r.inner, r.c, r.task): r.decision for r in V.cross_decided(train.withColumn("inner", F.pmod("task", F.lit(3)).cast("int")), g, "x", cs=(0.1, 1.0)).collect()} for g in (table, kernel)]
    assert told[0].keys() == told[1].keys() and max(abs(told[0][k] - told[1][k]) for k in told[0]) < 0.02


def test_equal_examples_are_one(case, monkeypatch):
    """The machines of many copies of the tasks are solved on as few examples as without them."""
    rng = np.random.default_rng(5)
    cols, vals = [np.arange(3)] * 30, [r for r in rng.integers(1, 5, (30, 3)).astype(float)]
    y = np.where(rng.random(30) < 0.5, 1.0, -1.0)
    bags, sizes = V._Bags("jaccard", cols, vals, V.MOST), []
    solve = V.solve_dual
    monkeypatch.setattr(V, "solve_dual", lambda k, *a, **b: sizes.append(len(a[0])) or solve(k, *a, **b))
    w, b, gap = V._Own(bags, np.tile(np.arange(30), 8)).solved(np.tile(y, 8), 1.0)
    k = bags.whole[np.ix_(*[np.tile(np.arange(30), 8)] * 2)]
    plain, c, _ = V.solve_svm(k, np.tile(y, 8), 1.0)
    assert sizes[0] <= 30 < sizes[1] and gap < V.TOLERANCE and np.abs(k @ w + b - k @ plain - c).max() < 5e-3


@pytest.mark.parametrize("kind", ["linear", "jaccard"])
def test_parts_of_a_lot_of_many_bags(kind):
    rng = np.random.default_rng(8)
    cols = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(50)]
    vals = [rng.integers(1, 5, 5).astype(float) for _ in cols]
    small, large = (V._Bags(kind, cols, vals, most) for most in (7, V.MOST))
    whole, at, w = large.whole, rng.integers(0, 51, 12), rng.normal(size=9)
    assert not small.factored or kind == "linear"
    small.factored = False
    assert np.allclose(small.gram(at), whole[np.ix_(at, at)]) and np.allclose(small.sums(np.arange(40, 51), np.arange(9), w), whole[40:51, :9] @ w)


def test_many_tasks_in_factors():
    """5,000 tasks of few labels take a fraction of a second, not a block of 200 MB."""
    rng = np.random.default_rng(6)
    x = rng.random((5000, 20))
    y = np.where(x[:, 0] + rng.normal(0, 0.5, 5000) > 0.5, 1.0, -1.0)
    bags = V._Bags("linear", [np.arange(20)] * 5000, list(x), V.MOST)
    assert bags.factored
    w, b, gap = V._Own(bags, np.arange(5000)).solved(y, 10.0)
    margin, a = y * (bags.x[:5000] @ (bags.x[:5000].T @ w) + b), w * y
    assert gap < V.TOLERANCE and (a >= 0).all() and (a <= 10).all() and abs(w.sum()) < 1e-6
    assert (margin[a == 0] > 1 - 2e-3).all() and (margin[a == 10] < 1 + 2e-3).all()


#: Queries of machines, and the tables of pairs that they no longer make.
QUERIES = ["cv_chances", "cv_front", "cv_hyper", "cv_inner", "cv_overall", "cv_pair_chances", "cv_pair_metrics", "cv_pairwise", "cv_quality", "cv_selected", "in_sample", "joint_grid", "kernel_machine_rows", "setting_front", "two_tool_classes"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_table_of_pairs(spark, sf, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("a table with the square of the tasks")

    for module, what in ((K, "normalized"), (E, "normalised_gram"), (V, "both_orders")):
        monkeypatch.setattr(module, what, never)
    assert Q.QUERIES[name](spark, sf).count()
