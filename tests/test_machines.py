"""Kernel machines, reductions, graphs with cycles and odd cases, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.operators import evaluation as E
from sylva.operators import graphs as G
from sylva.operators import kernel_machines as V
from sylva.operators import kernels as K
from sylva.operators import labels as L
from sylva.operators import learners as C
from sylva.operators import ranking as R
from sylva.operators import reduction as D
from sylva.session import drop_written, tables_written, written
from sylva.sources import readers as S


def test_machine_meets_its_conditions():
    rng = np.random.default_rng(0)
    for c in (0.1, 1.0, 50.0):
        x = rng.normal(size=(60, 3))
        y = np.where(x @ [1, -2, 0.5] + rng.normal(0, 0.7, 60) > 0, 1.0, -1.0)
        k = x @ x.T
        w, b, _ = V.solve_svm(k, y, c, 1e-6)
        a, margin = w * y, y * (k @ w + b)
        assert (a >= -1e-9).all() and (a <= c + 1e-9).all() and abs(w.sum()) < 1e-6
        assert (margin[a < 1e-7] >= 1 - 1e-3).all() and (margin[a > c - 1e-7] <= 1 + 1e-3).all()
        inner = (a > 1e-5) & (a < c - 1e-5)
        assert np.allclose(margin[inner], 1, atol=1e-3)


def test_fitted_machines_decide_as_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    k = x @ x.T
    gram = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(40) for j in range(i, 40)], "i long, j long, v double")
    rows = [("a", i, int(y[i])) for i in range(30)] + [("b", i, 1) for i in range(10)]
    train = spark.createDataFrame(rows, "g string, task long, v int")
    machines = V.fitted(train, gram, "g", grid=(1.0,))
    asked = spark.createDataFrame([(g, i) for g in "ab" for i in range(30, 40)], "g string, task long")
    got = {(r.g, r.task): r.decision for r in V.decided(machines, gram, asked, "g").collect()}
    w, b, _ = V.solve_svm(k[:30, :30], y[:30].astype(float), 1.0)
    assert all(math.isclose(got["a", i], float(k[i, :30] @ w + b), abs_tol=1e-6) for i in range(30, 40))
    assert all(got["b", i] == 1.0 for i in range(30, 40))


def test_chances_follow_decisions():
    d = np.linspace(-3, 3, 50)
    slope, shift = V.platt(d, np.where(d > 0.2, 1.0, -1.0))
    p = 1 / (1 + np.exp(-(slope * d + shift)))
    assert slope > 0 and p[0] < 0.1 and p[-1] > 0.9


def test_folds_differ_by_one(spark):
    tasks = spark.range(103).withColumnRenamed("id", "task")
    sizes = sorted(r["count"] for r in E.folds(tasks, 10).groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3
    assert E.split(tasks).where("test").count() == math.ceil(0.33 * 103)


def test_unknown_metric(spark):
    labels = spark.createDataFrame([(1, "a", 1, 2.0), (1, "b", 0, 3.0)], "task int, tool string, solve int, time double")
    with pytest.raises(ValueError, match="unknown metric"):
        E.scored(E.Ranked(labels, R.full(labels)), ["beauty"])
    got = {r.metric: r.score for r in E.scored(E.Ranked(labels, R.full(labels))).collect()}
    assert len(got) == 12 and got["accuracy"] == got["spearman"] == 1.0 and math.isclose(got["time"], 0.4)


def test_components_and_scaling_follow_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 4)) * [5, 3, 1, 0.2]
    k = x @ x.T
    gram = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(25) for j in range(i, 25)], "i int, j int, v double")
    whole = written(D.whole(gram))
    got = np.array([r.x for r in D.kernel_components(whole, 2).orderBy("id").collect()])
    h = np.eye(25) - 1 / 25
    value, vector = np.linalg.eigh(h @ k @ h)
    want = vector[:, ::-1][:, :2] * np.sqrt(value[::-1][:2])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)
    values, rows = D.singular_rows(spark.createDataFrame([(i, j, float(x[i, j])) for i in range(25) for j in range(4)], "row int, col int, cnt double"), 2)
    assert np.allclose(values, np.linalg.svd(x)[1][:2], rtol=1e-4) and rows.count() == 25
    away = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2))
    d = spark.createDataFrame([(i, j, float(away[i, j])) for i in range(25) for j in range(25)], "i int, j int, v double")
    stress, _ = D.scaled(d, 2, 15)
    assert stress < 0.1 * (away**2).sum() / 2


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([("g", "a", "b", "s"), ("g", "b", "c", "s"), ("g", "c", "a", "s"), ("g", "d", "a", "s"), ("g", "e", "d", "t")], "graph string, src string, dst string, etype string")
    roots = spark.createDataFrame([("g", "a")], "graph string, node string")
    assert sorted(r.node for r in G.closure(edges, "s", roots).collect()) == ["a", "b", "c", "d"]
    chain = spark.createDataFrame([("g", i, i + 1, "s") for i in range(64)], "graph string, src int, dst int, etype string")
    assert {r.label for r in G.connected(chain).collect()} == {0}
    assert G.closure(chain, "t", spark.createDataFrame([("g", 0)], "graph string, node int")).count() == 0


def test_long_suffixes(spark):
    paths = ["a" + "x" * 300, "b" + "x" * 300, "x" * 300, "short", "q" * 70]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.suffix for r in G.shortest_unique_suffix(df).collect()}
    assert got == {paths[0]: paths[0], paths[1]: paths[1], paths[2]: paths[2], "short": "t", paths[4]: "q"}


def test_hot_labels_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    bags = spark.createDataFrame([(g, w, float(rng.randrange(1, 4))) for g in range(30) for w in ["hot", *rng.sample("abcdefgh", 3)]], "graph int, label string, cnt double")
    whole = {(r.i, r.j): r.v for r in K.linear(bags).collect()}
    alike = {(r.i, r.j): round(r.v, 9) for r in K.jaccard(bags).collect() if r.i < r.j and r.v >= 0.6}
    monkeypatch.setattr(K, "HOT", 4)
    assert {(r.i, r.j): r.v for r in K.linear(bags).collect()} == whole and len(whole) == 30 * 31 // 2
    assert {(r.i, r.j): round(r.v, 9) for r in K.similar(bags, 0.6).collect()} == alike and alike


def test_two_witness_checks_are_an_error(spark):
    results = spark.createDataFrame([(1, "false"), (2, "false")], "vtask int, status string")
    once = spark.createDataFrame([(1, False)], "vtask int, confirmed boolean")
    assert sorted((r.vtask, r.status) for r in L.witnessed(results, once).collect()) == [(1, "unknown"), (2, "false")]
    with pytest.raises(Exception, match="several witness checks"):
        L.witnessed(results, once.union(once)).collect()


def test_task_twice_in_a_file_is_an_error(spark, tmp_path):
    run = '<run name="c/x_true-unreach-call.c" properties="unreach-call"><column title="status" value="true"/></run>'
    (tmp_path / "t.18-12-01.results.sv-comp18.cat.xml").write_text(f'<result tool="t">{run}{run}</result>')
    with pytest.raises(Exception, match="twice in one file"):
        S.category_results(spark, f"{tmp_path}/*.xml", "cat")[0].collect()
    with pytest.raises(ValueError, match="no results for other"):
        S.read_categories(spark, f"{tmp_path}/*.xml", ["cat", "other"], skip_missing=False)


def test_slices_without_labels_are_an_error(spark):
    index = spark.createDataFrame([("p", 1), ("q", 2)], "prop string, idx long")
    chosen = spark.createDataFrame([(1,), (2,)], "idx long")
    assert L.rows_of_slice(chosen, index, ["p", "q"]).count() == 2
    with pytest.raises(ValueError, match="1 graphs have no label"):
        L.rows_of_slice(chosen, index, ["p"])


def test_packed_triangles(spark):
    for n in (1, 2, 7, 40):
        cells = [(i, i) for i in range(n)] + [(i, j) for i in range(n) for j in range(i + 1, n)]
        df = spark.createDataFrame([(x, y, p) for p, (x, y) in enumerate(cells)], "x long, y long, p long")
        out = df.select("*", L.packed_index(F.col("y"), F.col("x"), F.lit(n)).alias("q"), L.unpacked_index(F.col("p"), F.lit(n)).alias("c")).collect()
        assert all(r.p == r.q and (r.c.x, r.c.y) == (r.x, r.y) for r in out)


def test_skip_gram_parts_topics(spark):
    rng = random.Random(2)
    topics = [[f"{t}{i}" for i in range(8)] for t in "ab"]
    sentences = spark.createDataFrame([([rng.choice(topics[k % 2]) for _ in range(12)],) for k in range(600)], "words array<string>")
    v = {r.word: np.array(r.v) / np.linalg.norm(r.v) for r in C.skip_gram(sentences.repartition(2)).collect()}
    same = [v[a] @ v[b] for t in topics for a in t for b in t if a < b]
    other = [v[a] @ v[b] for a in topics[0] for b in topics[1]]
    assert len(v) == 16 and np.mean(same) > np.mean(other) + 0.3


def test_skip_grams_of_few_words_stay_bounded_in_any_order():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 16, 12_000)
    pairs = np.stack([w, w // 8 * 8 + rng.integers(0, 8, len(w))])  # two topics of 8 words
    given = np.stack([rng.uniform(-0.05, 0.05, (16, 10)), np.zeros((16, 10))])
    for order in range(3):
        some = np.random.default_rng(order).permutation(pairs, axis=1)
        own, out, seen = C.contrasted(iter(np.array_split(some, 3, axis=1)), given, np.bincount(w, minlength=16).astype(float), 0.1, 15)
        v = own / np.linalg.norm(own, axis=1, keepdims=True)
        assert np.abs(own).max() < 10 and np.abs(out).max() < 10 and seen.sum() == 17 * len(w)
        assert (v @ v.T)[:8, :8].mean() > (v @ v.T)[:8, 8:].mean() + 0.3


def test_skip_grams_of_one_word_again_and_again_stay_bounded():
    rng = np.random.default_rng(0)
    pairs = np.stack([np.repeat(rng.integers(0, 500, 40), 500), np.repeat(rng.integers(0, 500, 40), 500)])
    counts, given = np.ones(500), np.stack([rng.uniform(-0.05, 0.05, (500, 10)), np.zeros((500, 10))])
    own, out, _ = C.contrasted(iter([pairs]), given, counts, 0.1, 15)
    assert np.abs(own).max() < 10 and np.abs(out).max() < 10


def test_tables_are_dropped(spark):
    before = len(tables_written(spark))
    a, b = written(spark.range(3)), written(spark.range(4))
    drop_written(spark, before, keep=1)
    assert len(tables_written(spark)) == before + 1 and b.count() == 4
    with pytest.raises(Exception, match="(?i)does not exist|not found|No such file"):
        a.collect()


def test_cross_predicted_finds_a_plain_rule(spark):
    rng = random.Random(3)
    rows = [(i, "a", "b", 1 if (x := rng.uniform(-1, 1)) > 0 else -1, [x, rng.uniform(-1, 1)]) for i in range(300)]
    pairs = spark.createDataFrame([r[:4] for r in rows], "task int, x string, y string, v int")
    features = spark.createDataFrame([(r[0], r[4]) for r in rows], "task int, features array<double>")
    p = {r.task: r.p for r in C.cross_predicted(pairs, features, 3).collect()}
    assert sum((p[r[0]] > 0.5) == (r[3] > 0) for r in rows) >= 285


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from sylva.operators.selection import normal_quantile

    p = [0.0005, 0.01, 0.07, 0.075, 0.2, 0.5, 0.6, 0.925, 0.93, 0.9995]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(math.isclose(r.z, NormalDist().inv_cdf(r.p), abs_tol=1e-9) for r in got)


def test_whitened_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) * [4, 2, 1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pcs = np.array([r.pcs for r in C.principal(rows, 3, 1.0, whiten=True).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(pcs.std(axis=0, ddof=1), 1) and np.allclose(np.abs(pcs), np.abs(u * np.sqrt(79)), atol=1e-6)


def test_nearest_in_parts(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    x[50] = x[60] = x[70]  # ties
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    queries = vectors.where("id % 10 = 0").select(F.col("id").alias("q"), "v")
    got = {(r.q, r["rank"]): r.id for r in C.nearest_by_cosine(queries, vectors, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        d = np.round(1 - unit @ unit[q], 12)
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:4]
        assert [got[q, r] for r in range(1, 5)] == want


def test_torn_graphs_are_left_out(spark):
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1)], "graph string, node int").withColumn("label", F.lit("x"))
    edges = spark.createDataFrame([("a", 1, 2, "s"), ("b", 1, 2, "s")], "graph string, src int, dst int, etype string")
    kept, links, torn = S.whole_graphs(nodes, edges)
    assert {r.graph for r in kept.collect()} == {"a", "c"} and [r.graph for r in links.collect()] == ["a"]
    assert [(r.graph, r.parts) for r in torn.collect()] == [("b", 2)]


def test_old_row_tags_and_sizes(spark, tmp_path):
    """Rows of the old form (sourcefile), a packed file, witness checks told apart, and tasks of known and small size only."""
    import bz2

    rows = lambda tag, names: "".join(f'<{tag} name="c/{n}.c" properties="unreach-call"><column title="status" value="true"/><column title="cputime" value="1.5s"/></{tag}>' for n in names)
    (tmp_path / "old.17-12-01.results.sv-comp17.cat.xml").write_text(f'<result benchmarkname="old">{rows("sourcefile", "ab")}</result>')
    with bz2.open(tmp_path / "new.18-12-01.results.sv-comp18.cat.xml.bz2", "wt") as f:
        f.write(f'<result tool="new">{rows("run", "abc")}</result>')
    (tmp_path / "new.18-12-01.18-12-02.witness.sv-comp18.cat.xml").write_text(f'<result tool="new">{rows("run", "a")}</result>')
    results, checks = S.category_results(spark, f"{tmp_path}/*.xml*", "cat")
    assert sorted((r.tool, r.vtask, r.status, r.cputime) for r in results.collect()) == [(t, f"c/{n}.c", "true", 1.5) for t, names in (("new", "abc"), ("old", "ab")) for n in names]
    assert [(r.tool, r.vtask) for r in checks.collect()] == [("new", "c/a.c")]
    sizes = spark.createDataFrame([("c/a.c", 10), ("c/b.c", 99)], "vtask string, size int")
    small, _ = S.category_results(spark, f"{tmp_path}/*.xml*", "cat", sizes, 50)
    assert sorted((r.tool, r.vtask) for r in small.collect()) == [("new", "c/a.c"), ("old", "c/a.c")]
    assert S.category_results(spark, f"{tmp_path}/*.xml*", "cat", sizes)[0].count() == 4
