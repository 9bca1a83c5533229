import numpy as np
import pytest
from sylva.llm import graph_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def exact(ids, x, every=100, k=10):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("shard", [6000, 700])
def test_recall_and_exact_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(graph_search, "SHARD", shard)
    at = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(f"{at}/embeddings.parquet").toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    want, got = exact(ids, x), found(graph_search.query(spark, at))
    assert want.keys() == got.keys() and all(len(v) == 10 for v in got.values())
    same = sum(len({a for a, _ in want[q]} & {a for a, _ in got[q]}) for q in want)
    assert same >= 0.95 * sum(map(len, want.values()))
    at = {i: n for n, i in enumerate(ids.tolist())}
    for q, hits in got.items():
        for v, s in hits:
            assert np.isclose(s, np.sqrt(((x[at[q]] - x[at[v]]) ** 2).sum()), rtol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(200, None), (300, []), (400, [0.0, 0.0]), (500, [1.0, nan]), (600, [inf, 1.0]), (700, [1.0, None]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (100, [1.0, 3.0])]
    got = found(graph_search.search(frame(spark, bad + good)))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, 1.0), (100, 3.0)]
    assert [v for v, _ in got[100]] == [0, 1, 2, 3] and got.keys() == {0, 100}
    assert found(graph_search.search(frame(spark, bad))) == {}


def test_many_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    rows = [(i, x[0].tolist() if i % 3 == 0 else x[i % 300].tolist()) for i in range(900)]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert found(graph_search.search(frame(spark, rows))) == exact(ids, v)
