"""Every query with SQL gives DuckDB's rows; the others hold their own invariants."""

import duckdb
import pytest
from sylva.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: v if v is None or isinstance(v, str | bool) else float(v)
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, sf, duck, name):
    assert rows(Q.QUERIES[name](spark, sf).toArrow()) == rows(duck.execute(Q.SQL[name]).to_arrow_table())


def test_evaluations_give_each_metric(spark, sf):
    for name in ("cv_pairwise", "cv_hyper", "cv_chances"):
        rows = Q.QUERIES[name](spark, sf).collect()
        assert {r.metric for r in rows} == {"accuracy", "spearman", "kendall", "correct"} and all(r.n == 5 for r in rows)
    assert Q.QUERIES["kernel_machine_rows"](spark, sf).select("x", "y").distinct().count() == 10
    best = Q.QUERIES["best_linear_svc"](spark, sf).collect()
    assert len(best) == 4 and sum(r.chosen for r in best) == 1


def test_cross_predicted_covers_each_pair_once(spark, sf):
    out = Q.cross_predicted_pairs(spark, sf)
    got = out.collect()
    assert len({(r.task, r.x, r.y) for r in got}) == len(got) > 0 and all(0 <= r.p <= 1 for r in got)


def test_linear_models_and_components(spark, sf):
    assert Q.linear_svc(spark, sf).count() == Q.lr_weights(spark, sf).count() == 65
    assert Q.pca_components(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
