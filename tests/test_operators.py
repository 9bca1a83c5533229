"""Hand-computed cases and readers."""

import bz2
import json

import pytest
from pyspark.sql import functions as F
from sylva.operators import bags, graphs, kernels, labels, metrics, ranking
from sylva.sources import readers


@pytest.fixture
def two(spark):
    return spark.createDataFrame([("p", "a", 2.0), ("p", "b", 1.0), ("q", "a", 1.0), ("q", "c", 1.0)], "graph string, label string, cnt double")


def value(gram, i="p", j="q"):
    return gram.where((F.col("i") == i) & (F.col("j") == j)).first().v


def test_kernels(two):
    assert value(kernels.linear(two)) == 2
    assert value(kernels.jaccard(two)) == 0.25
    assert round(value(kernels.normalized(kernels.linear(two))), 6) == 0.632456
    assert value(kernels.squared_distance(two)) == 3
    assert value(kernels.euclidean(two)) == 0 and value(kernels.euclidean(two), "p", "p") == 3**0.5


def test_rank_metrics(spark):
    order = lambda names: spark.createDataFrame([(1, n, i, i) for i, n in enumerate(names)], "task int, tool string, pos int, grp int")
    e, p = order("BACD"), order("ABCD")
    assert metrics.spearman(e, p).first().score == 0.8
    assert round(metrics.kendall(e, p).first().score, 6) == 0.666667
    tied = spark.createDataFrame([(1, "A", 0), (1, "B", 0), (1, "C", 1)], "task int, tool string, grp int")
    assert metrics.kendall(tied, order("ABC")).first().score == 1
    assert metrics.accuracy(metrics.tie_broken(tied, order("BAC")), order("BAC")).first().score == 1


def test_borda(spark):
    rows = [(t, n, i) for t, r in enumerate(["ABC", "BAC", "ACB"]) for i, n in enumerate(r)]
    got = ranking.borda(spark.createDataFrame(rows, "task int, tool string, pos int"))
    assert {r.tool: r.points for r in got.collect()} == {"A": 5, "B": 3, "C": 1}


def test_faster_and_score(spark):
    one = spark.range(1)
    f = lambda a, b, m: one.select(labels.faster(F.lit(a), F.lit(b), m).alias("v")).first().v
    assert (f(950.0, 1000.0, False), f(10.0, 1000.0, False), f(950.0, 1000.0, True)) == (False, True, True)
    s = lambda a, b: one.select(labels.competition_score(F.lit(a), F.lit(b)).alias("v")).first().v
    assert [s(*x) for x in (("true", "true"), ("false", "false"), ("false", "true"), ("true", "false"), ("unknown", "true"))] == [2, 1, -6, -12, 0]


def test_unsolved_in_time_is_half_a_vote(spark):
    t = spark.createDataFrame([(1, "A", 0, 950.0), (1, "B", 0, 990.0)], "task int, tool string, solve int, time double")
    got = ranking.with_ties(t).collect()
    assert {r.votes for r in got} == {0.5} and {r.grp for r in got} == {0}


def test_graph_reader(spark, tmp_path):
    g = {"nodes": {"1": "INIT", "2": "RETURN", "1_0": "INT"}, "edges": [["1", "cfg|>", "2"], ["2", "<|dd", "1"]]}
    (tmp_path / "x.dfs").write_text(json.dumps(g))
    (tmp_path / "y.dfs").write_text("null")
    nodes, edges = readers.program_graphs(spark, str(tmp_path))
    assert {(r.src, r.etype, r.dst) for r in edges.collect()} == {("1", "cfg", "2"), ("1", "dd", "2"), ("1_0", "s", "1")}
    depth = {r.node: r.depth for r in graphs.depth_labels(nodes, edges).collect()}
    assert depth == {"1": 0, "2": 0, "1_0": 1} and {r.graph for r in nodes.collect()} == {"x"}


def test_result_readers(spark, tmp_path):
    xml = '<result benchmarkname="T"><run name="../c/CAT/N_true-unreach-call.c" properties="unreach-call"><column title="status" value="true"/><column title="cputime" value="12.5s"/></run></result>'
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    r = readers.tool_results(spark, str(tmp_path / "a.xml.bz2")).first()
    assert (r.tool, r.status, r.cputime, r.props, r.walltime) == ("T", "true", 12.5, ["unreach-call"], None)
    (tmp_path / "b.csv").write_text("tool\tT\t\nh\nh\nc/x.c\ttrue\t3.5\nc/y.c\tfalse\t4\n")
    assert [(r.tool, r.vtask, r.cputime) for r in readers.tsv_results(spark, str(tmp_path / "b.csv")).collect()] == [("T", "c/x.c", 3.5), ("T", "c/y.c", 4.0)]


def test_bag_and_line_readers(spark, tmp_path):
    (tmp_path / "N_1_5.json").write_text(json.dumps({"file": "N.c", "kernel_bag": {"a": 2, "b": 1}}))
    assert sorted(map(tuple, readers.bags(spark, str(tmp_path / "*.json")).collect())) == [("N", 1, 5, "a", 2.0), ("N", 1, 5, "b", 1.0)]
    (tmp_path / "nodes.labels").write_text("12,INT\nbad\n13,IF\n")
    assert readers.labelled_lines(spark, str(tmp_path / "nodes.labels"), ["node", "label"]).count() == 2


def test_paths(spark):
    one = spark.createDataFrame([("a/sv-benchmarks/c/loops/x_true-unreach-call.c",), ("other",)], "p string")
    assert [r[0] for r in one.select(bags.category_of(F.col("p"))).collect()] == ["loops", "unknown"]
    assert [r[0] for r in one.select(labels.expected_status(F.col("p"))).collect()] == ["true", None]
    assert one.select(bags.properties_of(F.col("p"))).first()[0] == ["reachability"]
