"""Weisfeiler-Lehman steps on paths in rows against those on nodes and edges."""

from pyspark.sql import functions as F
from sylva.operators import bags as B
from sylva.operators import graphs as G
from sylva.plans import queries as Q


def test_paths_give_the_bags_of_their_graphs(spark):
    texts = [(0, "a b a b c"), (1, "a"), (2, ""), (3, None), (4, "a  a"), (5, "b c"), (6, " ".join("xyzzy" * 60))]
    paths = spark.createDataFrame(texts, "graph long, text string").select("graph", F.split("text", " ").alias("labels"))
    nodes = paths.select("graph", F.posexplode("labels").alias("node", "label"))
    edges = nodes.where("node > 0").select("graph", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"), F.lit("next").alias("etype"))
    for h in (1, 2, 3):
        want = B.label_counts(G.wl_levels(nodes, edges, h).where(F.col("h") == h), "graph")
        assert sorted(map(tuple, G.wl_path_bags(paths, h).collect())) == sorted(map(tuple, want.collect()))


def test_only_whole_paths_move(spark, sf):
    for name in ("wl_h1", "wl_h2"):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan, plan
