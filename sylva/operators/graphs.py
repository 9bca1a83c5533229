"""Operators on labelled multi-graphs: nodes (graph, node, label) and edges (graph, src, dst, etype)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import written


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def with_synonyms(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """column by a dictionary of synonyms; values without one stay."""
    if not names:
        return df
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def _heard(nodes: DataFrame, edges: DataFrame, said: Column) -> DataFrame:
    """graph, node and the sorted digests of what each in-neighbour (label) and its edge (etype) say."""
    sent = edges.join(nodes.select("graph", F.col("node").alias("src"), "label"), ["graph", "src"])
    return sent.groupBy("graph", F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(digest(said))).alias("heard"))


def wl_relabel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One Weisfeiler-Lehman step: a node's label with the sorted labels of those that point to it."""
    heard = _heard(nodes, edges, F.concat_ws("_", "label", "etype"))
    return nodes.join(heard, ["graph", "node"], "left").select(
        "graph", "node", digest(F.when(F.col("heard").isNull(), F.col("label")).otherwise(F.concat_ws("_", "label", F.array_join("heard", "_")))).alias("label")
    )


def wl_relabel_counted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The step that hears type, truth and label of each in-edge, then the node itself. Nodes without in-edges keep
    their label and are not counted (column counted)."""
    truth = F.coalesce(F.col("truth").cast("string"), F.lit("")) if "truth" in edges.columns else F.lit("")
    heard = _heard(nodes, edges, F.concat_ws("_", "etype", truth, "label"))
    own = digest(F.concat_ws("_", F.array_join("heard", "_"), "label"))
    return nodes.drop("counted").join(heard, ["graph", "node"], "left").select(
        "graph", "node", F.when(F.col("heard").isNull(), F.col("label")).otherwise(own).alias("label"), F.col("heard").isNotNull().alias("counted")
    )


def wl_relabel_prefixed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The step that keeps the first label (column origin) readable before the digest; nodes without in-edges keep their label."""
    if "origin" not in nodes.columns:
        nodes = nodes.withColumn("origin", F.col("label"))
    heard = _heard(nodes, edges, F.concat_ws("_", "label", "etype"))
    own = F.concat_ws("_", "origin", digest(F.concat_ws("_", "label", F.array_join("heard", "_"))))
    return nodes.join(heard, ["graph", "node"], "left").select("graph", "node", "origin", F.when(F.col("heard").isNull(), F.col("label")).otherwise(own).alias("label"))


def wl_levels(nodes: DataFrame, edges: DataFrame, h: int, step=wl_relabel) -> DataFrame:
    """Nodes of all levels 0 to h, with the level; each level is written once and read by the next."""
    out, now = nodes.select("graph", "node", "label", F.lit(0).alias("h")), nodes
    for k in range(1, h + 1):
        now = written(step(now, edges))
        heard = now.where("counted") if "counted" in now.columns else now
        out = out.unionByName(heard.select("graph", "node", "label", F.lit(k).alias("h")))
    return out


def wl_path_bags(paths: DataFrame, h: int, etype: str = "next") -> DataFrame:
    """(graph, label, cnt): the bags of level h of graphs that are paths, given as (graph, labels: a path's labels in order), each node hearing the one before.

    It is wl_relabel h times, but a node is relabelled from the h labels before it where they stand: rows move once,
    as whole paths by graph, and no nodes, edges or digests do.
    """
    before = lambda k: F.concat(F.array_repeat(F.lit(None).cast("string"), F.least(F.lit(k), F.size("labels"))), F.slice("labels", 1, F.greatest(F.size("labels") - k, F.lit(0))))
    zipped = F.arrays_zip(F.col("labels").alias("l0"), *[before(k).alias(f"l{k}") for k in range(1, h + 1)])
    now = paths.repartition("graph").select("graph", F.explode(zipped).alias("at")).select("graph", *[F.col("at")[f"l{k}"].alias(f"l{k}") for k in range(h + 1)])
    for left in range(h, 0, -1):  # labels of the next level, as far back as the last one needs
        heard = lambda k: digest(F.concat_ws("_", f"l{k}", digest(F.concat_ws("_", f"l{k + 1}", F.lit(etype)))))
        step = lambda k: F.when(F.col(f"l{k + 1}").isNull(), digest(F.col(f"l{k}"))).otherwise(heard(k))
        now = now.select("graph", *[step(k).alias(f"l{k}") for k in range(left)])
    return now.groupBy("graph", F.col("l0").alias("label")).agg(F.count("*").cast("double").alias("cnt"))


def depth_bags(nodes: DataFrame, edges: DataFrame, h: int, depth: int) -> DataFrame:
    """(graph, d, h, label, cnt): bags of all levels 0 to h of the graphs cut at each depth d from 1 to depth, in one job.

    nodes have a depth; a cut keeps nodes of at most so great a depth and the edges between them.
    """
    at = F.struct(F.col("graph").alias("graph"), F.col("d").alias("d")).alias("graph")
    each = lambda least: F.explode(F.when(least <= depth, F.sequence(F.greatest(least, F.lit(1)), F.lit(depth)))).alias("d")
    end = lambda name, as_: nodes.select("graph", F.col("node").alias(name), F.col("depth").alias(as_))
    placed = edges.join(end("src", "a"), ["graph", "src"]).join(end("dst", "b"), ["graph", "dst"])
    cut_edges = written(placed.select("graph", "src", "dst", "etype", each(F.greatest("a", "b"))).select(at, "src", "dst", "etype"))
    cut_nodes = written(nodes.select("graph", "node", "label", each(F.col("depth"))).select(at, "node", "label"))
    counts = wl_levels(cut_nodes, cut_edges, h).groupBy("graph", "h", "label").agg(F.count("*").cast("double").alias("cnt"))
    return counts.select("graph.graph", "graph.d", "h", "label", "cnt")


def neighbourhoods(nodes: DataFrame, edges: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """For each label its first node as root, with the nodes (graph, label, root, node) from which up to h edges lead there,
    and the edges (graph, label, root, src, dst, etype) between those."""
    root = nodes.groupBy("graph", "label").agg(F.min("node").alias("root"))
    reached = written(root.withColumn("node", F.col("root")))
    layer = reached
    for _ in range(h):
        step = layer.join(edges.select("graph", F.col("dst").alias("node"), "src"), ["graph", "node"]).select("graph", "label", "root", F.col("src").alias("node")).distinct()
        layer = written(step.join(reached, ["graph", "label", "root", "node"], "left_anti"))
        reached = reached.unionByName(layer)
    reached = written(reached)
    inner = reached.withColumnRenamed("node", "src").join(edges.select("graph", "src", "dst", "etype"), ["graph", "src"])
    return reached, inner.join(reached.withColumnRenamed("node", "dst"), ["graph", "label", "root", "dst"], "left_semi").select("graph", "label", "root", "src", "dst", "etype")


#: Edge kinds by number.
EDGE_KINDS = {1: "de", 2: "ce", 3: "cfe", 4: "se", 5: "t", 6: "f", 7: "dummy"}


def edge_names(edges: DataFrame) -> DataFrame:
    """Edges with the kind's name instead of its number; unknown numbers are null."""
    table = F.create_map(*[F.lit(x) for pair in EDGE_KINDS.items() for x in pair])
    return edges.withColumn("etype", table[F.col("etype").cast("int")])


def depth_labels(nodes: DataFrame, edges: DataFrame, kind: str = "s") -> DataFrame:
    """Depth of each node: 0 outside the tree, 1 where an edge leaves it, else one more than at an out-neighbour."""
    tree = written(edges.where(F.col("etype") == kind).select("graph", "src", "dst"))
    inside = tree.select("graph", F.col("src").alias("node")).distinct()
    todo = written(inside)
    out_of = tree.join(inside.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_anti").select("graph", F.col("src").alias("node")).distinct()
    done = written(out_of.withColumn("depth", F.lit(1)))
    layer = done
    while not layer.isEmpty():
        todo = written(todo.join(layer, ["graph", "node"], "left_anti"))
        step = tree.join(layer.withColumnRenamed("node", "dst"), ["graph", "dst"]).groupBy("graph", F.col("src").alias("node")).agg((F.min("depth") + 1).alias("depth"))
        layer = written(step.join(todo, ["graph", "node"], "left_semi"))
        done = done.unionByName(layer)
    return nodes.join(done, ["graph", "node"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def truncated(nodes: DataFrame, edges: DataFrame, depth: int, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of at most so great a depth, and the edges of the given kinds between them."""
    kept = nodes.where(F.col("depth") <= depth)
    ids = kept.select("graph", "node")
    if kinds is not None:
        edges = edges.where(F.col("etype").isin(kinds))
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("node", end), ["graph", end], "left_semi")
    return kept, edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of each node."""
    count = lambda end, name: edges.groupBy("graph", F.col(end).alias("node")).agg(F.count("*").alias(name))
    out = nodes.join(count("dst", "indeg"), ["graph", "node"], "left").join(count("src", "outdeg"), ["graph", "node"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("indeg", "outdeg")})


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in ("indeg", "outdeg") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return degrees(nodes, edges).groupBy("graph").agg(F.count("*").alias("n_nodes"), F.sum("indeg").alias("n_edges"), *aggs)


def closure(edges: DataFrame, kind: str, roots: DataFrame, paths: bool = False) -> DataFrame:
    """(graph, root, node) once for each node from which edges of a kind lead to root; on cycles the root is found too.

    With paths, once for each path: of acyclic graphs only.
    """
    steps = written(edges.where(F.col("etype") == kind).select("graph", F.col("dst").alias("node"), F.col("src").alias("next")))
    layer = roots.select("graph", F.col("node").alias("root"), "node")
    out = None
    while True:
        layer = layer.join(steps, ["graph", "node"]).select("graph", "root", F.col("next").alias("node"))
        if not paths:
            layer = layer.distinct()
            layer = layer if out is None else layer.join(out, ["graph", "root", "node"], "left_anti")
        layer = written(layer)
        if out is not None and layer.isEmpty():
            return out
        out = layer if out is None else out.unionByName(layer)


def connected(edges: DataFrame) -> DataFrame:
    """(graph, node, label): the least node that is connected with each, directions aside.

    Each round takes the least label next to a node and follows it one step further, so that long chains close quickly.
    """
    both = written(edges.select("graph", F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("graph", "dst", "src")).distinct())
    labels = written(both.groupBy("graph", "node").agg(F.least(F.min("next"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), ["graph", "next"]).groupBy("graph", "node").agg(F.min("label").alias("near"))
        step = labels.join(near, ["graph", "node"]).select("graph", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select("graph", F.col("node").alias("label"), F.col("label").alias("far"))
        step = written(step.join(far, ["graph", "label"], "left").select("graph", "node", "old", F.least("label", "far").alias("label")))
        labels = step.select("graph", "node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def all_edges_are(edges: DataFrame, kind: str) -> DataFrame:
    """Nodes all of whose edges are of one kind."""
    ends = edges.select("graph", F.col("src").alias("node"), "etype").unionByName(edges.select("graph", F.col("dst").alias("node"), "etype"))
    return ends.groupBy("graph", "node").agg(F.every(F.col("etype") == kind).alias("only")).where("only").drop("only")


def shortest_unique_suffix(paths: DataFrame, name: str = "path", first: int = 64) -> DataFrame:
    """The shortest end of each path (other characters than word characters, - and _ as _) that no other path has, else all of it.

    Ends of up to first characters are counted for all paths, then for ever fewer: those that have no unique end yet
    and share that long an end with another, up to twice the length, until all are settled.
    """
    left = written(paths.select(name).distinct().withColumn("safe", F.regexp_replace(name, r"[^\w\-]", "_")))
    done, low, high = None, 1, first
    while True:
        ends = left.where(F.length("safe") >= low).select(name, F.explode(F.sequence(F.lit(low), F.least(F.length("safe"), F.lit(high)))).alias("n"), "safe").withColumn("suffix", F.expr("right(safe, n)"))
        unique = ends.groupBy("suffix").agg(F.count("*").alias("c"), F.first(name).alias(name), F.first("n").alias("n")).where("c = 1")
        best = unique.groupBy(name).agg(F.min_by("suffix", "n").alias("suffix"))
        found = written(left.join(best, name, "left"))
        settled = found.where(F.col("suffix").isNotNull() | (F.length("safe") <= high)).select(name, F.coalesce("suffix", "safe").alias("suffix"))
        done = settled if done is None else done.unionByName(settled)
        # Paths that are settled already end otherwise within high characters, so they cannot share a longer end with those left.
        left = found.where(F.col("suffix").isNull() & (F.length("safe") > high)).select(name, "safe")
        if left.isEmpty():
            return done
        low, high = high + 1, 2 * high
