"""Bags of labels: rows (graph, label, cnt), and what is asked of their container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import written


def label_counts(nodes: DataFrame, *keys: str) -> DataFrame:
    """Nodes per label of each graph: (keys, label, cnt)."""
    return nodes.groupBy(*keys, "label").agg(F.count("*").cast("double").alias("cnt"))


def document_frequency(bags: DataFrame) -> DataFrame:
    """The number of graphs that hold each label."""
    return bags.groupBy("label").agg(F.count_distinct("graph").alias("df"))


def top_index(frequency: DataFrame, k: int, by: str = "df", name: str = "label") -> DataFrame:
    """The k most frequent, numbered from 0; ties by name. Only k rows meet in one task."""
    top = frequency.orderBy(F.desc(by), name).limit(k)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc(by), name)) - 1)


def dense_index(df: DataFrame, name: str) -> DataFrame:
    """Distinct values numbered from 0 in order: each range counts its own, and offsets are added to them."""
    ranged = df.select(name).distinct().repartitionByRange(name).sortWithinPartitions(name)
    placed = written(ranged.select(name, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))  # once, so that both reads agree
    first = placed.groupBy("part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return placed.join(F.broadcast(first.select("part", "first", offset.alias("offset"))), "part").select(name, (F.col("id") - F.col("first") + F.col("offset")).alias("idx"))


def features(bags: DataFrame, graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sparse matrix as rows (row, col, cnt), by two dense indexes."""
    return bags.join(graphs.withColumnRenamed("idx", "row"), "graph").join(labels.withColumnRenamed("idx", "col"), "label").select("row", "col", "cnt")


def aligned(bags: DataFrame, a, b) -> DataFrame:
    """Two bags side by side over the labels of either."""
    one = lambda g, c: bags.where(F.col("graph") == g).select("label", F.col("cnt").alias(c))
    return one(a, "x").join(one(b, "y"), "label", "full").select("label", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def in_categories(tasks: DataFrame, *categories: str) -> DataFrame:
    return tasks.where(F.col("category").isin(*categories))


def with_property(tasks: DataFrame, name: str) -> DataFrame:
    """Tasks whose array props holds the property; an unknown property is an error."""
    found = tasks.where(F.array_contains("props", name))
    if not found.limit(1).count():  # reads until the first that has it
        raise ValueError(f"no task has the property {name}")
    return found


def category_of(path: Column) -> Column:
    """The folder below sv-benchmarks/c/, or unknown."""
    found = F.regexp_extract(path, "sv-benchmarks/c/([^/]+)/", 1)
    return F.when(found != "", found).otherwise("unknown")


def properties_of(path: Column) -> Column:
    """The properties that a task's path names."""
    marks = {"-unreach-call": "reachability", "-termination": "termination", "-no-overflow": "overflow", "-valid-": "memory"}
    return F.array_compact(F.array(*[F.when(path.contains(k), F.lit(v)) for k, v in marks.items()]))


def with_time(tasks: DataFrame, times: DataFrame) -> DataFrame:
    """Graph times by task, -1 where there is none."""
    return tasks.join(times, "graph", "left").withColumn("time", F.coalesce("time", F.lit(-1.0)))


def complete_graphs(levels: DataFrame, h: int) -> DataFrame:
    """Counts of those graphs only that have all levels 0 to h."""
    whole = levels.where(F.col("h") <= h).groupBy("graph").agg(F.count_distinct("h").alias("n")).where(F.col("n") == h + 1)
    return levels.where(F.col("h") <= h).join(whole.select("graph"), "graph", "left_semi")


def categories(tasks: DataFrame) -> DataFrame:
    return tasks.select("category").distinct()


def labels_of(labels: DataFrame, index: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Labels (graph, ...) in the order of an index (graph, idx), of some categories only if they are given (column category)."""
    if categories is not None:
        labels = labels.where(F.col("category").isin(categories))
    return labels.join(index, "graph")


def filtered(tasks: DataFrame, *, category: str | None = None, task_type: str | None = None, ids: list | None = None, where: Column | None = None) -> DataFrame:
    """Tasks (graph, category, props, ...) of a category, with a property, of given ids, and by any condition."""
    if category is not None:
        tasks = tasks.where(F.col("category") == category)
    if task_type is not None:
        tasks = tasks.where(F.array_contains("props", task_type))
    if ids is not None:
        tasks = tasks.where(F.col("graph").isin(ids))
    return tasks if where is None else tasks.where(where)


def frequency(nodes: DataFrame) -> DataFrame:
    """The share of graphs that hold each label."""
    held = nodes.select("graph", "label").distinct()
    n = held.agg(F.count_distinct("graph").alias("n"))  # one row
    return held.groupBy("label").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("label", (F.col("df") / F.col("n")).alias("share"))


def level_frequency(levels: DataFrame, h: int) -> DataFrame:
    """Graphs by label, summed over the levels up to h."""
    return levels.where(F.col("h") <= h).groupBy("h", "label").agg(F.count_distinct("graph").alias("df")).groupBy("label").agg(F.sum("df").alias("df"))


def entities(bags: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """Bags with their files (graph, file) and tool labels (graph, tool, solve, time)."""
    return bags.join(files, "graph").join(labels, "graph")
