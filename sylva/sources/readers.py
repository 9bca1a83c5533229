"""Readers for graph files, tool results, bags and settings, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.operators.graphs import connected
from sylva.session import written

_COLUMN = "array<struct<_title:string,_value:string>>"
_RESULT = f"_benchmarkname string, _tool string, run array<struct<_name:string,_properties:string,column:{_COLUMN}>>, sourcefile array<struct<_name:string,_properties:string,column:{_COLUMN}>>"


def _number(value: Column) -> Column:
    """A number with a unit of one character at its end."""
    return F.expr(f"try_cast(substring({value}, 1, length({value}) - 1) as double)")


#: Fixed value: what the name of a result file says: tool, date, date of a witness check (if it is one), kind, competition and category.
RESULT_NAME = r"([^./]+)\.([^./]+)\.(?:([^./]+)\.)?(results|witness)\.(sv-comp\d+)(?:[^./]*)\.([^./]+)\.xml(\.bz2)?$"


def category_results(spark: SparkSession, path: str, category: str, sizes: DataFrame | None = None, most: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and witness checks (columns of tool_results) of one category, told apart by the files' names; a task that one file holds twice is an error.

    With sizes (vtask, size) tasks of more than most, and tasks without a size, are left out.
    """
    rows = tool_results(spark, path)
    part = lambda i: F.regexp_extract("file", RESULT_NAME, i)
    rows = rows.where(part(6) == category)
    if sizes is not None:
        rows = rows.join(sizes.select("vtask", "size"), "vtask").where(F.lit(most is None) | (F.col("size") <= F.lit(most))).drop("size")
    n = F.count("*").over(Window.partitionBy("file", "vtask"))
    twice = F.raise_error(F.concat(F.lit("twice in one file: "), F.col("vtask")))
    rows = rows.withColumn("n", n).withColumn("vtask", F.when(F.col("n") == 1, F.col("vtask")).otherwise(twice.cast("string"))).drop("n")
    check = (part(3) != "") | (part(4) == "witness")
    return rows.where(~check), rows.where(check)


def read_categories(spark: SparkSession, path: str, categories: list[str], skip_missing: bool = True) -> DataFrame:
    """Results of several categories with the column category; one that no file holds is skipped, or an error."""
    rows = tool_results(spark, path).withColumn("category", F.regexp_extract("file", RESULT_NAME, 6)).where(F.col("category").isin(categories))
    if not skip_missing:
        missing = set(categories) - {r.category for r in rows.select("category").distinct().collect()}  # categories at most
        if missing:
            raise ValueError(f"no results for {', '.join(sorted(missing))}")
    return rows


def index_rows(spark: SparkSession, xml: str | None = None, tsv: str | None = None) -> DataFrame:
    """(file, prop, tool, status, time) of all result files, XML and tab-separated ones alike; of equal keys the last file's row counts."""
    parts = []
    if xml:
        r = tool_results(spark, xml)
        parts.append(r.select(F.col("file").alias("origin"), F.col("vtask").alias("file"), F.array_join("props", " ").alias("prop"), "tool", "status", F.col("cputime").alias("time")))
    if tsv:
        r = tsv_results(spark, tsv)
        parts.append(r.select(F.col("file").alias("origin"), F.col("vtask").alias("file"), F.lit("unreach-call").alias("prop"), "tool", "status", F.col("cputime").alias("time")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return last_of_each(rows, "file", "prop", "tool", order="origin").drop("origin")


def tool_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, tool, vtask, props, status, cputime, walltime, memory) from result XML, plain or packed; old row tags too."""
    raw = spark.read.format("xml").option("rowTag", "result").schema(_RESULT).load(path)
    rows = raw.select(F.input_file_name().alias("file"), F.coalesce("_tool", "_benchmarkname").alias("tool"), F.explode(F.coalesce("run", "sourcefile")).alias("run"))
    rows = rows.select("file", "tool", F.col("run._name").alias("vtask"), F.split("run._properties", " ").alias("props"), F.map_from_entries(F.transform("run.column", lambda c: F.struct(c["_title"], c["_value"]))).alias("m"))
    numbers = {"cputime": "m['cputime']", "walltime": "m['walltime']", "memory": "m['memUsage']"}
    return rows.select("file", "tool", "vtask", "props", F.col("m")["status"].alias("status"), *[_number(v).alias(k) for k, v in numbers.items()])


def tsv_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, tool, vtask, status, cputime): the tool stands in the first row, tasks from the fourth."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    cell = lambda row, i: F.trim(F.element_at(F.split(row, "\t"), i), F.lit("|"))
    rows = lines.select("file", cell(F.element_at("l", 1), 2).alias("tool"), F.explode(F.slice("l", 4, 1 << 30)).alias("row")).where("row <> ''")
    return rows.select("file", "tool", cell(F.col("row"), 1).alias("vtask"), cell(F.col("row"), 2).alias("status"), cell(F.col("row"), 3).cast("double").alias("cputime"))


def last_of_each(rows: DataFrame, *keys: str, order: str = "file") -> DataFrame:
    """One row of each key: the last by file."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("r = 1").drop("r")


def program_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (graph, node, label) and edges (graph, src, dst, etype) of JSON graphs, one a file.

    Edge kinds that start with <| run backwards; a tree node (its id has a _) without an edge out gets
    one of kind s to the node that its id begins with.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("graph"), "value")
    g = text.select("graph", F.from_json("value", "nodes map<string,string>, edges array<array<string>>").alias("g"))
    nodes = g.select("graph", F.explode("g.nodes").alias("node", "label"))
    e = g.select("graph", F.explode("g.edges").alias("e")).select("graph", *[F.col("e")[i].alias(n) for i, n in enumerate(("a", "kind", "b"))])
    back = F.col("kind").startswith("<|")
    edges = e.select("graph", F.when(back, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("dst"), F.regexp_replace("kind", r"^<\||\|>$", "").alias("etype"))
    loose = nodes.where(F.col("node").contains("_")).join(edges.select("graph", F.col("src").alias("node")).distinct(), ["graph", "node"], "left_anti")
    return nodes, edges.unionByName(loose.select("graph", F.col("node").alias("src"), F.split("node", "_")[0].alias("dst"), F.lit("s").alias("etype")))


def whole_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the graphs that hang together, directions aside, and (graph, parts) of the others, which are left out.

    All graphs are looked at together; a graph of one node is whole, and a node without edges is a part of its own.
    """
    labels = connected(edges)
    parts = labels.groupBy("graph").agg(F.count_distinct("label").alias("n"))
    alone = nodes.select("graph", "node").distinct().join(labels.select("graph", "node"), ["graph", "node"], "left_anti").groupBy("graph").agg(F.count("*").alias("n"))
    counted = written(parts.unionByName(alone).groupBy("graph").agg(F.sum("n").alias("parts")))
    torn = counted.where("parts > 1")
    keep = lambda df: df.join(torn.select("graph"), "graph", "left_anti")
    return keep(nodes), keep(edges), torn


def old_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of graphs in the old form: a JSON list of (source, target, source's label, edge kind, target's label); of several labels of a node the greatest counts."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("graph"), "value")
    rows = text.select("graph", F.explode(F.from_json("value", "array<array<string>>")).alias("t"))
    e = rows.select("graph", *[F.col("t")[i].alias(n) for i, n in enumerate(("src", "dst", "a", "etype", "b"))])
    ends = e.select("graph", F.col("src").alias("node"), F.col("a").alias("label")).union(e.select("graph", "dst", "b"))
    return ends.groupBy("graph", "node").agg(F.max("label").alias("label")), e.select("graph", "src", "dst", "etype")


def any_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Graphs of both forms, told apart by each file's first character."""
    new, old = program_graphs(spark, path), old_graphs(spark, path)
    return new[0].unionByName(old[0]), new[1].unionByName(old[1])


def labelled_lines(spark: SparkSession, path: str, fields: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Comma-separated lines of so many fields; others are skipped. The last field may be renamed by a dictionary."""
    pattern = "^" + ",".join(["([^,]+)"] * len(fields)) + "$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    out = lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(f) for i, f in enumerate(fields)])
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = out.withColumn(fields[-1], F.coalesce(table[F.col(fields[-1])], F.col(fields[-1])))
    return out


def edge_lines(spark: SparkSession, path: str, kinds: dict[str, int]) -> DataFrame:
    """(src, dst, key, value, kind) of lines u,v,key,value, with the kind's number where the key is type."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return labelled_lines(spark, path, ["src", "dst", "key", "value"]).withColumn("kind", F.when(F.col("key") == "type", table[F.col("value")]))


def depth_lines(spark: SparkSession, path: str) -> DataFrame:
    """(node, depth) with the depth as a number."""
    return labelled_lines(spark, path, ["node", "depth"]).withColumn("depth", F.expr("try_cast(depth as int)")).where("depth is not null")


def bags(spark: SparkSession, path: str) -> DataFrame:
    """(graph, h, d, label, cnt) of bag files NAME_h_D.json."""
    name = F.input_file_name()
    text = spark.read.text(path, wholetext=True).select(*[F.regexp_extract(name, r"([^/]*)_([0-9]+)_([0-9]+)\.json$", i).alias(c) for i, c in ((1, "graph"), (2, "h"), (3, "d"))], "value")
    parsed = text.select("graph", F.col("h").cast("int").alias("h"), F.col("d").cast("int").alias("d"), F.from_json("value", "file string, kernel_bag map<string,double>").alias("b"))
    return parsed.select("graph", "h", "d", F.explode("b.kernel_bag").alias("label", "cnt"))


def write_levels(df: DataFrame, path: str) -> None:
    """One folder for each level."""
    df.write.partitionBy("h", "d").parquet(path)


def bag_level(spark: SparkSession, pattern: str, h: int, d: int) -> DataFrame:
    """(graph, label, cnt) of one level's file: pattern with h and d in its two places, or as it stands if it has none or no such file."""
    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    path = pattern % (h, d) if pattern.count("%d") == 2 and exists(pattern % (h, d)) else pattern
    text = spark.read.text(path, wholetext=True)
    entry = "map<string,struct<file:string,kernel_bag:map<string,double>>>"
    return text.select(F.explode(F.from_json("value", entry)).alias("graph", "b")).select("graph", F.explode("b.kernel_bag").alias("label", "cnt"))


def grouped_bags(levels: DataFrame) -> DataFrame:
    """(h, d, graph, value): each level's bags as JSON entries, which write_grouped puts together."""
    bag = levels.groupBy("h", "d", "graph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "cnt")))).alias("kernel_bag"))
    return bag.select("h", "d", "graph", F.to_json(F.struct(F.col("graph").alias("file"), "kernel_bag")).alias("value"))


def write_grouped(levels: DataFrame, path: str) -> None:
    """One folder for each level with a JSON line for each graph, as bags_of_lines reads them."""
    rows = grouped_bags(levels)
    rows.select("h", "d", F.to_json(F.struct("graph", "value")).alias("line")).write.partitionBy("h", "d").text(path)


def bags_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """(graph, h, d, label, cnt) of what write_grouped wrote."""
    line = spark.read.text(path).select("h", "d", F.from_json("value", "graph string, value string").alias("l"))
    return line.select("l.graph", "h", "d", F.from_json("l.value", "file string, kernel_bag map<string,double>").alias("b")).select("graph", "h", "d", F.explode("b.kernel_bag").alias("label", "cnt"))


def feature_json(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, cnt) of sparse matrices in JSON (rows, columns, data)."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "rows array<long>, columns array<long>, data array<double>").alias("m"))
    return m.select(F.explode(F.arrays_zip("m.rows", "m.columns", "m.data")).alias("c")).select(F.col("c.rows").alias("row"), F.col("c.columns").alias("col"), F.col("c.data").alias("cnt"))


def write_features(features: DataFrame, path: str) -> None:
    """The matrix as rows in parquet."""
    features.select("row", "col", "cnt").write.parquet(path)
