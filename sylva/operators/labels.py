"""Verdicts, scores and label tables: (task, tool, solve 1/0/-1, time in seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.bags import dense_index

CEILING = 900.0


def status_of(text: Column) -> Column:
    """true, false or unknown."""
    return F.when(text.rlike("^true"), "true").when(text.rlike("^false"), "false").otherwise("unknown")


def expected_status(path: Column) -> Column:
    """The verdict that a task's file name promises, null (to be set aside) where it promises none."""
    found = F.regexp_extract(path, r"_(true|false)-[^.]*\.(i|c)$", 1)
    return F.when(found != "", found)


def competition_score(status: Column, expected: Column) -> Column:
    """2 and 1 for right proofs and alarms, -12 and -6 for wrong ones, 0 for unknown."""
    return (
        F.when((status == "true") & (expected == "true"), 2)
        .when((status == "false") & (expected == "false"), 1)
        .when((status == "false") & (expected == "true"), -6)
        .when((status == "true") & (expected == "false"), -12)
        .otherwise(0)
    )


def compared(score_a: Column, time_a: Column, score_b: Column, time_b: Column) -> Column:
    """-1, 0 or 1: by score, then by the lesser time."""
    return F.signum(score_a - score_b).cast("int") + F.when(score_a == score_b, F.signum(time_b - time_a).cast("int")).otherwise(0)


def witnessed(results: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Results (vtask, status) whose alarms no witness check (vtask, confirmed) confirms become unknown; two checks of one task are an error."""
    w = witnesses.groupBy("vtask").agg(F.first("confirmed").alias("confirmed"), F.count("*").alias("n"))
    w = w.select("vtask", F.when(F.col("n") == 1, F.col("confirmed")).otherwise(F.raise_error(F.concat(F.lit("several witness checks of "), F.col("vtask").cast("string"))).cast("boolean")).alias("confirmed"))
    undone = (F.col("status") == "false") & F.col("confirmed").isNotNull() & ~F.col("confirmed")
    return results.join(w, "vtask", "left").withColumn("status", F.when(undone, "unknown").otherwise(F.col("status"))).drop("confirmed")


def common_tools(labels: DataFrame, missing: int = 0) -> DataFrame:
    """Tools with a label for all tasks, or all but a few."""
    n = labels.agg(F.count_distinct("task").alias("n"))
    return labels.groupBy("tool").agg(F.count_distinct("task").alias("c")).join(F.broadcast(n)).where(F.col("c") >= F.col("n") - missing).select("tool")


def faster(time_a: Column, time_b: Column, major: Column | bool = False) -> Column:
    """Whether a is the faster; beyond the ceiling b counts as unsolved, and major decides."""
    major = F.lit(major) if isinstance(major, bool) else major
    return F.when(time_b >= CEILING, (time_a < CEILING) | major).otherwise(time_a < time_b)


def tool_pairs(labels: DataFrame) -> DataFrame:
    """Each task's pairs of tools x < y with both labels: a task's tools meet once, as an array, and pairs are made of it."""
    tools = F.sort_array(F.collect_list(F.struct("tool", "solve", "time")))  # a task's tools
    first = labels.groupBy("task").agg(tools.alias("tools")).select("task", "tools", F.posexplode("tools").alias("at", "a"))
    rest = F.slice("tools", F.col("at") + 2, F.greatest(F.size("tools") - F.col("at") - 1, F.lit(0)))
    pairs = first.select("task", "a", F.explode(rest).alias("b")).where("a.tool < b.tool")
    return pairs.select("task", F.col("a.tool").alias("x"), F.col("a.solve").alias("sx"), F.col("a.time").alias("tx"), F.col("b.tool").alias("y"), F.col("b.solve").alias("sy"), F.col("b.time").alias("ty"))


def label_matrix(labels: DataFrame) -> DataFrame:
    """Cells (task, x, y, v): whether x solves the task where x = y, whether x is faster where x < y."""
    own = labels.select("task", F.col("tool").alias("x"), F.col("tool").alias("y"), (F.col("solve") == 1).cast("int").alias("v"))
    return own.unionByName(tool_pairs(labels).select("task", "x", "y", faster(F.col("tx"), F.col("ty")).cast("int").alias("v")))


def preferences(labels: DataFrame) -> DataFrame:
    """1 where x is preferred (by solve, then time), -1 where y is, 0 where both time out alike."""
    out = F.when(F.col("sx") != F.col("sy"), F.signum(F.col("sx") - F.col("sy"))).when(
        (F.col("tx") >= CEILING) & (F.col("ty") >= CEILING), F.lit(0)
    ).otherwise(F.signum(F.col("ty") - F.col("tx")))
    return tool_pairs(labels).select("task", "x", "y", out.cast("int").alias("v"))


def relations(labels: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """How x's time stands to y's: equal within the tolerance, faster, slower, or out (both beyond the ceiling)."""
    rel = (
        F.when((F.col("tx") >= CEILING) & (F.col("ty") >= CEILING), "out")
        .when(F.abs(F.col("tx") - F.col("ty")) <= tolerance * F.col("tx"), "equal")
        .when(F.col("tx") < F.col("ty"), "faster")
        .otherwise("slower")
    )
    return tool_pairs(labels).select("task", "x", "y", "sx", "sy", rel.alias("relation"))


def winners(labels: DataFrame) -> DataFrame:
    """Each task's tool that no other beats, where there is exactly one."""
    p = preferences(labels)
    beaten = p.select("task", F.when(F.col("v") == 1, F.col("y")).when(F.col("v") == -1, F.col("x")).alias("tool")).where("tool is not null").distinct()
    best = labels.select("task", "tool").join(beaten, ["task", "tool"], "left_anti")
    return best.groupBy("task").agg(F.count("*").alias("c"), F.min("tool").alias("tool")).where("c = 1").select("task", "tool")


# ---------------------------------------------------------------- verdicts of runs

# What a property file says of each property.
_PRP = {
    "unreachability": r"CHECK\([_\s\w\(\)]+,\s*LTL\(\s*G\s*!\s*call\([_\w\s\(\)]+\)\s*\)\s*\)",
    "memory_safety": r"CHECK\([_\s\w\(\)]+,\s*LTL\(\s*G\s*valid-\w+\)\s*\)",
    "termination": r"CHECK\([_\s\w\(\)]+,\s*LTL\(\s*F\s*end\s*\)\s*\)",
    "overflow": r"CHECK\([_\s\w\(\)]+,\s*LTL\(\s*G\s*!\s*overflow\s*\)\s*\)",
}
_IN_PATH = {"valid": "memory_safety", "overflow": "overflow", "termination": "termination", "unreach": "unreachability"}


def _first_of(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def property_types(tasks: DataFrame, properties: DataFrame) -> DataFrame:
    """tasks (path) with their property: as the path names it, else as the property file (path, text) beside it says, the task's own before ALL.prp.

    Null, to be set aside, where neither says one.
    """
    own = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".prp"))
    every = F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.lit("ALL.prp"))
    said = properties.select(F.col("path").alias("prp"), F.col("text").alias("said"))
    out = tasks.withColumn("own", own).withColumn("every", every)
    for name in ("own", "every"):
        out = out.join(said.withColumnsRenamed({"prp": name, "said": f"{name}_said"}), name, "left")
    text = F.coalesce("own_said", "every_said")
    named = [(F.col("path").contains(k), v) for k, v in _IN_PATH.items()]
    return out.withColumn("property", _first_of(named + [(text.rlike(p), v) for v, p in _PRP.items()])).drop("own", "every", "own_said", "every_said")


def verdict(status: Column, file: Column, prop: Column) -> Column:
    """1, 0 or -1: whether a run's status is what the task's file name promises. Memory safety is judged by each of its properties: any wrong one counts, then any right one."""

    def of(p: Column, right: Column, aside: Column) -> Column:
        no = F.when(aside, 0).when(file.contains(F.concat(F.lit("false-"), p)), 1).otherwise(-1)
        return F.when(status.contains("true"), F.when(right, 1).otherwise(-1)).when(status.contains("false"), no).otherwise(0)

    regular = of(prop, file.contains(F.concat(F.lit("true-"), prop)), status.contains("valid") & ~status.contains(prop))
    each = F.transform(F.split(prop, " "), lambda p: of(p, file.contains("true-valid-memsafety"), ~status.contains(p)))
    memory = F.when(F.array_contains(each, -1), -1).when(F.array_contains(each, 1), 1).otherwise(0)
    return F.when(prop.contains("valid"), memory).otherwise(regular)


def canonical_name(file: Column, prop: Column) -> Column:
    """The file's name up to what it promises, with what it promises for this property."""
    parts = F.split(file, "_")
    at = F.array_position(F.transform(parts, lambda s: s.startswith("true") | s.startswith("false")), True).cast("int")
    base = F.array_join(F.slice(parts, 1, F.when(at > 0, at - 1).otherwise(F.size(parts))), "_")
    one = F.split(prop, " ")[0]
    one = F.when(one.contains("valid"), "valid-memsafety").otherwise(one)
    return F.concat(base, F.lit("_"), F.when(file.contains(F.concat(F.lit("true-"), one)), "true").otherwise("false"), F.lit("-"), one)


def indexed_runs(runs: DataFrame) -> DataFrame:
    """(file, prop, tool, solve, time, name) of runs (file, prop, tool, status, time): memory properties are one, the last row of a key in order of its columns counts."""
    rows = runs.select(
        "file", F.when(F.col("prop").contains("valid"), "valid-memsafety").otherwise(F.split("prop", " ")[0]).alias("property"), "tool",
        F.struct("prop", "status", "time").alias("r"),
    ).groupBy("file", "property", "tool").agg(F.max("r").alias("r"))
    return rows.select(
        "file", F.col("property").alias("prop"), "tool", verdict(F.col("r.status"), F.col("file"), F.col("r.prop")).alias("solve"), F.col("r.time").alias("time"),
        canonical_name(F.col("file"), F.col("r.prop")).alias("name"),
    )


def extracted(runs: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph, tool, solve, time) of runs (graph, tool, status, expected, time) of the given graphs: correct where the status is the expected one, else false."""
    kept = runs.join(graphs.select("graph").distinct(), "graph", "left_semi")
    return kept.select("graph", "tool", F.when(F.col("status") == F.col("expected"), "correct").otherwise("false").alias("solve"), "time")


def unpivoted(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each tool of a map column label (tool -> solve, time)."""
    return rows.select(*keys, F.explode("label").alias("tool", "l")).select(*keys, "tool", "l.solve", "l.time")


# ---------------------------------------------------------------- paths, lists and packed triangles


def path_id(path: Column) -> Column:
    """Folder and file name of a path as one name, dots as _."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    return F.replace(F.concat(folder, F.lit("_"), F.element_at(parts, -1)), F.lit("."), F.lit("_"))


def graph_id(path: Column) -> Column:
    """A path's file name without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parsed_list(text: Column) -> Column:
    """The quoted items of a written list such as ['a', 'b']; null where the brackets are missing."""
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.regexp_extract_all(text, F.lit("'([^']*)'"), 1))


def packed_index(x: Column, y: Column, n: Column) -> Column:
    """The place of cell (x, y) in a packed triangle of n rows: the diagonal first, then pairs x < y in order."""
    a, b = F.least(x, y), F.greatest(x, y)
    return F.when(a == b, a).otherwise(n + (a * (2 * n - a - 1) / 2).cast("long") + b - a - 1)


def unpacked_index(i: Column, n: Column) -> Column:
    """The cell (x, y) of a place, as a struct."""
    k = i - n
    guess = F.floor((2 * n - 1 - F.sqrt(((2 * n - 1) * (2 * n - 1) - 8 * k).cast("double"))) / 2)
    before = lambda x: (x * (2 * n - x - 1) / 2).cast("long")
    x = F.when(before(guess + 1) <= k, guess + 1).when(before(guess) > k, guess - 1).otherwise(guess)
    return F.when(i < n, F.struct(i.cast("long").alias("x"), i.cast("long").alias("y"))).otherwise(F.struct(x.cast("long").alias("x"), (k - before(x) + x + 1).cast("long").alias("y")))


# ---------------------------------------------------------------- label tables with gaps


def tools_with_most(labels: DataFrame, missing: int = 5, without: str = "cpa-bam") -> DataFrame:
    """Tools with a label for all rows (task) but a few, but for those whose name holds a text."""
    return common_tools(labels, missing).where(~F.col("tool").contains(without))


def _grid(labels: DataFrame, tools: DataFrame) -> DataFrame:
    """All tasks by all tools, with solve and time where there are any. Tools are few and travel as one array."""
    names = tools.agg(F.sort_array(F.collect_set("tool")).alias("names"))
    cells = labels.select("task").distinct().join(F.broadcast(names)).select("task", F.explode("names").alias("tool"))
    return cells.join(labels, ["task", "tool"], "left")


def filled(labels: DataFrame, tools: DataFrame) -> DataFrame:
    """Labels of all tasks by all tools; where there is none, unsolved at the ceiling."""
    return _grid(labels, tools).select("task", "tool", F.coalesce("solve", F.lit(0)).alias("solve"), F.coalesce("time", F.lit(CEILING)).alias("time"))


def valid_preferences(labels: DataFrame, tools: DataFrame) -> DataFrame:
    """1 where x, -1 where y is the better of those in time, 0 where neither is in time: (task, x, y, v) for all tasks and pairs."""
    known = _grid(labels, tools).select("task", "tool", "solve", F.when(F.col("time") < CEILING, F.col("time")).alias("time"))
    better = (F.col("sx") > F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("tx") < F.col("ty")))
    v = F.when(F.col("tx").isNull(), F.when(F.col("ty").isNull(), 0).otherwise(-1)).when(F.col("ty").isNull() | better, 1).otherwise(-1)
    return tool_pairs(known).select("task", "x", "y", v.alias("v"))


def property_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of files (file, idx) and, for each property, the numbers of the files that have labels (prop, idx)."""
    number = dense_index(rows, "file")
    return number, rows.select("file", "prop").distinct().join(number, "file").select("prop", "idx")


def rows_of_slice(chosen: DataFrame, index: DataFrame, properties: list[str]) -> DataFrame:
    """Label rows (idx, prop) of the chosen graphs (idx); with one property each graph must have one."""
    out = index.where(F.col("prop").isin(properties)).join(chosen.select("idx").distinct(), "idx", "left_semi")
    if len(properties) == 1:
        missing = chosen.select("idx").distinct().join(out, "idx", "left_anti").count()
        if missing:
            raise ValueError(f"{missing} graphs have no label for {properties[0]}")
    return out


def dataset(graphs: DataFrame, rankings: DataFrame) -> DataFrame:
    """Graphs (file, graph) that were made, with the rankings (file, ...) that there are; others go."""
    return graphs.where(F.col("graph").isNotNull()).join(rankings, "file")


def mapped(bags: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bags (graph: a path's id) by the index (file, prop, name): (graph, file, label, cnt), one bag for each program and property with the property as
    a further label; and the graphs that the index lacks."""
    wanted = index.select(path_id(F.col("file")).alias("graph"), "prop", "name").distinct()
    rows = bags.join(wanted, "graph").select(path_id(F.col("name")).alias("program"), F.col("name").alias("file"), "label", "cnt")
    marks = wanted.join(bags.select("graph").distinct(), "graph", "left_semi").select(path_id(F.col("name")).alias("program"), F.col("name").alias("file"), F.col("prop").alias("label"), F.lit(1.0).alias("cnt"))
    found = rows.unionByName(marks).withColumnRenamed("program", "graph")
    return found, bags.select("graph").distinct().join(wanted, "graph", "left_anti")
