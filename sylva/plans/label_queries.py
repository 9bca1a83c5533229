"""Queries of verdicts, label tables and bags' container: runs of tools are made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators import bags as B
from sylva.operators import labels as L
from sylva.operators import ranking as R
from sylva.plans.queries import _BAGS, _DOCS, _FULL, _TOOLS, document_bags, query, source_bags, tool_labels
from sylva.session import table, written

# Runs: each order is a program with a property and a promise, each of its lines a tool's run.
_PROGRAMS = """programs AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'unreach-call' WHEN 1 THEN 'termination' WHEN 2 THEN 'no-overflow' ELSE 'valid-deref valid-free valid-memtrack' END AS prop,
  'sv-benchmarks/c/cat' || substr(o_orderpriority, 1, 1) || '/t' || o_orderkey || '_' || CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE 'true' END || '-'
  || CASE WHEN o_orderkey % 4 = 0 THEN 'unreach-call' WHEN o_orderkey % 4 = 1 THEN 'termination' WHEN o_orderkey % 4 = 2 THEN 'no-overflow' WHEN o_orderstatus = 'F' THEN 'valid-deref' ELSE 'valid-memsafety' END || '.c' AS file FROM orders)"""
_VRUNS = f"""{_PROGRAMS}, vruns AS (SELECT id, file, prop, CASE WHEN l_linenumber = 3 THEN 'cpa-bam' ELSE 'tool' || l_linenumber END AS tool, l_quantity * 20.0::DOUBLE AS time,
  CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'R' THEN 'false(' || CASE WHEN id % 4 <> 3 THEN prop WHEN l_linenumber % 2 = 1 THEN 'valid-deref' ELSE 'valid-free' END || ')' ELSE CASE WHEN l_linestatus = 'O' THEN 'unknown' ELSE 'true' END END AS status
  FROM programs JOIN lineitem ON l_orderkey = id)"""
_VERDICT = """CASE WHEN NOT contains(prop, 'valid') THEN
    CASE WHEN contains(status, 'true') THEN CASE WHEN contains(file, 'true-' || prop) THEN 1 ELSE -1 END
    WHEN contains(status, 'false') THEN CASE WHEN contains(status, 'valid') AND NOT contains(status, prop) THEN 0 WHEN contains(file, 'false-' || prop) THEN 1 ELSE -1 END ELSE 0 END
  WHEN contains(status, 'true') THEN CASE WHEN contains(file, 'true-valid-memsafety') THEN 1 ELSE -1 END
  WHEN contains(status, 'false') THEN CASE WHEN len(list_filter(string_split(prop, ' '), lambda p: contains(status, p) AND NOT contains(file, 'false-' || p))) > 0 THEN -1
    WHEN len(list_filter(string_split(prop, ' '), lambda p: contains(status, p) AND contains(file, 'false-' || p))) > 0 THEN 1 ELSE 0 END ELSE 0 END"""
_SHORT = "CASE WHEN contains(prop, 'valid') THEN 'valid-memsafety' ELSE prop END"
_NAME = f"regexp_extract(file, '^(.*?)_(true|false)', 1) || '_' || CASE WHEN contains(file, 'true-' || {_SHORT}) THEN 'true' ELSE 'false' END || '-' || {_SHORT}"
_INDEX = f"""{_VRUNS}, idx AS (SELECT file, {_SHORT} AS prop, tool, {_VERDICT} AS solve, time, {_NAME} AS name FROM
  (SELECT *, row_number() OVER (PARTITION BY file, tool, {_SHORT} ORDER BY prop DESC, status DESC, time DESC) AS r FROM vruns) WHERE r = 1)"""


def programs(spark, sf) -> DataFrame:
    k, failed = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    by = lambda *v: F.when(k % 4 == 0, v[0]).when(k % 4 == 1, v[1]).when(k % 4 == 2, v[2]).otherwise(v[3])
    promise = by("unreach-call", "termination", "no-overflow", F.when(failed, "valid-deref").otherwise("valid-memsafety"))
    file = F.concat(F.lit("sv-benchmarks/c/cat"), F.substring("o_orderpriority", 1, 1), F.lit("/t"), k.cast("string"), F.lit("_"), F.when(failed, "false").otherwise("true"), F.lit("-"), promise, F.lit(".c"))
    return table(spark, sf, "orders").select(k.alias("id"), by("unreach-call", "termination", "no-overflow", "valid-deref valid-free valid-memtrack").alias("prop"), file.alias("file"))


def tool_runs(spark, sf) -> DataFrame:
    """id, file, prop, tool, status and time of each run."""
    rows = programs(spark, sf).join(table(spark, sf, "lineitem"), F.col("id") == F.col("l_orderkey"))
    line = F.col("l_linenumber")
    which = F.when(F.col("id") % 4 != 3, F.col("prop")).when(line % 2 == 1, "valid-deref").otherwise("valid-free")
    status = F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "R", F.concat(F.lit("false("), which, F.lit(")"))).when(F.col("l_linestatus") == "O", "unknown").otherwise("true")
    tool = F.when(line == 3, "cpa-bam").otherwise(F.concat(F.lit("tool"), line.cast("string")))
    return rows.select("id", "file", "prop", tool.alias("tool"), status.alias("status"), (F.col("l_quantity") * 20.0).cast("double").alias("time"))


@query(f"WITH {_INDEX} SELECT file, prop, tool, solve, time, name FROM idx")
def run_index(spark, sf):
    return L.indexed_runs(tool_runs(spark, sf))


@query(f"WITH {_VRUNS} SELECT id, tool, CASE WHEN regexp_matches(status, '^true') THEN 'true' WHEN regexp_matches(status, '^false') THEN 'false' ELSE 'unknown' END AS status, regexp_extract(file, '_(true|false)-[^.]*\\.(i|c)$', 1) AS expected FROM vruns")
def run_status(spark, sf):
    return tool_runs(spark, sf).select("id", "tool", L.status_of(F.col("status")).alias("status"), L.expected_status(F.col("file")).alias("expected"))


@query(f"""WITH {_PROGRAMS}, prp AS (SELECT id, 'CHECK( init(main()), LTL(' || CASE id % 4 WHEN 0 THEN 'G ! call(__VERIFIER_error())' WHEN 1 THEN 'F end' WHEN 2 THEN 'G ! overflow' ELSE 'G valid-free' END || ') )' AS text FROM programs)
SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 4 = 3 THEN 'memory_safety' WHEN id % 4 = 2 THEN 'overflow' WHEN id % 4 = 1 THEN 'termination' ELSE 'unreachability' END
  WHEN id % 3 = 1 THEN CASE id % 4 WHEN 0 THEN 'unreachability' WHEN 1 THEN 'termination' WHEN 2 THEN 'overflow' ELSE 'memory_safety' END ELSE CASE WHEN id % 2 = 0 THEN 'termination' END END AS property FROM programs""")
def property_types(spark, sf):
    """A third of the programs name their property, a third have a file of their own, and half of the rest share one in their folder."""
    p, k = programs(spark, sf), F.col("id")
    bare = F.concat(F.lit("c/"), F.when(k % 2 == 0, "even").otherwise("odd"), F.lit("/p"), k.cast("string"), F.lit(".c"))
    tasks = p.select("id", F.when(k % 3 == 0, F.col("file")).otherwise(bare).alias("path"))
    said = F.when(k % 4 == 0, "G ! call(__VERIFIER_error())").when(k % 4 == 1, "F end").when(k % 4 == 2, "G ! overflow").otherwise("G valid-free")
    own = p.where(k % 3 == 1).select(F.regexp_replace(bare, r"\.c$", ".prp").alias("path"), F.concat(F.lit("CHECK( init(main()), LTL("), said, F.lit(") )")).alias("text"))
    shared = spark.range(1).select(F.lit("c/even/ALL.prp").alias("path"), F.lit("CHECK( init(main()), LTL(F end) )").alias("text"))
    return L.property_types(tasks, own.unionByName(shared)).select("id", "property")


@query(f"WITH {_PROGRAMS} SELECT id, array_to_string(list_filter([CASE WHEN contains(file, '-unreach-call') THEN 'reachability' END, CASE WHEN contains(file, '-termination') THEN 'termination' END, CASE WHEN contains(file, '-no-overflow') THEN 'overflow' END, CASE WHEN contains(file, '-valid-') THEN 'memory' END], lambda x: x IS NOT NULL), ',') AS props FROM programs")
def property_sets(spark, sf):
    return programs(spark, sf).select("id", F.array_join(B.properties_of(F.col("file")), ",").alias("props"))


_SCORED = f"{_VRUNS}, scored AS (SELECT id, tool, time, CASE WHEN solve = 1 THEN 1 WHEN solve = -1 THEN -6 ELSE 0 END AS score FROM (SELECT id, tool, time, {_VERDICT} AS solve FROM vruns))"


@query(f"WITH {_SCORED} SELECT a.id, a.tool AS x, b.tool AS y, (sign(a.score - b.score) + CASE WHEN a.score = b.score THEN sign(b.time - a.time) ELSE 0 END)::INT AS v FROM scored a JOIN scored b ON a.id = b.id AND a.tool < b.tool")
def compared_runs(spark, sf):
    solve = L.verdict(F.col("status"), F.col("file"), F.col("prop"))
    s = tool_runs(spark, sf).select("id", "tool", "time", F.when(solve == 1, 1).when(solve == -1, -6).otherwise(0).alias("score"))
    a, b = (s.select("id", *[F.col(c).alias(f"{c}_{k}") for c in ("tool", "time", "score")]) for k in "ab")
    both = a.join(b, "id").where("tool_a < tool_b")
    v = L.compared(F.col("score_a"), F.col("time_a"), F.col("score_b"), F.col("time_b"))
    return both.select("id", F.col("tool_a").alias("x"), F.col("tool_b").alias("y"), v.alias("v"))


@query(f"WITH {_VRUNS} SELECT id AS graph, tool, CASE WHEN CASE WHEN status LIKE 'false%' THEN 'false' ELSE status END = CASE WHEN contains(file, '_true-') THEN 'true' ELSE 'false' END THEN 'correct' ELSE 'false' END AS solve, time FROM vruns WHERE id % 2 = 0")
def extracted_runs(spark, sf):
    runs = tool_runs(spark, sf).select(F.col("id").alias("graph"), "tool", L.status_of(F.col("status")).alias("status"), L.expected_status(F.col("file")).alias("expected"), "time")
    return L.extracted(runs, runs.where(F.col("graph") % 2 == 0).select("graph"))


@query(f"WITH {_INDEX} SELECT file, tool, solve, time FROM idx")
def unpivoted_labels(spark, sf):
    index = L.indexed_runs(tool_runs(spark, sf))
    rows = index.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("tool", F.struct("solve", "time")))).alias("label"))
    return L.unpivoted(rows, "file")


@query(f"WITH {_PROGRAMS} SELECT id, regexp_extract(file, '([^/]*)/[^/]*$', 1) || '_' || replace(regexp_extract(file, '[^/]*$'), '.', '_') AS path_id, regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '') AS graph_id FROM programs")
def path_ids(spark, sf):
    return programs(spark, sf).select("id", L.path_id(F.col("file")).alias("path_id"), L.graph_id(F.col("file")).alias("graph_id"))


_PID = "regexp_extract(file, '([^/]*)/[^/]*$', 1) || '_' || replace(regexp_extract(file, '[^/]*$'), '.', '_')"
_PBAGS = f"{_INDEX}, pb AS (SELECT CASE WHEN id % 10 = 0 THEN 'lost_' || id ELSE {_PID} END AS graph, 'part' || l_partkey % 20 AS label, count(*)::DOUBLE AS cnt FROM programs JOIN lineitem ON l_orderkey = id GROUP BY ALL), want AS (SELECT DISTINCT {_PID} AS graph, prop, name FROM idx)"
_NID = "CASE WHEN contains(name, '/') THEN regexp_extract(name, '([^/]*)/[^/]*$', 1) ELSE '' END || '_' || replace(regexp_extract(name, '[^/]*$'), '.', '_')"


def program_bags(spark, sf) -> DataFrame:
    """Bags of part numbers by program path ids; every tenth is under another name."""
    graph = F.when(F.col("id") % 10 == 0, F.concat(F.lit("lost_"), F.col("id").cast("string"))).otherwise(L.path_id(F.col("file")))
    return programs(spark, sf).join(table(spark, sf, "lineitem"), F.col("id") == F.col("l_orderkey")).groupBy(graph.alias("graph"), F.concat(F.lit("part"), (F.col("l_partkey") % 20).cast("string")).alias("label")).agg(F.count("*").cast("double").alias("cnt"))


@query(f"WITH {_PBAGS} SELECT {_NID} AS graph, name AS file, label, cnt FROM pb JOIN want USING (graph) UNION ALL SELECT {_NID}, name, prop, 1.0 FROM want WHERE graph IN (SELECT graph FROM pb)")
def map_label(spark, sf):
    return L.mapped(program_bags(spark, sf), L.indexed_runs(tool_runs(spark, sf)))[0]


@query(f"WITH {_PBAGS} SELECT DISTINCT graph FROM pb WHERE graph NOT IN (SELECT graph FROM want)")
def map_label_lost(spark, sf):
    return L.mapped(program_bags(spark, sf), L.indexed_runs(tool_runs(spark, sf)))[1]


_VLABELS = f"{_INDEX}, vt AS (SELECT file || '|' || prop AS task, tool, solve, time FROM idx), total AS (SELECT count(DISTINCT task) AS n FROM vt), most AS (SELECT tool FROM vt GROUP BY tool HAVING count(DISTINCT task) >= (SELECT n - n * 3 // 4 FROM total) AND NOT contains(tool, 'cpa-bam'))"


def _run_labels(spark, sf) -> DataFrame:
    index = L.indexed_runs(tool_runs(spark, sf))
    return written(index.select(F.concat_ws("|", "file", "prop").alias("task"), "tool", "solve", "time"))


def _most(labels: DataFrame) -> DataFrame:
    """Tools that a quarter of the tasks have."""
    return L.tools_with_most(labels, labels.select("task").distinct().count() * 3 // 4)


@query(f"WITH {_VLABELS} SELECT tool FROM most")
def tools_with_most(spark, sf):
    return _most(_run_labels(spark, sf))


_GRID = f"{_VLABELS}, grid AS (SELECT t.task, m.tool, vt.solve, vt.time FROM (SELECT DISTINCT task FROM vt) t CROSS JOIN most m LEFT JOIN vt ON vt.task = t.task AND vt.tool = m.tool)"
_GPAIRS = "FROM {0} a JOIN {0} b ON a.task = b.task AND a.tool < b.tool"


@query(f"WITH {_GRID}, f AS (SELECT task, tool, coalesce(solve, 0) AS solve, coalesce(time, 900.0) AS time FROM grid) SELECT a.task, a.tool AS x, b.tool AS y, (CASE WHEN a.solve <> b.solve THEN sign(a.solve - b.solve) WHEN a.time >= 900 AND b.time >= 900 THEN 0 ELSE CASE WHEN a.time < b.time THEN 1 WHEN a.time > b.time THEN -1 ELSE 0 END END)::INT AS v {_GPAIRS.format('f')}")
def filled_preferences(spark, sf):
    labels = _run_labels(spark, sf)
    return L.preferences(L.filled(labels, _most(labels)))


_VALID = f"{_GRID}, g AS (SELECT task, tool, solve, CASE WHEN time < 900 THEN time END AS time FROM grid), vp AS (SELECT a.task, a.tool AS x, b.tool AS y, CASE WHEN a.time IS NULL THEN CASE WHEN b.time IS NULL THEN 0 ELSE -1 END WHEN b.time IS NULL OR a.solve > b.solve OR (a.solve = b.solve AND a.time < b.time) THEN 1 ELSE -1 END AS v {_GPAIRS.format('g')})"


@query(f"WITH {_VALID} SELECT task, x, y, v FROM vp")
def valid_preferences(spark, sf):
    labels = _run_labels(spark, sf)
    return L.valid_preferences(labels, _most(labels))


@query(f"WITH {_VALID}, pv AS (SELECT task, CASE WHEN v = 1 THEN x ELSE y END AS tool, count(*)::DOUBLE AS votes FROM vp WHERE v <> 0 GROUP BY ALL) SELECT g.task, g.tool, coalesce(votes, 0.0) AS votes, row_number() OVER (PARTITION BY g.task ORDER BY coalesce(votes, 0.0) DESC, g.tool DESC) - 1 AS pos FROM g LEFT JOIN pv ON pv.task = g.task AND pv.tool = g.tool")
def partial_ranking(spark, sf):
    labels = _run_labels(spark, sf)
    tools = _most(labels)
    cells = L.filled(labels, tools).select("task", "tool")
    return R.from_preferences(L.valid_preferences(labels, tools), cells)


@query(f"WITH {_INDEX}, num AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS idx FROM (SELECT DISTINCT file FROM idx)) SELECT DISTINCT prop, num.idx FROM idx JOIN num USING (file)")
def property_index(spark, sf):
    return L.property_index(L.indexed_runs(tool_runs(spark, sf)))[1]


@query(f"WITH {_INDEX}, num AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS idx FROM (SELECT DISTINCT file FROM idx)) SELECT DISTINCT prop, num.idx FROM idx JOIN num USING (file) WHERE prop IN ('termination', 'no-overflow') AND num.idx % 3 = 1")
def rows_of_slice(spark, sf):
    number, index = L.property_index(L.indexed_runs(tool_runs(spark, sf)))
    return L.rows_of_slice(number.where(F.col("idx") % 3 == 1), index, ["termination", "no-overflow"]).select("prop", "idx")


@query(f"WITH {_TOOLS}, {_FULL} SELECT task, string_agg(tool, ',' ORDER BY pos) AS ranking, 'g' || task AS graph FROM ranked WHERE task % 5 <> 0 GROUP BY task")
def dataset_rows(spark, sf):
    ranked = R.as_lists(R.full(tool_labels(spark, sf))).withColumnRenamed("task", "file")
    graphs = ranked.select("file", F.when(F.col("file") % 5 != 0, F.concat(F.lit("g"), F.col("file").cast("string"))).alias("graph"))
    return L.dataset(graphs, ranked).select(F.col("file").alias("task"), "graph", F.array_join("ranking", ",").alias("ranking"))


@query(f"WITH {_TOOLS}, {_FULL} SELECT t.task, t.cells, r.ranking FROM (SELECT task, count(*) * (count(*) + 1) // 2 AS cells FROM tools GROUP BY task) t JOIN (SELECT task, string_agg(tool, ',' ORDER BY pos) AS ranking FROM ranked GROUP BY task) r USING (task)")
def label_rows(spark, sf):
    labels = written(tool_labels(spark, sf))
    cells = L.label_matrix(labels).groupBy("task").agg(F.count("*").alias("cells"))
    return cells.join(R.as_lists(R.full(labels)), "task").select("task", "cells", F.array_join("ranking", ",").alias("ranking"))


@query("SELECT l_orderkey AS id, string_agg('part ' || l_partkey, ',' ORDER BY l_linenumber, 'part ' || l_partkey) AS items FROM lineitem GROUP BY l_orderkey")
def parsed_lists(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("part")))).alias("m"))
    text = F.concat(F.lit("['"), F.array_join(F.transform("m", lambda x: x["part"]), "', '"), F.lit("']"))
    return lines.select("id", F.array_join(L.parsed_list(text), ",").alias("items"))


@query("""WITH c AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey)
SELECT x, y, CASE WHEN x = y THEN x ELSE 24 + row_number() OVER (PARTITION BY x = y ORDER BY x, y) END AS place, x AS bx, y AS by FROM c""")
def packed_cells(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("x"))
    cells = n.join(n.withColumnRenamed("x", "y"), F.col("x") <= F.col("y"))  # 25 nations
    placed = cells.withColumn("place", L.packed_index(F.col("x"), F.col("y"), F.lit(25)).cast("long"))
    return placed.withColumn("back", L.unpacked_index(F.col("place"), F.lit(25))).select("x", "y", "place", F.col("back.x").alias("bx"), F.col("back.y").alias("by"))


_BYRESULT = f"""{_TOOLS}, seat AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY tool) - 1 AS nr FROM tools),
w AS (SELECT task, x, y, CASE WHEN sx = 1 AND sy <> 1 THEN x WHEN sy = 1 AND sx <> 1 THEN y WHEN tx < ty THEN x ELSE y END AS winner FROM pairs),
votes AS (SELECT task, winner AS tool, count(*) AS votes FROM w GROUP BY ALL),
head AS (SELECT w.task, w.winner AS head FROM w JOIN seat a ON a.task = w.task AND a.tool = w.x AND a.nr = 0 JOIN seat b ON b.task = w.task AND b.tool = w.y AND b.nr = 1),
r AS (SELECT s.task, s.tool, coalesce(votes, 0) AS votes, CASE WHEN s.tool = head THEN -1 ELSE nr END AS turn FROM seat s LEFT JOIN votes v ON v.task = s.task AND v.tool = s.tool LEFT JOIN head ON head.task = s.task),
byresult AS (SELECT task, tool, votes, row_number() OVER (PARTITION BY task ORDER BY votes DESC, turn) - 1 AS pos FROM r)"""


@query(f"WITH {_BYRESULT} SELECT * FROM byresult")
def rank_by_result(spark, sf):
    return R.by_result(tool_labels(spark, sf))


@query(f"WITH {_VLABELS}, p AS (SELECT a.task, a.tool AS x, b.tool AS y, CASE WHEN a.solve > b.solve THEN 1.0 WHEN a.solve < b.solve THEN 0.0 WHEN a.time >= 900 AND b.time >= 900 THEN 0.5 ELSE (a.time < b.time)::INT::DOUBLE END AS p FROM vt a JOIN vt b ON a.task = b.task AND a.tool < b.tool), g AS (SELECT task, x AS tool, p AS v FROM p UNION ALL SELECT task, y, 1 - p FROM p), v AS (SELECT t.task, t.tool, round(coalesce(sum(v), 0.0), 6) AS votes FROM vt t LEFT JOIN g ON g.task = t.task AND g.tool = t.tool GROUP BY ALL) SELECT split_part(task, '|', 1) AS file, split_part(task, '|', 2) AS prop, tool, votes, dense_rank() OVER (PARTITION BY task ORDER BY votes DESC) - 1 AS grp FROM v")
def rank_ties_by_property(spark, sf):
    index = L.indexed_runs(tool_runs(spark, sf))
    ranked = R.with_ties(written(index.select(F.struct("file", "prop").alias("task"), "tool", "solve", "time")))
    return ranked.select("task.file", "task.prop", "tool", "votes", "grp")


# ---------------------------------------------------------------- the bags' container


@query("SELECT DISTINCT coalesce(source, '-') AS category FROM documents")
def categories(spark, sf):
    return B.categories(table(spark, sf, "documents").withColumn("category", F.coalesce("source", F.lit("-"))))


_NUM = "num AS (SELECT doc_id AS graph, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM (SELECT DISTINCT doc_id FROM documents))"


@query(f"WITH {_NUM} SELECT idx, graph, quality, toxic FROM num JOIN labels ON doc_id = graph JOIN documents d ON d.doc_id = graph WHERE source IN ('src1', 'src2')")
def labels_in_order(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("graph"), F.col("source").alias("category"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("graph"), "quality", "toxic").join(docs, "graph")
    return B.labels_of(labels, B.dense_index(docs, "graph"), ["src1", "src2"]).select("idx", "graph", "quality", "toxic")


@query("SELECT d.doc_id AS graph, coalesce(l.quality * 1.5, -1.0)::DOUBLE AS time FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def graph_times(spark, sf):
    times = table(spark, sf, "labels").select(F.col("doc_id").alias("graph"), (F.col("quality") * 1.5).cast("double").alias("time"))
    return B.with_time(table(spark, sf, "documents").select(F.col("doc_id").alias("graph")), times)


@query("SELECT doc_id AS graph FROM documents WHERE source = 'src3' AND contains(text, chr(10)) AND n_chars > 500")
def bag_filter(spark, sf):
    props = F.array_compact(F.array(F.when(F.col("text").contains("\n"), F.lit("lines"))))
    tasks = table(spark, sf, "documents").select(F.col("doc_id").alias("graph"), F.col("source").alias("category"), props.alias("props"), "n_chars")
    return B.filtered(tasks, category="src3", task_type="lines", where=F.col("n_chars") > 500).select("graph")


@query(f"WITH {_DOCS} SELECT label, count(*) / (SELECT count(DISTINCT graph) FROM docs) AS share FROM docs GROUP BY label")
def label_share(spark, sf):
    return B.frequency(document_bags(spark, sf))


_LEVELS2 = f"{_BAGS}, lv AS (SELECT 0 AS h, graph, label, cnt FROM bags UNION ALL SELECT 1, graph, substr(label, 1, 3), cnt FROM bags WHERE graph <> 'src1/en')"


def _levels(spark, sf) -> DataFrame:
    """Words as level 0, their beginnings as level 1, which one graph lacks."""
    bags = source_bags(spark, sf)
    return bags.withColumn("h", F.lit(0)).unionByName(bags.where("graph <> 'src1/en'").withColumn("label", F.substring("label", 1, 3)).withColumn("h", F.lit(1)))


@query(f"WITH {_LEVELS2} SELECT h, graph, count(*) AS n FROM lv WHERE graph <> 'src1/en' GROUP BY ALL")
def complete_levels(spark, sf):
    return B.complete_graphs(_levels(spark, sf), 1).groupBy("h", "graph").agg(F.count("*").alias("n"))


@query(f"WITH {_LEVELS2}, d AS (SELECT h, label, count(DISTINCT graph) AS df FROM lv GROUP BY ALL), s AS (SELECT label, sum(df)::BIGINT AS df FROM d GROUP BY label) SELECT label, df, row_number() OVER (ORDER BY df DESC, label) - 1 AS idx FROM s ORDER BY df DESC, label LIMIT 10000")
def vocab_levels(spark, sf):
    return B.top_index(B.level_frequency(_levels(spark, sf), 1), 10_000)


@query(f"WITH {_DOCS} SELECT d.graph, d.label, d.cnt, doc.source AS file, 'quality' AS tool, l.quality AS solve FROM docs d JOIN documents doc ON doc.doc_id = d.graph JOIN labels l ON l.doc_id = d.graph WHERE doc.source IS NOT NULL")
def bag_entities(spark, sf):
    files = table(spark, sf, "documents").where("source is not null").select(F.col("doc_id").alias("graph"), F.col("source").alias("file"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("graph"), F.lit("quality").alias("tool"), F.col("quality").alias("solve"))
    return B.entities(document_bags(spark, sf), files, labels)
