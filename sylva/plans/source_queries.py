"""Queries of the readers: regions and nations are written in each file form, read back, and compared with the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import graphs as G
from sylva.operators import labels as L
from sylva.plans.queries import query
from sylva.session import shared_dir, table
from sylva.sources import readers as S


def _nations(spark: SparkSession, sf: str) -> list:
    """All nations and regions by key: 25 rows at any scale."""
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sorted(both.select("n_nationkey", "n_name", "r_regionkey", "r_name").collect())


def _files(spark: SparkSession, files: dict[str, str]) -> str:
    """A new folder with these small files, in the shared folder of the session."""
    folder = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, text in files.items():
        at = hadoop.Path(f"{folder}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(text.encode()))
        out.close()
    return folder


def _xml(spark: SparkSession, sf: str) -> str:
    """Results of two tools over nations, one a file by region, and a witness check of the second."""
    files, rows = {}, _nations(spark, sf)
    for region in sorted({r.r_regionkey for r in rows}):
        for tool, kind in (("alpha", "results"), ("beta", "results"), ("beta", "witness")):
            runs = ""
            for r in (r for r in rows if r.r_regionkey == region):
                k = r.n_nationkey
                status = "true" if (k + len(tool)) % 2 else "false(unreach-call)"
                runs += f'<run name="c/cat/n{k}_{"true" if k % 3 else "false"}-unreach-call.c" properties="unreach-call"><column title="status" value="{status}"/><column title="cputime" value="{k * 10.5}s"/><column title="walltime" value="{k}s"/><column title="memUsage" value="{k}B"/></run>'
            check = "18-12-02." if kind == "witness" else ""
            files[f"{tool}.18-12-01.{check}{kind}.sv-comp18.cat{region}.xml"] = f'<?xml version="1.0"?><result benchmarkname="{tool}" tool="{tool}">{runs}</result>'
    return _files(spark, files)


_RUNSQL = """SELECT tool, 'c/cat/n' || k || '_' || CASE WHEN k % 3 <> 0 THEN 'true' ELSE 'false' END || '-unreach-call.c' AS vtask, CASE WHEN (k + length(tool)) % 2 = 1 THEN 'true' ELSE 'false(unreach-call)' END AS status, k * 10.5::DOUBLE AS cputime, k::DOUBLE AS walltime, n_regionkey AS region
  FROM (SELECT n_nationkey AS k, n_regionkey FROM nation) CROSS JOIN (SELECT unnest(['alpha', 'beta']) AS tool)"""


@query(f"WITH r AS ({_RUNSQL}) SELECT tool, vtask, status, cputime, walltime FROM r WHERE region = 2")
def read_category(spark, sf):
    results, _ = S.category_results(spark, f"{_xml(spark, sf)}/*.xml", "cat2")
    return results.select("tool", "vtask", "status", "cputime", "walltime")


@query(f"WITH r AS ({_RUNSQL}) SELECT tool, vtask, status FROM r WHERE region = 2 AND tool = 'beta' AND length(vtask) <= 29")
def read_witness_checks(spark, sf):
    path = f"{_xml(spark, sf)}/*.xml"
    sizes = S.tool_results(spark, path).select("vtask", F.length("vtask").alias("size")).distinct()
    return S.category_results(spark, path, "cat2", sizes, 29)[1].select("tool", "vtask", "status")


@query(f"WITH r AS ({_RUNSQL}) SELECT 'cat' || region AS category, count(*) AS n FROM r WHERE region IN (0, 3) GROUP BY ALL")
def read_categories(spark, sf):
    rows = S.read_categories(spark, f"{_xml(spark, sf)}/*.results.*.xml", ["cat0", "cat3", "none"])
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH r AS ({_RUNSQL}) SELECT vtask AS file, 'unreach-call' AS prop, tool, CASE WHEN contains(status, 'true') THEN CASE WHEN contains(vtask, 'true-unreach-call') THEN 1 ELSE -1 END WHEN contains(vtask, 'false-unreach-call') THEN 1 ELSE -1 END AS solve, cputime AS time FROM r
UNION ALL SELECT 'c/t/n' || n_nationkey || '_true-unreach-call.c', 'unreach-call', 'gamma', CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END, n_nationkey * 2.0::DOUBLE FROM nation""")
def read_index(spark, sf):
    rows = _nations(spark, sf)
    body = "".join(f"|c/t/n{r.n_nationkey}_true-unreach-call.c|\t{'true' if r.n_nationkey % 2 == 0 else 'unknown'}\t{r.n_nationkey * 2.0}\n" for r in rows)
    tsv = _files(spark, {"gamma.csv": "tool\t|gamma|\nrun set\tx\nname\tstatus\tcputime\n" + body})
    index = S.index_rows(spark, f"{_xml(spark, sf)}/*.results.*.xml", f"{tsv}/*.csv")
    return L.indexed_runs(index).select("file", "prop", "tool", "solve", "time")


_TREE = "SELECT 'g' || n_regionkey AS graph, 'n' || n_nationkey AS src, CASE WHEN n_nationkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey || '_0' END AS dst FROM nation"


def _graphs(spark: SparkSession, sf: str) -> str:
    """A graph for each region: even nations point to it, edges of odd ones are written backwards from a tree node."""
    files, rows = {}, _nations(spark, sf)
    for region in sorted({r.r_regionkey for r in rows}):
        nodes, edges = {f"r{region}": "region"}, []
        for r in (r for r in rows if r.r_regionkey == region):
            nodes[f"n{r.n_nationkey}"] = r.n_name
            if r.n_nationkey % 2 == 0:
                edges.append([f"n{r.n_nationkey}", "s|>", f"r{region}"])
            else:
                nodes[f"n{r.n_nationkey}_0"] = "leaf"
                edges.append([f"n{r.n_nationkey}_0", "<|s", f"n{r.n_nationkey}"])
        files[f"g{region}.dfs"] = json.dumps({"nodes": nodes, "edges": edges})
    return _files(spark, files)


@query(f"WITH t AS ({_TREE}) SELECT graph, src, dst, 's' AS etype FROM t UNION ALL SELECT graph, dst, src, 's' FROM t WHERE dst LIKE 'n%'")
def read_graphs(spark, sf):
    return S.program_graphs(spark, f"{_graphs(spark, sf)}/*.dfs")[1]


@query("SELECT 'g' || r_regionkey AS graph, count(*) FILTER (WHERE n_nationkey % 2 = 0) + 1 AS parts FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey HAVING parts > 1")
def torn_graphs(spark, sf):
    """Graphs of regions of which each second nation has lost its edge: those that don't hang together, with the number of their parts."""
    files = {}
    for r in _nations(spark, sf):
        g = files.setdefault(f"g{r.r_regionkey}.dfs", {"nodes": {f"r{r.r_regionkey}": "region"}, "edges": []})
        g["nodes"][f"n{r.n_nationkey}"] = r.n_name
        if r.n_nationkey % 2:
            g["edges"].append([f"n{r.n_nationkey}", "s|>", f"r{r.r_regionkey}"])
    nodes, edges = S.program_graphs(spark, f"{_files(spark, {k: json.dumps(v) for k, v in files.items()})}/*.dfs")
    return S.whole_graphs(nodes, edges)[2]


@query("SELECT 'o' || n_regionkey AS graph, 'n' || n_nationkey AS node, n_name AS label FROM nation UNION ALL SELECT DISTINCT 'o' || n_regionkey, 'r' || n_regionkey, 'region' FROM nation")
def read_old_graphs(spark, sf):
    files = {}
    for r in _nations(spark, sf):
        files.setdefault(f"o{r.r_regionkey}.dfs", []).append([f"n{r.n_nationkey}", f"r{r.r_regionkey}", r.n_name, "se", "region"])
    path = _files(spark, {k: json.dumps(v) for k, v in files.items()})
    return S.any_graphs(spark, f"{path}/*.dfs")[0].select("graph", "node", "label")


@query("SELECT n_name AS node, CASE WHEN r_name = 'ASIA' THEN 'EAST' ELSE r_name END AS label FROM nation JOIN region ON r_regionkey = n_regionkey")
def read_node_lines(spark, sf):
    lines = "".join(f"{r.n_name},{r.r_name}\n" for r in _nations(spark, sf)) + "not a line\n"
    return S.labelled_lines(spark, _files(spark, {"nodes.txt": lines}), ["node", "label"], {"ASIA": "EAST"})


@query("SELECT n_name AS src, r_name AS dst, 'type' AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'de' ELSE 'se' END AS value, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 4 END AS kind FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, r_name, 'truth', 'true', NULL FROM nation JOIN region ON r_regionkey = n_regionkey")
def read_edge_lines(spark, sf):
    lines = "".join(f"{r.n_name},{r.r_name},type,{'se' if r.n_nationkey % 2 else 'de'}\n{r.n_name},{r.r_name},truth,true\n" for r in _nations(spark, sf))
    return S.edge_lines(spark, _files(spark, {"edges.txt": lines}), {v: k for k, v in G.EDGE_KINDS.items()})


@query("SELECT n_name AS node, n_nationkey::INT AS depth FROM nation")
def read_depth_lines(spark, sf):
    lines = "".join(f"{r.n_name},{r.n_nationkey}\n" for r in _nations(spark, sf)) + "x,deep\n"
    return S.depth_lines(spark, _files(spark, {"depths.txt": lines}))


def _bag_rows(rows: list) -> dict[str, dict]:
    return {f"n{r.n_nationkey}": {r.n_name: r.n_nationkey + 1, "nation": 2} for r in rows}


_BAGSQL = "SELECT 'n' || n_nationkey AS graph, n_name AS label, (n_nationkey + 1)::DOUBLE AS cnt FROM nation UNION ALL SELECT 'n' || n_nationkey, 'nation', 2.0 FROM nation"


@query(f"SELECT graph, 1 AS h, 2 AS d, label, cnt FROM ({_BAGSQL})")
def read_bags(spark, sf):
    files = {f"{k}_1_2.json": json.dumps({"file": k, "kernel_bag": v}) for k, v in _bag_rows(_nations(spark, sf)).items()}
    return S.bags(spark, f"{_files(spark, files)}/*.json")


def _level_file(rows: list) -> str:
    return json.dumps({k: {"file": k, "kernel_bag": v} for k, v in _bag_rows(rows).items()})


@query(f"SELECT 'by level' AS found, graph, label, cnt FROM ({_BAGSQL}) UNION ALL SELECT 'as it stands', graph, label, cnt FROM ({_BAGSQL})")
def read_bag_level(spark, sf):
    path = _files(spark, {"bag_1_2.json": _level_file(_nations(spark, sf)), "bag.json": _level_file(_nations(spark, sf))})
    out = S.bag_level(spark, f"{path}/bag_%d_%d.json", 1, 2).withColumn("found", F.lit("by level"))
    return out.unionByName(S.bag_level(spark, f"{path}/bag.json", 1, 2).withColumn("found", F.lit("as it stands")))


@query(f"SELECT graph, 1 AS h, 2 AS d, label, cnt FROM ({_BAGSQL})")
def write_grouped_bags(spark, sf):
    bags: DataFrame = read_bags(spark, sf)
    path = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex}"
    S.write_grouped(bags, path)
    return S.bags_of_lines(spark, path).select("graph", "h", "d", "label", "cnt")


@query('SELECT n_nationkey::BIGINT AS "row", n_regionkey::BIGINT AS col, n_nationkey * 0.5::DOUBLE AS cnt FROM nation')
def read_features(spark, sf):
    rows = _nations(spark, sf)
    text = json.dumps({"rows": [r.n_nationkey for r in rows], "columns": [r.r_regionkey for r in rows], "data": [r.n_nationkey * 0.5 for r in rows]})
    path = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex}"
    S.write_features(S.feature_json(spark, _files(spark, {"features.json": text})), path)
    return spark.read.parquet(path)
