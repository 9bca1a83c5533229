"""Queries of graph operators over the driver's organisation tree, where nations and regions hear many neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators import bags as B
from sylva.operators import graphs as G
from sylva.operators import learners as C
from sylva.plans.queries import _DEPTH, _ORG_E, _ORG_N, organisation, query
from sylva.session import table


def _step(k: int, said: str, own: str, silent: str, more: str = "") -> str:
    """Level k of labels from level k - 1: what in-neighbours say (of label), and what a node makes of it (label, heard)."""
    return f"""h{k} AS (SELECT dst AS node, string_agg(d, '_' ORDER BY d) AS heard FROM (SELECT dst, md5({said}) AS d FROM e JOIN l{k - 1} ON node = src) GROUP BY dst),
l{k} AS (SELECT node{more}, CASE WHEN heard IS NULL THEN {silent} ELSE {own} END AS label, heard IS NOT NULL AS heard_any FROM l{k - 1} LEFT JOIN h{k} USING (node))"""


_PLAIN = ("label || '_s'", "md5(label || '_' || heard)", "md5(label)")


@query(f"WITH {_ORG_N}, {_ORG_E}, l0 AS (SELECT * FROM n), {_step(1, *_PLAIN)}, {_step(2, *_PLAIN)} SELECT 0 AS h, node, label FROM l0 UNION ALL SELECT 1, node, label FROM l1 UNION ALL SELECT 2, node, label FROM l2")
def wl_node_labels(spark, sf):
    return G.wl_levels(*organisation(spark, sf), 2).select("h", "node", "label")


_NAMES = {"AUTOMOBILE": "VEHICLE", "MACHINERY": "VEHICLE", "supplier": "partner"}
_SYN = f"l0 AS (SELECT node, CASE WHEN label IN ('AUTOMOBILE', 'MACHINERY') THEN 'VEHICLE' WHEN label = 'supplier' THEN 'partner' ELSE label END AS label FROM n)"


@query(f"WITH {_ORG_N}, {_ORG_E}, {_SYN}, {_step(1, _PLAIN[0].replace('_s', '_tree'), *_PLAIN[1:])} SELECT label, count(*)::DOUBLE AS cnt FROM l1 GROUP BY label")
def wl_synonyms(spark, sf):
    nodes, edges = organisation(spark, sf)
    step = G.wl_relabel(G.with_synonyms(nodes, "label", _NAMES), G.with_synonyms(edges, "etype", {"s": "tree"}))
    return B.label_counts(step)


_COUNTED = ("'s__' || label", "md5(heard || '_' || label)", "label")


@query(f"WITH {_ORG_N}, {_ORG_E}, l0 AS (SELECT * FROM n), {_step(1, *_COUNTED)}, {_step(2, *_COUNTED)} SELECT h, label, count(*)::DOUBLE AS cnt FROM (SELECT 0 AS h, label FROM l0 UNION ALL SELECT 1, label FROM l1 WHERE heard_any UNION ALL SELECT 2, label FROM l2 WHERE heard_any) GROUP BY ALL")
def wl_counted(spark, sf):
    return B.label_counts(G.wl_levels(*organisation(spark, sf), 2, G.wl_relabel_counted), "h")


_PREFIXED = ("label || '_s'", "origin || '_' || md5(label || '_' || heard)", "label", ", origin")


@query(f"WITH {_ORG_N}, {_ORG_E}, l0 AS (SELECT *, label AS origin FROM n), {_step(1, *_PREFIXED)}, {_step(2, *_PREFIXED)} SELECT h, node, label FROM (SELECT 0 AS h, node, label FROM l0 UNION ALL SELECT 1, node, label FROM l1 UNION ALL SELECT 2, node, label FROM l2)")
def wl_prefixed(spark, sf):
    return G.wl_levels(*organisation(spark, sf), 2, G.wl_relabel_prefixed).select("h", "node", "label")


@query(f"""{_DEPTH}, cuts AS (SELECT unnest([1, 2]) AS d), dn AS (SELECT d, node, label FROM depths JOIN cuts ON depth <= d),
de AS (SELECT x.d, src, dst FROM e JOIN dn x ON x.node = src JOIN dn y ON y.node = dst AND y.d = x.d),
dh AS (SELECT d, dst AS node, string_agg(m, '_' ORDER BY m) AS heard FROM (SELECT de.d, dst, md5(label || '_s') AS m FROM de JOIN dn ON dn.d = de.d AND node = src) GROUP BY ALL),
dl AS (SELECT d, node, md5(CASE WHEN heard IS NULL THEN label ELSE label || '_' || heard END) AS label FROM dn LEFT JOIN dh USING (d, node))
SELECT d, h, label, count(*)::DOUBLE AS cnt FROM (SELECT d, 0 AS h, label FROM dn UNION ALL SELECT d, 1, label FROM dl) GROUP BY ALL""")
def depth_bags(spark, sf):
    nodes, edges = organisation(spark, sf)
    return G.depth_bags(G.depth_labels(nodes, edges), edges, 1, 2).drop("graph")


@query(f"""WITH {_ORG_N}, {_ORG_E}, r AS (SELECT label, min(node) AS root FROM n GROUP BY label), r1 AS (SELECT DISTINCT label, root, src AS node FROM r JOIN e ON dst = root),
r2 AS (SELECT DISTINCT label, root, src AS node FROM r1 JOIN e ON dst = node), s AS (SELECT label, root, root AS node FROM r UNION SELECT * FROM r1 UNION SELECT * FROM r2)
SELECT x.label, x.root, e.src, e.dst FROM e JOIN s x ON x.node = e.src JOIN s y ON y.node = e.dst AND y.label = x.label AND y.root = x.root""")
def neighbourhoods(spark, sf):
    return G.neighbourhoods(*organisation(spark, sf), 2)[1].select("label", "root", "src", "dst")


@query("SELECT l_orderkey AS src, l_linenumber AS dst, CASE l_linenumber WHEN 1 THEN 'de' WHEN 2 THEN 'ce' WHEN 3 THEN 'cfe' WHEN 4 THEN 'se' WHEN 5 THEN 't' WHEN 6 THEN 'f' WHEN 7 THEN 'dummy' END AS etype FROM lineitem")
def edge_names(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("dst"), F.col("l_linenumber").alias("etype"))
    return G.edge_names(edges)


_KINDS = "CASE WHEN dst LIKE 'r%' OR src LIKE 'c%' THEN 'se' ELSE 'de' END"


def kinds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The organisation with suppliers' edges as data edges (de), all others as tree edges (se)."""
    nodes, edges = organisation(spark, sf)
    return nodes, edges.withColumn("etype", F.when(F.col("dst").startswith("r") | F.col("src").startswith("c"), "se").otherwise("de"))


@query(f"""WITH RECURSIVE {_ORG_N}, {_ORG_E}, k AS (SELECT src, dst, {_KINDS} AS etype FROM e),
c AS (SELECT dst AS root, src AS node FROM k WHERE etype = 'se' UNION ALL SELECT c.root, k.src FROM c JOIN k ON k.dst = c.node AND etype = 'se'),
w AS (SELECT node, 0 AS part, label FROM n UNION ALL SELECT dst, 1, label FROM k JOIN n ON node = src WHERE etype = 'de' UNION ALL SELECT c.root, 2, label FROM c JOIN n USING (node))
SELECT node, string_agg(label, ' ' ORDER BY part, label) AS sentence FROM w GROUP BY node""")
def graph_sentences(spark, sf):
    return C.graph_sentences(*kinds(spark, sf)).select("node", "sentence")


@query(f"WITH RECURSIVE {_ORG_E}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), c AS (SELECT x AS node, x AS label FROM b UNION SELECT b.y, c.label FROM c JOIN b ON b.x = c.node AND c.label < b.y), g AS (SELECT node, min(label) AS label FROM c GROUP BY node) SELECT node, label FROM g")
def connected(spark, sf):
    return G.connected(organisation(spark, sf)[1]).select("node", "label")
