"""Queries of evaluation drivers, kernel machines, composed kernels, selection over splits, and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators import bags as B
from sylva.operators import evaluation as E
from sylva.operators import kernel_machines as V
from sylva.operators import kernels as K
from sylva.operators import labels as L
from sylva.operators import learners as C
from sylva.operators import metrics as M
from sylva.operators import ranking as R
from sylva.operators import reduction as D
from sylva.operators import selection as S
from sylva.operators import sparse_learners as N
from sylva.plans.label_queries import _BYRESULT, _INDEX, _LEVELS2, _levels, tool_runs
from sylva.plans.queries import _BAGS, _BYCLS, _CLASSES, _DOCS, _FULL, _TIES, _TOOLS, document_bags, labelled_bags, query, rounded, source_bags, tool_labels
from sylva.session import table, written

_FOLDS = "drawn AS (SELECT task, row_number() OVER (ORDER BY md5(task::VARCHAR), task) - 1 AS idx FROM (SELECT DISTINCT task FROM tools)), folds AS (SELECT task, (idx % 10)::INT AS fold FROM drawn)"


@query(f"WITH {_TOOLS}, {_FOLDS} SELECT task, fold FROM folds")
def balanced_folds(spark, sf):
    return E.folds(tool_labels(spark, sf).select("task"))


@query(f"WITH {_TOOLS}, {_FOLDS} SELECT task, idx < ceil(0.33 * (SELECT count(*) FROM drawn)) AS test FROM drawn")
def split_third(spark, sf):
    return E.split(tool_labels(spark, sf).select("task"))


_CVGUESS = f"""{_FOLDS}, pf AS (SELECT fold, tool, sum(n - pos - 1) AS own FROM (SELECT *, count(*) OVER (PARTITION BY task) AS n FROM ranked) JOIN folds USING (task) GROUP BY ALL),
allp AS (SELECT tool, sum(own) AS total FROM pf GROUP BY tool),
ord AS (SELECT f.fold, a.tool, total - coalesce(own, 0) AS points FROM (SELECT DISTINCT fold FROM folds) f CROSS JOIN allp a LEFT JOIN pf ON pf.fold = f.fold AND pf.tool = a.tool),
guess AS (SELECT t.task, t.tool, row_number() OVER (PARTITION BY t.task ORDER BY points DESC, t.tool) - 1 AS pos FROM tools t JOIN folds f ON f.task = t.task JOIN ord ON ord.fold = f.fold AND ord.tool = t.tool)"""
_METRICS = """tops AS (SELECT g.task, t.solve, t.time, s.solvable, s.total FROM guess g JOIN tools t ON g.task = t.task AND g.tool = t.tool
  JOIN (SELECT task, max((solve = 1)::INT) AS solvable, sum(time) AS total FROM tools GROUP BY task) s ON s.task = g.task WHERE g.pos = 0),
spear AS (SELECT task, CASE WHEN n > 1 THEN 1 - 6 * d / (n * (n * n - 1)) END AS score FROM (SELECT r.task, sum((r.pos - g.pos) ** 2) AS d, count(*) AS n FROM ranked r JOIN guess g ON g.task = r.task AND g.tool = r.tool GROUP BY r.task)),
tb AS (SELECT t.task, t.grp, g.pos FROM tied t JOIN guess g ON g.task = t.task AND g.tool = t.tool),
kend AS (SELECT a.task, coalesce(avg(CASE WHEN c.grp IS NULL THEN NULL WHEN a.pos < c.pos THEN 1.0 ELSE -1.0 END), 1.0) AS score FROM tb a LEFT JOIN tb c ON a.task = c.task AND a.grp < c.grp GROUP BY a.task),
two AS (SELECT g.task, g.pos, t.solve, t.time FROM guess g JOIN tools t ON t.task = g.task AND t.tool = g.tool WHERE g.pos < 2),
m AS (SELECT r.task, 'accuracy' AS metric, (r.tool = g.tool)::INT::DOUBLE AS score FROM ranked r JOIN guess g ON g.task = r.task WHERE r.pos = 0 AND g.pos = 0
UNION ALL SELECT task, 'spearman', score FROM spear UNION ALL SELECT task, 'spearman_lambda', (round(score, 9) >= 0.5)::INT::DOUBLE FROM spear
UNION ALL SELECT task, 'kendall', score FROM kend UNION ALL SELECT task, 'inv_kendall', 1 - score FROM kend
UNION ALL SELECT task, 'svcomp', CASE WHEN solve = 1 THEN 1 WHEN solvable = 1 THEN -1 ELSE 0 END FROM tops UNION ALL SELECT task, 'correct', (solve = 1 OR solvable = 0)::INT::DOUBLE FROM tops
UNION ALL SELECT task, 'correct_count', (solve = 1)::INT::DOUBLE FROM tops UNION ALL SELECT task, 'time', time / total FROM tops
UNION ALL SELECT task, 'time_count', (time / total < 1)::INT::DOUBLE FROM tops UNION ALL SELECT task, 'inv_time', 1 - time / total FROM tops
UNION ALL SELECT x.task, 'fail_fast', coalesce((x.solve <> 1 AND y.solve <> 1 AND x.time <= y.time)::INT::DOUBLE, 0.0) FROM (SELECT * FROM two WHERE pos = 0) x LEFT JOIN (SELECT * FROM two WHERE pos = 1) y ON y.task = x.task)"""
_MAJORITY = f"WITH {_TOOLS}, {_FULL}, {_TIES}, {_CVGUESS}, {_METRICS}"


@query(f"{_MAJORITY} SELECT metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(score) AS n FROM (SELECT metric, fold, avg(score) AS score FROM m JOIN folds USING (task) GROUP BY ALL) GROUP BY metric")
def cv_majority(spark, sf):
    return rounded(E.cross_majority(tool_labels(spark, sf)), "mean", "std")


@query(f"{_MAJORITY} SELECT task, metric, round(score, 6) AS score FROM m")
def scores_by_name(spark, sf):
    labels = written(tool_labels(spark, sf))
    ranked, fold = written(R.full(labels)), written(E.folds(labels.select("task").distinct()))
    return rounded(E.scored(E.Ranked(labels, written(E.majority_predicted(ranked, fold)), ranked)), "score")


def event_bags(spark, sf) -> DataFrame:
    """Bags of the users' events, by kind and tens of k."""
    k = F.floor(F.regexp_extract("props", r"(\d+)", 1).cast("int") / 10).cast("string")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("graph"), F.concat_ws("/", "event_type", k).alias("label")).agg(F.count("*").cast("double").alias("cnt"))


_FEW = ["accuracy", "spearman", "kendall", "correct"]


def _events(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Labels of users' events, and the kernel of their bags."""
    return tool_labels(spark, sf), V.Kernel(event_bags(spark, sf))


@query()
def cv_pairwise(spark, sf):
    """Machines on the Gram for each pair of tools, C chosen within each fold's training tasks."""
    return E.cross_pairwise(*_events(spark, sf), 5, grid=(0.1, 1.0, 10.0), names=_FEW)


@query()
def cv_hyper(spark, sf):
    """Machines for each tool and each pair, votes from both."""
    return E.cross_pairwise(*_events(spark, sf), 5, "hyper", grid=(0.1, 1.0, 10.0), names=_FEW)


@query()
def cv_chances(spark, sf):
    """The same by chances instead of classes."""
    return E.cross_pairwise(*_events(spark, sf), 5, "hyper", grid=(1.0,), chances=True, names=_FEW)


@query()
def cv_pair_chances(spark, sf):
    """Machines for each pair by chances."""
    return E.cross_pairwise(*_events(spark, sf), 3, grid=(1.0,), chances=True, names=_FEW)


@query()
def cv_inner(spark, sf):
    """C by the mean f1 over inner folds, and what the fold of the best mean accuracy has taken for each pair."""
    return E.Crossed(*_events(spark, sf), 3, grid=(0.1, 1.0, 10.0), names=_FEW, metric="f1", inner=3).best_fold("accuracy")


@query()
def cv_pair_metrics(spark, sf):
    """Accuracy, precision, recall and f1 of each pair's machines over the folds."""
    return E.Crossed(*_events(spark, sf), 3, grid=(1.0,), names=["accuracy"]).pair_metrics()


@query()
def in_sample(spark, sf):
    """Scores of the rankings that machines over all tasks give these very tasks."""
    return E.in_sample(*_events(spark, sf), (1.0,), _FEW)[1]


@query()
def cv_quality(spark, sf):
    """Rankings by a machine for each tool, ties by its share of solved training tasks."""
    return E.cross_quality(*_events(spark, sf), 5, (1.0,), _FEW)


@query()
def cv_overall(spark, sf):
    """Trained on all properties, tested on each: a supplier's lines by their flag are its tasks, thirds of an order the tools."""
    third = F.when(F.col("l_linenumber") <= 2, "first").when(F.col("l_linenumber") <= 4, "middle").otherwise("last")
    month = F.concat_ws("/", F.month("l_shipdate"), "l_linestatus")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("prop"), third.alias("mode"), "l_quantity", "l_tax", month.alias("label"))
    lines = written(lines.withColumn("task", F.concat_ws("|", "file", "prop")))
    labels = lines.groupBy("task", F.col("mode").alias("tool")).agg((F.avg("l_tax") < 0.04).cast("int").alias("solve"), F.sum("l_quantity").alias("time"))
    bags = lines.groupBy(F.col("task").alias("graph"), "label").agg(F.count("*").cast("double").alias("cnt"))
    return E.cross_overall(labels, lines.select("task", "file", "prop").distinct(), V.Kernel(bags), 2, (1.0,), ["accuracy", "spearman"])


@query()
def joint_grid(spark, sf):
    """Three C and a kernel chosen together for the choice among two tools."""
    bags = written(event_bags(spark, sf))
    return E.joint_grid(tool_labels(spark, sf), {name: V.Kernel(bags, name) for name in ("linear", "jaccard")}, "click", "view", 3, 3, (0.01, 1.0, 100.0))[0]


@query()
def cv_front(spark, sf):
    """Kernels that no other beats within a fold's training tasks, refitted and scored on the fold."""
    bags = written(event_bags(spark, sf))
    return E.cross_front(tool_labels(spark, sf), {name: V.Kernel(bags, name) for name in ("linear", "jaccard")}, 2, 2, (1.0,))


_ROWS = """ids AS (SELECT task, task % 40 AS id FROM tools), chance AS (SELECT p.task, p.x, p.y, round(ty / (tx + ty), 6) AS p FROM pairs p),
once AS (SELECT id, x, y, max(p) AS p FROM chance JOIN (SELECT DISTINCT task, id FROM ids) USING (task) WHERE id < 30 GROUP BY ALL),
both2 AS (SELECT id, x AS tool, p AS v FROM once UNION ALL SELECT id, y, 1 - p FROM once),
guessed AS (SELECT id, tool, row_number() OVER (PARTITION BY id ORDER BY round(sum(v), 6) DESC, tool DESC) - 1 AS pos FROM both2 GROUP BY id, tool),
truth AS (SELECT t.task % 40 AS id, 'p' || (t.task // 40) AS prop, t.tool, t.pos, t.grp FROM tied t),
j AS (SELECT h.id, h.prop, h.tool, h.pos AS e, h.grp, g.pos AS p, count(*) OVER (PARTITION BY h.id, h.prop) AS n FROM truth h JOIN guessed g ON g.id = h.id AND g.tool = h.tool),
m AS (SELECT 'spearman' AS metric, CASE WHEN any_value(n) > 1 THEN 1 - 6 * sum((e - p) ** 2) / (any_value(n) * (any_value(n) ** 2 - 1)) END AS score FROM j GROUP BY id, prop
UNION ALL SELECT 'accuracy', (a.tool = b.tool)::INT::DOUBLE FROM truth a JOIN guessed b ON a.id = b.id AND a.pos = 0 AND b.pos = 0
UNION ALL SELECT 'kendall', coalesce(avg(CASE WHEN b.grp IS NULL THEN NULL WHEN a.p < b.p THEN 1.0 ELSE -1.0 END), 1.0) FROM j a LEFT JOIN j b ON a.id = b.id AND a.prop = b.prop AND a.grp < b.grp GROUP BY a.id, a.prop)"""


@query(f"WITH {_TOOLS}, {_TIES}, {_ROWS} SELECT metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(score) AS n FROM m GROUP BY metric")
def by_row_scores(spark, sf):
    """Rankings by given chances for ids of several rows, against the rankings with ties of each row."""
    labels = written(tool_labels(spark, sf))
    chances = L.tool_pairs(labels).select((F.col("task") % 40).alias("id"), "x", "y", F.round(F.col("ty") / (F.col("tx") + F.col("ty")), 6).alias("p")).where("id < 30")
    truth = R.with_ties(labels).select((F.col("task") % 40).alias("id"), F.concat(F.lit("p"), F.floor(F.col("task") / 40)).alias("prop"), "tool", "pos", "grp")
    return rounded(E.by_row_scores(chances, truth), "mean", "std")


@query(f"WITH {_BYRESULT}, points AS (SELECT tool, sum(n - pos - 1) AS points FROM (SELECT *, count(*) OVER (PARTITION BY task) AS n FROM byresult) GROUP BY tool) SELECT tool, points, row_number() OVER (ORDER BY points DESC, tool) - 1 AS pos FROM points")
def majority_by_result(spark, sf):
    return E.majority_by_result(tool_labels(spark, sf))


def event_features(spark, sf) -> DataFrame:
    """Users' event counts by kind, as logarithms, and their mean value, as a sparse matrix (row, col, cnt)."""
    e = table(spark, sf, "events")
    kinds = e.groupBy(F.col("user_id").alias("row"), (F.pmod(F.crc32("event_type"), F.lit(40)) + 1).cast("int").alias("col")).agg(F.log1p(F.count("*").cast("double")).alias("cnt"))
    return kinds.unionByName(e.groupBy(F.col("user_id").alias("row")).agg(F.lit(0).alias("col"), (F.avg("value") / 100).alias("cnt")))


@query()
def cv_logistic(spark, sf):
    """Logistic chances of each tool and pair, pairs weighed by the tools' chances, votes and metrics."""
    return E.cross_linear(tool_labels(spark, sf), event_features(spark, sf), 3, _FEW, grid=(0.1, 1.0))


@query()
def cv_linear(spark, sf):
    """Linear support-vector machines of each tool and pair in place of the chances."""
    return E.cross_linear(tool_labels(spark, sf), event_features(spark, sf), 3, _FEW, grid=(0.1, 1.0), loss=N.HINGE)


@query()
def selected_linear(spark, sf):
    """The linear machine of labelled documents on the words that mutual information keeps, its C by f1 over inner folds: its coefficients."""
    bags, classes = labelled_bags(spark, sf)
    kept = written(S.mutual_information(bags, classes, 500).select("label"))
    bags = written(bags.join(F.broadcast(kept), "label", "left_semi"))  # 500 labels
    index = written(B.dense_index(kept, "label"))
    features = bags.join(F.broadcast(index), "label").select(F.col("graph").alias("row"), F.col("idx").alias("col"), F.log1p("cnt").alias("cnt"))
    train = classes.select(F.lit("toxic").alias("x"), F.col("graph").alias("task"), F.when(F.col("cls") == 1, 1).otherwise(-1).alias("v"), F.lit(1.0).alias("weight"))
    models, _ = N.tuned(written(N.packed(features)), train, train.select("x", "task").limit(0), "x", size=500, grid=(0.01, 0.1), loss=N.HINGE)
    named = N.coefficients(models, "x", "c", "score").join(index.select(F.col("idx").alias("col"), "label"), "col", "left")
    return named.select("c", F.round("score", 6).alias("score"), F.coalesce("label", F.lit("")).alias("label"), F.round("coef", 4).alias("coef"))


@query()
def cv_selected(spark, sf):
    """Machines on the labels that selection keeps in each fold."""
    return E.cross_selected(tool_labels(spark, sf), event_bags(spark, sf), [lambda b: S.by_sum(b, 30), lambda b: S.by_coverage(b, 20)], 3, (1.0,), ["accuracy", "spearman"])


@query()
def setting_front(spark, sf):
    """Kernels as settings, and which of them no other beats in both metrics."""
    bags = written(event_bags(spark, sf))
    return E.cross_settings(tool_labels(spark, sf), {k: V.Kernel(bags, k) for k in ("linear", "jaccard")}, 3, (1.0,))


@query()
def two_tool_classes(spark, sf):
    """Which of two tools to take, by three machines."""
    return E.two_tool_classes(tool_labels(spark, sf), V.Kernel(event_bags(spark, sf)), "click", "view", 5, (1.0,))


@query()
def kernel_machine_rows(spark, sf):
    """Support tasks and coefficients of the machine of each pair over all tasks."""
    pairs = L.preferences(tool_labels(spark, sf)).where("v <> 0").select("task", "x", "y", "v")
    return V.fitted(pairs, V.Kernel(event_bags(spark, sf)), "x", "y", grid=(1.0,)).drop("slope", "shift")


@query(f"""WITH {_TOOLS}, {_FOLDS}, rate AS (SELECT f.fold, t.tool, avg((t.solve = 1)::INT::DOUBLE) AS rate FROM (SELECT DISTINCT fold FROM folds) f CROSS JOIN tools t JOIN folds o ON o.task = t.task WHERE o.fold <> f.fold GROUP BY ALL)
SELECT t.task, t.tool, row_number() OVER (PARTITION BY t.task ORDER BY (t.time < 400)::INT DESC, coalesce(rate, 0.0) DESC, t.tool) - 1 AS pos FROM tools t JOIN folds f ON f.task = t.task LEFT JOIN rate r ON r.fold = f.fold AND r.tool = t.tool""")
def quality_rank(spark, sf):
    labels = written(tool_labels(spark, sf))
    fold = written(E.folds(labels.select("task").distinct()))  # cv_quality has machines in place of the given times
    return E.quality_predicted(labels, labels.select("task", "tool", (F.col("time") < 400).cast("int").alias("p")), fold, 10)


@query(f"WITH {_INDEX}, rows AS (SELECT DISTINCT file AS task, prop FROM idx), t AS (SELECT task, row_number() OVER (ORDER BY md5(task), task) - 1 AS i FROM (SELECT DISTINCT task FROM rows WHERE prop = 'termination')) SELECT task, prop FROM rows WHERE task NOT IN (SELECT task FROM t WHERE i % 10 = 0)")
def overall_training(spark, sf):
    index = tool_runs(spark, sf).select(F.col("file").alias("task"), F.when(F.col("prop").contains("valid"), "valid-memsafety").otherwise(F.col("prop")).alias("prop")).distinct()
    test = E.folds(index.where("prop = 'termination'").select("task").distinct()).where("fold = 0")
    return E.overall_training(index, test)


@query("""WITH s AS (SELECT l_suppkey % 5 AS pair, l_linenumber AS c, l_returnflag AS h, avg(l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT pair, c, h, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(score, 9) DESC, c, h) AS r FROM (SELECT pair, c, CASE h WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS h, score FROM s)) WHERE r = 1""")
def grid_best(spark, sf):
    h = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    scores = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("pair"), F.col("l_linenumber").alias("c"), h.alias("h")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return rounded(E.grid_best(scores, "pair", settings=("c", "h")), "score")


# ---------------------------------------------------------------- composed kernels

_DOTS = "{0} AS (SELECT a.h, a.graph AS i, b.graph AS j, {1} AS v FROM lv a JOIN lv b ON a.h = b.h AND a.label = b.label AND a.graph <= b.graph GROUP BY ALL)"
_LVJ = f"{_LEVELS2.replace('SELECT 1, graph, substr(label, 1, 3), cnt FROM bags', 'SELECT 1, graph, substr(label, 1, 3), sum(cnt) FROM bags').replace(chr(39) + 'src1/en' + chr(39), chr(39) + 'src1/en' + chr(39) + ' GROUP BY ALL')}"


def _merged_levels(spark, sf) -> DataFrame:
    return _levels(spark, sf).groupBy("h", "graph", "label").agg(F.sum("cnt").alias("cnt"))


@query(f"WITH {_LVJ}, {_DOTS.format('d', 'sum(a.cnt * b.cnt)')}, s AS (SELECT i, j, sum(v) AS v FROM d GROUP BY ALL), o AS (SELECT i AS g, v FROM s WHERE i = j) SELECT s.i, s.j, round(s.v / sqrt(x.v * y.v), 6) AS v FROM s JOIN o x ON x.g = s.i JOIN o y ON y.g = s.j")
def gram_levels_normalized(spark, sf):
    return rounded(K.levels_gram(_merged_levels(spark, sf), "linear", 1), "v")


_JAC = f"sz AS (SELECT h, graph, sum(cnt) AS s FROM lv GROUP BY ALL), {_DOTS.format('sh', 'sum(least(a.cnt, b.cnt))')}, jc AS (SELECT sh.h, i, j, v / (x.s + y.s - v) AS v FROM sh JOIN sz x ON x.h = sh.h AND x.graph = i JOIN sz y ON y.h = sh.h AND y.graph = j)"


@query(f"WITH {_LVJ}, {_JAC}, s AS (SELECT i, j, sum(v) AS v FROM jc GROUP BY ALL), o AS (SELECT i AS g, v FROM s WHERE i = j) SELECT s.i, s.j, round(s.v / sqrt(x.v * y.v), 6) AS v FROM s JOIN o x ON x.g = s.i JOIN o y ON y.g = s.j")
def gram_custom_levels(spark, sf):
    return rounded(K.levels_gram(_merged_levels(spark, sf), "jaccard"), "v")


@query(f"WITH {_LVJ}, {_JAC} SELECT h, i, j, round(v, 9) AS v FROM jc WHERE i < j")
def level_sim_rows(spark, sf):
    return rounded(K.levels_similarity(_merged_levels(spark, sf)), "v", digits=9)


_DISTSQL = f"WITH {_BAGS}, dot AS (SELECT a.graph AS i, b.graph AS j, sum(a.cnt * b.cnt) AS v FROM bags a JOIN bags b ON a.label = b.label AND a.graph <= b.graph GROUP BY ALL), own AS (SELECT i AS graph, v AS s FROM dot WHERE i = j), dist AS (SELECT x.graph AS i, y.graph AS j, sqrt(greatest(x.s + y.s - 2 * coalesce(v, 0.0), 0.0)) AS v FROM own x JOIN own y ON x.graph <= y.graph LEFT JOIN dot ON dot.i = x.graph AND dot.j = y.graph)"


@query(f"{_DISTSQL} SELECT i, j, round((SELECT max(v) FROM dist) - v, 4) AS v FROM dist")
def gram_pairwise_distance(spark, sf):
    return rounded(K.pairwise(source_bags(spark, sf), K.distance, distance=True), "v", digits=4)


@query(f"WITH {_DOCS}, size AS (SELECT graph, sum(cnt) AS s FROM docs GROUP BY graph), shared AS (SELECT a.graph AS i, b.graph AS j, sum(least(a.cnt, b.cnt)) AS m FROM docs a JOIN docs b ON a.label = b.label AND a.graph < b.graph GROUP BY ALL) SELECT i, j, round(m / (x.s + y.s - m), 6) AS v FROM shared JOIN size x ON x.graph = i JOIN size y ON y.graph = j WHERE m / (x.s + y.s - m) >= 0.7")
def similar_documents(spark, sf):
    return rounded(K.similar(document_bags(spark, sf), 0.7), "v")


_CENTRE = "e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label AS id, d, avg(x) AS x FROM e GROUP BY ALL), p AS (SELECT a.id AS i, b.id AS j, sum(a.x * b.x) AS ab, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb FROM c a JOIN c b ON a.d = b.d AND a.id <= b.id GROUP BY ALL)"


def _centres(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    mean = e.groupBy("label", "d").agg(F.avg("x").alias("x"))
    return mean.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))


@query(f"WITH {_CENTRE} SELECT i, j, round(ab, 6) AS product, round(1 - sqrt(greatest(aa + bb - 2 * ab, 0.0)), 5) AS near, round(ab / sqrt(aa * bb), 6) AS cosine FROM p")
def dense_kernels(spark, sf):
    c = written(_centres(spark, sf))
    out = K.vector_gram(c).withColumnRenamed("v", "product")
    for metric, name in (("euclidean", "near"), ("cosine", "cosine")):
        out = out.join(K.vector_gram(c, metric=metric).withColumnRenamed("v", name), ["i", "j"])
    return out.select("i", "j", F.round("product", 6).alias("product"), F.round("near", 5).alias("near"), F.round("cosine", 6).alias("cosine"))


_SPLITSQL = f"WITH {_BAGS}, d AS (SELECT a.graph AS i, b.graph AS j, sum(a.cnt * b.cnt) AS v FROM bags a JOIN bags b ON a.label = b.label GROUP BY ALL), o AS (SELECT i AS g, v FROM d WHERE i = j), n AS (SELECT i, j, v / sqrt((SELECT v FROM o WHERE g = i) * (SELECT v FROM o WHERE g = j)) AS v FROM d)"


@query(f"{_SPLITSQL} SELECT 'train' AS part, i, j, round(v, 6) AS v FROM n WHERE i <= j AND i NOT LIKE '%/en' AND j NOT LIKE '%/en' UNION ALL SELECT 'test', i, j, round(v, 6) FROM n WHERE i LIKE '%/en' AND j NOT LIKE '%/en'")
def split_kernel(spark, sf):
    bags = written(source_bags(spark, sf))
    train, test = K.split_gram(bags, bags.where("graph like '%/en'").select("graph").distinct())
    return rounded(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))), "v")


# ---------------------------------------------------------------- selection over splits


@query(f"WITH {_BAGS}, fit AS (SELECT * FROM bags WHERE graph NOT LIKE '%/en'), df AS (SELECT label, count(*) AS df FROM fit GROUP BY label), n AS (SELECT count(DISTINCT graph) AS n FROM fit), w AS (SELECT graph, label, cnt * (ln((1 + n) / (1 + df)) + 1) AS v FROM bags JOIN df USING (label), n), s AS (SELECT graph, sqrt(sum(v * v)) AS s FROM w GROUP BY graph) SELECT graph, label, round(v / s, 6) AS v FROM w JOIN s USING (graph)")
def tfidf_split(spark, sf):
    bags = source_bags(spark, sf)
    return rounded(S.tfidf(bags, bags.where("graph not like '%/en'").select("graph").distinct()), "v")


@query(f"WITH {_BAGS}, train AS (SELECT * FROM bags WHERE graph NOT LIKE '%/en'), a AS (SELECT label FROM train GROUP BY label ORDER BY sum(cnt) DESC, label LIMIT 500), b AS (SELECT label FROM train WHERE label IN (SELECT label FROM a) GROUP BY label ORDER BY count(DISTINCT graph) DESC, label LIMIT 100) SELECT graph, label, cnt FROM bags WHERE graph LIKE '%/en' AND label IN (SELECT label FROM b)")
def split_transformed(spark, sf):
    bags = written(source_bags(spark, sf))
    test = bags.where("graph like '%/en'").select("graph").distinct()
    return S.split_transformed(bags, test, [lambda b: S.by_sum(b, 500), lambda b: S.by_coverage(b, 100)])[1].select("graph", "label", "cnt")


_HSIC = f"""WITH {_DOCS}, pat AS (SELECT doc_id AS graph, quality, toxic FROM labels), n AS (SELECT count(*) AS n FROM pat), held AS (SELECT label, quality, toxic, count(*) AS c FROM docs JOIN pat USING (graph) GROUP BY ALL)"""


@query(f"""{_HSIC}, s AS (SELECT a.label, sum(a.c * b.c * ((a.quality = b.quality)::INT + (a.toxic = b.toxic)::INT) / 2) AS s FROM held a JOIN held b ON a.label = b.label GROUP BY a.label), d AS (SELECT label, sum(c) AS df FROM held GROUP BY label)
SELECT label, round(s / n / n + df * ((1 - 1 / n) ** 2 - (1 / n) ** 2), 6) AS score FROM s JOIN d USING (label), n ORDER BY score DESC, label LIMIT 1000""")
def select_hsic(spark, sf):
    bags, _ = labelled_bags(spark, sf)
    return S.hsic(bags, table(spark, sf, "labels").select(F.col("doc_id").alias("graph"), "quality", "toxic"), ["quality", "toxic"])


@query(f"""{_HSIC}, z AS (SELECT quality, toxic, count(*) AS size FROM pat GROUP BY ALL), d AS (SELECT label, sum(c) AS df FROM held GROUP BY label),
a AS (SELECT d.label, z.quality, z.toxic, coalesce(c, 0) - df * size / n AS c FROM d CROSS JOIN z CROSS JOIN n LEFT JOIN held h ON h.label = d.label AND h.quality = z.quality AND h.toxic = z.toxic)
SELECT x.label, round(sum(x.c * y.c * ((x.quality = y.quality)::INT + (x.toxic = y.toxic)::INT) / 2), 6) AS score FROM a x JOIN a y ON x.label = y.label GROUP BY x.label ORDER BY score DESC, label LIMIT 1000""")
def select_hsic_centred(spark, sf):
    bags, _ = labelled_bags(spark, sf)
    return S.hsic(bags, table(spark, sf, "labels").select(F.col("doc_id").alias("graph"), "quality", "toxic"), ["quality", "toxic"], centre=True)


def _poly(coefficients, r: str) -> str:
    out = "0.0::DOUBLE"
    for c in coefficients:
        out = f"({out} * {r} + {c!r}::DOUBLE)"
    return out


def _quantile(p: str) -> str:
    """The SQL of selection.normal_quantile."""
    q = f"({p} - 0.5::DOUBLE)"
    near, far = f"(0.180625::DOUBLE - {q} * {q})", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6::DOUBLE)"
    middle = f"{q} * {_poly(S.CENTRE[0], near)} / {_poly(S.CENTRE[1], near)}"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {middle} ELSE sign({q}) * {_poly(S.TAIL[0], far)} / {_poly(S.TAIL[1], far)} END)"


@query(f"""WITH {_DOCS}, {_CLASSES}, o AS (SELECT label, sum((cls = 1)::INT) AS tp, sum((cls = 0)::INT) AS fp FROM kept JOIN classes USING (graph) GROUP BY label),
r AS (SELECT label, greatest(least(tp / (SELECT count(*) FROM classes WHERE cls = 1)::DOUBLE, 0.9995::DOUBLE), 0.0005::DOUBLE) AS t, greatest(least(fp / (SELECT count(*) FROM classes WHERE cls = 0)::DOUBLE, 0.9995::DOUBLE), 0.0005::DOUBLE) AS f FROM o)
SELECT label, round(abs({_quantile('t')} - {_quantile('f')}), 6) AS score FROM r ORDER BY score DESC, label LIMIT 10000""")
def select_bns(spark, sf):
    return S.bns(*labelled_bags(spark, sf))


@query(f"WITH {_LVJ}, sm AS (SELECT graph, label, sum(cnt) AS cnt FROM lv GROUP BY ALL), voc AS (SELECT label FROM (SELECT label, count(DISTINCT graph) AS df FROM sm GROUP BY label) ORDER BY df DESC, label LIMIT 200), bags2 AS (SELECT * FROM sm WHERE label IN (SELECT label FROM voc)), df AS (SELECT label, count(*) AS df FROM bags2 GROUP BY label), n AS (SELECT count(DISTINCT graph) AS n FROM bags2), w AS (SELECT graph, label, (1 + ln(cnt)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM bags2 JOIN df USING (label), n), s AS (SELECT graph, sqrt(sum(v * v)) AS s FROM w GROUP BY graph) SELECT graph, label, round(v / s, 6) AS v FROM w JOIN s USING (graph)")
def prepared_features(spark, sf):
    levels = written(_merged_levels(spark, sf))
    frequency = levels.select("graph", "label").distinct().groupBy("label").agg(F.count("*").alias("df"))
    return rounded(S.prepared(levels, frequency.orderBy(F.desc("df"), "label").limit(200), 1), "v")


# ---------------------------------------------------------------- reductions


@query(f"WITH {_BAGS}, d AS (SELECT a.graph AS i, b.graph AS j, sum(a.cnt * b.cnt) AS v FROM bags a JOIN bags b ON a.label = b.label GROUP BY ALL), o AS (SELECT i AS g, v FROM d WHERE i = j), n AS (SELECT d.i, d.j, d.v / sqrt(x.v * y.v) AS v FROM d JOIN o x ON x.g = d.i JOIN o y ON y.g = d.j), k AS (SELECT x.g AS i, y.g AS j, coalesce(n.v, 0.0) AS v FROM o x CROSS JOIN o y LEFT JOIN n ON n.i = x.g AND n.j = y.g), r AS (SELECT i, avg(v) AS m FROM k GROUP BY i) SELECT k.i, k.j, round(k.v - x.m - y.m + (SELECT avg(k2.v) FROM k k2), 6) AS v FROM k JOIN r x ON x.i = k.i JOIN r y ON y.i = k.j")
def centred_gram(spark, sf):
    return rounded(D.centred(_whole(spark, sf)), "v")


def _whole(spark, sf) -> DataFrame:
    """The normalised Gram of sources by language, whole."""
    return written(D.whole(E.normalised_gram(source_bags(spark, sf))))


@query()
def kernel_pca(spark, sf):
    return D.kernel_components(_whole(spark, sf), 5)


@query()
def truncated_svd(spark, sf):
    rows = source_bags(spark, sf).select(F.col("graph").alias("row"), F.col("label").alias("col"), "cnt")
    return D.singular_rows(rows, 5)[1]


@query(f"WITH {_BAGS}, d AS (SELECT a.graph AS i, b.graph AS j, sum(a.cnt * b.cnt) AS v FROM bags a JOIN bags b ON a.label = b.label GROUP BY ALL), o AS (SELECT i AS g, v FROM d WHERE i = j) SELECT x.g AS i, y.g AS j, round(coalesce(d.v, 0.0) / sqrt(x.v * y.v), 4) AS v FROM o x JOIN o y ON x.g <= y.g LEFT JOIN d ON d.i = x.g AND d.j = y.g")
def gram_reduced(spark, sf):
    """The Gram on as many reduced features as there are graphs, which is the Gram on all features."""
    rows = source_bags(spark, sf).select(F.col("graph").alias("row"), F.col("label").alias("col"), "cnt")
    return rounded(K.reduced_gram(D.singular_rows(rows, rows.select("row").distinct().count())[1]), "v", digits=4)


@query()
def multidimensional_scaling(spark, sf):
    return D.scaled(_whole(spark, sf).withColumn("v", 1 - F.col("v")))[1]


@query()
def best_linear_svc(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("task"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    return C.best_linear_svc(v)


@query("SELECT prop, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS least, max(v) AS greatest, count(*) AS n FROM (SELECT n_chars::DOUBLE AS v, unnest(list_distinct(['overall', coalesce(source, '-'), coalesce(lang, '-')])) AS prop FROM documents) GROUP BY prop")
def stats_by_property(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("v"), F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))).alias("props"))
    return rounded(M.by_property(docs, "v"), "mean", "std", digits=4)
