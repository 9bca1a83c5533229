"""Folds, metrics by name, and the evaluation of predicted rankings under cross-validation.

Labels are (task, tool, solve, time), rankings (task, tool, pos), folds (task, fold). Folds are drawn by a digest of the
task, so reruns agree, and differ in size by one at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators import kernel_machines as S
from sylva.operators import kernels as K
from sylva.operators import labels as L
from sylva.operators import metrics as M
from sylva.operators import ranking as R
from sylva.operators import sparse_learners as N
from sylva.operators.bags import dense_index
from sylva.operators.selection import split_transformed
from sylva.session import written


def drawn_order(tasks: DataFrame) -> DataFrame:
    """(task, idx): tasks in the order of their digests."""
    draw = F.struct(F.md5(F.col("task").cast("string").cast("binary")).alias("digest"), F.col("task").alias("task"))
    return dense_index(tasks.select(draw.alias("drawn")), "drawn").select("drawn.task", "idx")


def folds(tasks: DataFrame, k: int = 10) -> DataFrame:
    return drawn_order(tasks).select("task", F.pmod("idx", F.lit(k)).cast("int").alias("fold"))


def split(tasks: DataFrame, share: float = 0.33) -> DataFrame:
    """(task, test): the first share of the drawn order, rounded up, is for tests."""
    order = written(drawn_order(tasks))
    n = order.agg(F.count("*").alias("n"))  # one row
    return order.join(F.broadcast(n)).select("task", (F.col("idx") < F.ceil(F.lit(share) * F.col("n"))).alias("test"))


# ---------------------------------------------------------------- metrics by name


class Ranked:
    """Labels, their rankings without and with ties, and a predicted ranking."""

    def __init__(self, labels: DataFrame, predicted: DataFrame, ranked: DataFrame | None = None, tied: DataFrame | None = None, graph_time: float = 0.0):
        self.labels, self.predicted = labels, predicted
        self.ranked = R.full(labels) if ranked is None else ranked
        self.tied = R.with_ties(labels) if tied is None else tied
        self.graph_time = graph_time

    @property
    def top(self) -> DataFrame:
        return M.top_labels(self.labels, self.predicted)


def _score(df: DataFrame, score: Column) -> DataFrame:
    return df.select("task", score.alias("score"))


SCORES: dict[str, Callable[[Ranked], DataFrame]] = {
    "accuracy": lambda r: M.accuracy(r.ranked, r.predicted),
    "spearman": lambda r: M.spearman(r.ranked, r.predicted),
    "spearman_lambda": lambda r: _score(M.spearman(r.ranked, r.predicted), (F.round("score", 9) >= 0.5).cast("int")),
    "kendall": lambda r: M.kendall(r.tied, r.predicted),
    "inv_kendall": lambda r: _score(M.kendall(r.tied, r.predicted), 1 - F.col("score")),
    "svcomp": lambda r: M.competition(r.top),
    "correct": lambda r: M.correct(r.top),
    "correct_count": lambda r: _score(r.top, (F.col("solve") == 1).cast("int")),
    "time": lambda r: M.time_share(r.top, r.graph_time),
    "time_count": lambda r: _score(M.time_share(r.top, r.graph_time), (F.col("score") < 1).cast("int")),
    "inv_time": lambda r: _score(M.time_share(r.top, r.graph_time), 1 - F.col("score")),
    "fail_fast": lambda r: M.fail_fast(r.labels, r.predicted),
}


def scored(ranked: Ranked, names: list[str] | None = None) -> DataFrame:
    """(task, metric, score) of the metrics by name, all if none are given."""
    out = None
    for name in names or list(SCORES):
        if name not in SCORES:
            raise ValueError(f"unknown metric {name}; there are {', '.join(SCORES)}")
        part = SCORES[name](ranked).select("task", F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def over_folds(scores: DataFrame, fold: DataFrame) -> DataFrame:
    """(metric, mean, std, n) over folds of each fold's mean."""
    each = scores.join(fold, "task").groupBy("metric", "fold").agg(F.avg("score").alias("score"))
    return each.groupBy("metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n"))


# ---------------------------------------------------------------- drivers


def majority_predicted(ranked: DataFrame, fold: DataFrame) -> DataFrame:
    """Each task's tools in the order of the points that they have in all other folds."""
    n = F.count("*").over(Window.partitionBy("task"))
    points = ranked.select("task", "tool", (n - F.col("pos") - 1).alias("points")).join(fold, "task")
    by_fold = points.groupBy("fold", "tool").agg(F.sum("points").alias("own"))
    rest = by_fold.join(by_fold.groupBy("tool").agg(F.sum("own").alias("all")), "tool")
    order = fold.select("fold").distinct().join(F.broadcast(rest.groupBy("tool").agg(F.max("all").alias("all"))))  # folds by tools
    order = order.join(by_fold, ["fold", "tool"], "left").select("fold", "tool", (F.col("all") - F.coalesce("own", F.lit(0))).alias("left"))
    mine = ranked.select("task", "tool").join(fold, "task").join(F.broadcast(order), ["fold", "tool"])
    return mine.withColumn("pos", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("left"), "tool")) - 1).select("task", "tool", "pos")


def cross_majority(labels: DataFrame, k: int = 10, names: list[str] | None = None) -> DataFrame:
    """The order by points of the training folds as every test task's prediction: (metric, mean, std, n)."""
    labels = written(labels)
    ranked, fold = written(R.full(labels)), written(folds(labels.select("task").distinct(), k))
    guess = written(majority_predicted(ranked, fold))
    return over_folds(scored(Ranked(labels, guess, ranked), names), fold)


def _outside(rows: DataFrame, fold: DataFrame, k: int) -> DataFrame:
    """rows (task, ...) once for each fold that their task is not in, with that fold."""
    placed = rows.join(fold.withColumnRenamed("fold", "own"), "task")
    return placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("own <> fold").drop("own")


def pair_predicted(labels: DataFrame, gram: DataFrame, fold: DataFrame, k: int, grid: tuple[float, ...] = S.GRID, chances: bool = False, **inner) -> tuple[DataFrame, DataFrame]:
    """Machines of each pair of tools and fold, and for each task and pair (task, x, y, p) what they decide: 1 or 0, or a chance. inner: metric and inner folds by which C is chosen."""
    pairs = L.preferences(labels)
    machines = written(S.fitted(_outside(pairs.where("v <> 0").select("task", "x", "y", "v"), fold, k), gram, "x", "y", "fold", grid=grid, chances=chances, share=("fold",), **inner))
    asked = pairs.join(fold, "task").select("x", "y", "fold", "task")
    out = S.decided(machines, gram, asked, "x", "y", "fold")
    return machines, out.select("task", "x", "y", (F.col("p") if chances else (F.col("decision") > 0).cast("double")).alias("p"))


def solve_and_pair_rows(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What machines of tools (x = y: is the task solved) and of pairs (x < y: is x faster) learn: (task, x, y, v); tasks that both tools time out on teach a pair nothing."""
    solve = labels.select("task", F.col("tool").alias("x"), F.col("tool").alias("y"), F.when(F.col("solve") == 1, 1).otherwise(-1).alias("v"))
    pair = L.tool_pairs(labels).where((F.col("tx") < L.CEILING) | (F.col("ty") < L.CEILING))
    return solve, pair.select("task", "x", "y", F.when(L.faster(F.col("tx"), F.col("ty")), 1).otherwise(-1).alias("v"))


def combined(told: DataFrame, *keys: str) -> DataFrame:
    """Votes (keys, x, y, p) of pairs x < y from what is told of tools (keys, x = y, p) and of pairs: x if it alone solves the task, else who is faster."""
    keys = list(keys)
    own = lambda t, as_: told.where("x = y").select(*keys, F.col("x").alias(t), F.col("p").alias(as_))
    j = told.where("x < y").join(own("x", "px"), [*keys, "x"]).join(own("y", "py"), [*keys, "y"])
    both = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return j.select(*keys, "x", "y", (F.col("px") * (1 - F.col("py")) + both * F.col("p")).alias("p"))


def hyper_machines(labels: DataFrame, gram: DataFrame, fold: DataFrame, k: int, grid: tuple[float, ...] = S.GRID, chances: bool = False, **inner) -> tuple[DataFrame, DataFrame]:
    """Machines of each tool and each pair outside each fold, and votes (task, x, y, p) from both for the tasks of the fold."""
    solve, quick = solve_and_pair_rows(labels)
    machines = written(S.fitted(_outside(solve.unionByName(quick), fold, k), gram, "x", "y", "fold", grid=grid, chances=chances, share=("fold",), **inner))
    asked = solve.select("task", "x", "y").unionByName(L.tool_pairs(labels).select("task", "x", "y")).join(fold, "task")
    p = F.col("p") if chances else (F.col("decision") > 0).cast("double")
    told = written(S.decided(machines, gram, asked, "x", "y", "fold").select("task", "x", "y", p.alias("p")))
    return machines, combined(told, "task")


def hyper_predicted(labels: DataFrame, gram: DataFrame, fold: DataFrame, k: int, grid: tuple[float, ...] = S.GRID, chances: bool = False, **inner) -> DataFrame:
    """The votes of hyper_machines."""
    return hyper_machines(labels, gram, fold, k, grid, chances, **inner)[1]


class Crossed:
    """Machines outside each task's fold and what follows from them: votes, rankings, and scores by metric, over folds and by fold."""

    def __init__(self, labels: DataFrame, gram: DataFrame, k: int = 10, how: str = "pairs", grid: tuple[float, ...] = S.GRID, chances: bool = False, names: list[str] | None = None, **inner):
        self.labels, self.gram, self.k, self.how = written(labels), S.kept(gram), k, how
        self.fold = written(folds(self.labels.select("task").distinct(), k))
        by = {"pairs": pair_predicted, "hyper": hyper_machines}[how]
        self.machines, votes = by(self.labels, self.gram, self.fold, k, grid, chances, **inner)
        self.votes = written(votes)
        self.guess = written(R.from_pairs(self.votes, self.labels.select("task", "tool")).select("task", "tool", "pos"))
        self.scores = written(scored(Ranked(self.labels, self.guess), names))

    def summary(self) -> DataFrame:
        return over_folds(self.scores, self.fold)

    def best_fold(self, metric: str) -> DataFrame:
        """(fold, x, y, c, score): the C of each machine of the fold with the best mean of a metric, the first of equals; score is its mean over the inner folds."""
        each = self.scores.where(F.col("metric") == metric).join(self.fold, "task").groupBy("fold").agg(F.round(F.avg("score"), 12).alias("mean"))
        best = each.agg(F.max(F.struct("mean", (-F.col("fold")).alias("first"))).alias("b")).select((-F.col("b.first")).alias("fold"))  # a row for each fold
        return self.machines.join(F.broadcast(best), "fold").select("fold", "x", "y", "c", "score").distinct()

    def pair_metrics(self) -> DataFrame:
        """(x, y, metric, mean, std, n) over folds: accuracy, precision, recall and f1 of each pair's votes against who is preferred."""
        truth = L.preferences(self.labels).where("v <> 0")
        decided = self.votes.join(truth, ["task", "x", "y"]).join(self.fold, "task").withColumn("decision", F.col("p") - 0.5)
        each = N.pair_metrics(decided, "x", "y", "fold").unpivot(["x", "y", "fold"], ["accuracy", "precision", "recall", "f1"], "metric", "score")
        return each.groupBy("x", "y", "metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n"))


def cross_pairwise(labels: DataFrame, gram: DataFrame, k: int = 10, how: str = "pairs", grid: tuple[float, ...] = S.GRID, chances: bool = False, names: list[str] | None = None, **inner) -> DataFrame:
    """Machines on the Gram for each pair (how "pairs") or tool and pair ("hyper"), C chosen within the training folds, rankings
    by votes, and (metric, mean, std, n) over the folds."""
    return Crossed(labels, gram, k, how, grid, chances, names, **inner).summary()


def in_sample(labels: DataFrame, gram: DataFrame, grid: tuple[float, ...] = S.GRID, names: list[str] | None = None, **inner) -> tuple[DataFrame, DataFrame]:
    """Machines of each pair over all tasks, their coefficients (x, y, c, task, coef, offset), and the scores (metric, mean, n) of the rankings that they give these very tasks."""
    labels, gram = written(labels), S.kept(gram)
    pairs = L.preferences(labels)
    machines = written(S.fitted(pairs.where("v <> 0").select("task", "x", "y", "v"), gram, "x", "y", grid=grid, **inner))
    told = S.decided(machines, gram, pairs.select("x", "y", "task"), "x", "y")
    votes = told.select("task", "x", "y", (F.col("decision") > 0).cast("double").alias("p"))
    guess = written(R.from_pairs(votes, labels.select("task", "tool")).select("task", "tool", "pos"))
    scores = scored(Ranked(labels, guess), names).groupBy("metric").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    return machines.select("x", "y", "c", "task", "coef", "offset"), scores


def cross_quality(labels: DataFrame, gram: DataFrame, k: int = 10, grid: tuple[float, ...] = S.GRID, names: list[str] | None = None, **inner) -> DataFrame:
    """Rankings by a machine for each tool (does it solve the task), ties by the tool's share of solved tasks outside the fold: (metric, mean, std, n)."""
    labels, gram = written(labels), S.kept(gram)
    fold = written(folds(labels.select("task").distinct(), k))
    guess = written(quality_predicted(labels, solved_predicted(labels, gram, fold, k, grid, **inner), fold, k))
    return over_folds(scored(Ranked(labels, guess), names), fold)


def solved_predicted(labels: DataFrame, gram: DataFrame, fold: DataFrame, k: int, grid: tuple[float, ...] = S.GRID, **inner) -> DataFrame:
    """(task, tool, p): 1 if a machine that learned outside the task's fold says that the tool solves it, else 0."""
    solve = solve_and_pair_rows(labels)[0].select("task", F.col("x").alias("tool"), "v")
    machines = written(S.fitted(_outside(solve, fold, k), gram, "tool", "fold", grid=grid, share=("fold",), **inner))
    told = S.decided(machines, gram, solve.select("task", "tool").join(fold, "task"), "tool", "fold")
    return told.select("task", "tool", (F.col("decision") > 0).cast("int").alias("p"))


def quality_predicted(labels: DataFrame, solved: DataFrame, fold: DataFrame, k: int) -> DataFrame:
    """Rankings by predicted solving (task, tool, p), ties by the tool's share of solved training tasks, the greater first."""
    rate = _outside(labels.select("task", "tool", "solve"), fold, k).groupBy("fold", "tool").agg(F.avg((F.col("solve") == 1).cast("double")).alias("rate"))
    rows = solved.join(fold, "task").join(F.broadcast(rate), ["fold", "tool"], "left")  # folds by tools
    order = Window.partitionBy("task").orderBy(F.desc("p"), F.desc(F.coalesce("rate", F.lit(0.0))), "tool")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("task", "tool", "pos")


def overall_training(rows: DataFrame, test: DataFrame) -> DataFrame:
    """Rows (task, prop) of all properties whose task is in no test fold of any property."""
    return rows.join(test.select("task").distinct(), "task", "left_anti")


def cross_overall(labels: DataFrame, tasks: DataFrame, gram: DataFrame, k: int = 10, grid: tuple[float, ...] = S.GRID, names: list[str] | None = None, **inner) -> DataFrame:
    """Machines of each pair trained on all properties and tested on one: (prop, metric, mean, std, n).

    tasks are (task, file, prop): a file is a task of its own in each property. A property's files are dealt into folds; what is
    learned for a fold is all tasks, of any property, whose file is not in it.
    """
    labels, gram, tasks = written(labels), S.kept(gram), written(tasks)
    fold = None
    for prop in [r.prop for r in tasks.select("prop").distinct().orderBy("prop").collect()]:  # few properties
        part = folds(tasks.where(F.col("prop") == prop).select(F.col("file").alias("task")).distinct(), k).select(F.lit(prop).alias("prop"), F.col("task").alias("file"), "fold")
        fold = part if fold is None else fold.unionByName(part)
    fold = written(fold)
    pairs = L.preferences(labels).join(tasks, "task")
    every = fold.select("prop", "fold").distinct()
    here = fold.select("prop", F.col("fold").alias("f"), "file")
    train = pairs.where("v <> 0").select("task", "file", "x", "y", "v").crossJoin(F.broadcast(every))  # properties by folds
    train = train.join(here.withColumnRenamed("f", "fold"), ["prop", "fold", "file"], "left_anti")
    machines = written(S.fitted(train, gram, "x", "y", "prop", "fold", grid=grid, share=("prop", "fold"), **inner))
    test = tasks.join(fold, ["prop", "file"])
    told = S.decided(machines, gram, pairs.select("task", "x", "y").join(test.select("task", "prop", "fold"), "task"), "x", "y", "prop", "fold")
    votes = written(told.select("task", "x", "y", (F.col("decision") > 0).cast("double").alias("p")))
    mine = written(labels.join(test.select("task"), "task", "left_semi"))
    guess = written(R.from_pairs(votes, mine.select("task", "tool")).select("task", "tool", "pos"))
    each = scored(Ranked(mine, guess), names).join(test.select("task", "prop", "fold"), "task").groupBy("prop", "metric", "fold").agg(F.avg("score").alias("score"))
    return each.groupBy("prop", "metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n"))


def by_row_scores(chances: DataFrame, expected: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(metric, mean, std, n) of rankings by chances against the expected ones of each property of a test id.

    chances are (id, x, y, p), one ranking for each id however often it is asked for; expected are (id, prop, tool, pos, grp), ties in one grp.
    An id that is not ranked, and a property without a ranking, are passed over.
    """
    once = chances.groupBy("id", "x", "y").agg(F.max("p").alias("p")).withColumnRenamed("id", "task")
    tools = once.select("task", F.col("x").alias("tool")).union(once.select("task", "y")).distinct()
    guess = written(R.from_pairs(once, tools).select("task", "tool", "pos"))
    row = F.struct("id", "prop")
    truth = written(expected.where(F.col("tool").isNotNull()).withColumn("task", row).join(guess.select(F.col("task").alias("id")).distinct(), "id", "left_semi"))
    told = written(truth.select("task", "id").distinct().join(guess.withColumnRenamed("task", "id"), "id").select("task", "tool", "pos"))
    ranked = Ranked(None, told, truth.select("task", "tool", "pos"), truth.select("task", "tool", "grp"))
    scores = scored(ranked, names or ["accuracy", "spearman", "kendall"])
    return scores.groupBy("metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n"))


def majority_by_result(results: DataFrame) -> DataFrame:
    """The tools of all tasks in the order of the points that rankings by result give them."""
    return R.borda(R.by_result(results))


def grid_best(scores: DataFrame, *keys: str, settings: tuple[str, ...] = ("c",)) -> DataFrame:
    """For each key the settings of the best mean score; of equal ones the least."""
    means = scores.groupBy(*keys, *settings).agg(F.avg("score").alias("score"))
    least = F.struct(F.col("score").alias("score"), *[(-F.col(s)).alias(s) for s in settings])
    best = means.groupBy(*keys).agg(F.max(least).alias("best"))
    return best.select(*keys, *[(-F.col(f"best.{s}")).alias(s) for s in settings], F.col("best.score").alias("score"))


def normalised_gram(bags: DataFrame, kernel: str = "linear") -> DataFrame:
    return K.normalized(K.KERNELS[kernel](bags))


def linear_votes(
    labels: DataFrame, features: DataFrame, fold: DataFrame, k: int, grid: tuple[float, ...] = N.GRID, inner: int = 3, metric: str = "f1", loss: N.Loss = N.LOGISTIC
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linear models of each tool (does it solve the task) and each pair (is x faster) outside each fold, on sparse features (row, col, cnt).

    Gives both kinds of models and the votes (task, x, y, p) of each task's own fold. C is chosen over inner folds. By
    logistic loss votes are chances, and a pair learns from a task as much as its two tools are given the same chance
    there: px * py + (1 - px) * (1 - py); by hinge loss votes are classes, and all tasks weigh alike.
    """
    rows = written(N.packed(features))
    size = (features.agg(F.max("col")).first()[0] or 0) + 1
    solve = labels.select("task", F.col("tool").alias("x"), F.when(F.col("solve") == 1, 1).otherwise(-1).alias("v"))
    every = solve.select("x", "task").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    tools, told = N.tuned(rows, _outside(solve, fold, k).withColumn("weight", F.lit(1.0)), every, "x", "fold", size=size, inner=inner, grid=grid, metric=metric, loss=loss)
    chance = 1 / (1 + F.exp(-F.col("decision"))) if loss.name == "logistic" else (F.col("decision") > 0).cast("double")
    told = written(told.select("x", "fold", "task", chance.alias("p")))
    pair = L.tool_pairs(labels)
    quick = pair.where((F.col("tx") < L.CEILING) | (F.col("ty") < L.CEILING)).select("task", "x", "y", F.when(L.faster(F.col("tx"), F.col("ty")), 1).otherwise(-1).alias("v"))
    side = lambda tool, as_: told.select(F.col("x").alias(tool), "fold", "task", F.col("p").alias(as_))
    alike = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    train = _outside(quick, fold, k).join(side("x", "px"), ["x", "fold", "task"]).join(side("y", "py"), ["y", "fold", "task"])
    train = train.withColumn("weight", alike if loss.name == "logistic" else F.lit(1.0))
    here = pair.select("task", "x", "y").join(fold, "task")
    pairs, said = N.tuned(rows, train, here, "x", "y", "fold", size=size, inner=inner, grid=grid, metric=metric, loss=loss)
    voted = here.join(said.withColumn("p", chance), ["x", "y", "fold", "task"]).join(side("x", "px"), ["x", "fold", "task"]).join(side("y", "py"), ["y", "fold", "task"])
    return tools, pairs, voted.select("task", "x", "y", (F.col("px") * (1 - F.col("py")) + alike * F.col("p")).alias("p"))


def cross_linear(labels: DataFrame, features: DataFrame, k: int = 10, names: list[str] | None = None, **how) -> DataFrame:
    """Rankings by the votes of linear models of tools and pairs, learned outside each task's fold: (metric, mean, std, n)."""
    labels = written(labels)
    fold = written(folds(labels.select("task").distinct(), k))
    votes = linear_votes(labels, features, fold, k, **how)[2]
    guess = written(R.from_pairs(votes, labels.select("task", "tool")).select("task", "tool", "pos"))
    return over_folds(scored(Ranked(labels, guess), names), fold)


def cross_selected(labels: DataFrame, bags: DataFrame, steps: list, k: int = 10, grid: tuple[float, ...] = S.GRID, names: list[str] | None = None) -> DataFrame:
    """Machines on the labels that selection steps keep of each fold's training bags, votes as by hyper_predicted: (metric, mean, std, n)."""
    labels, bags = written(labels), written(bags)
    fold = written(folds(labels.select("task").distinct(), k))
    votes = None
    for f in range(k):
        test = fold.where(F.col("fold") == f).select(F.col("task").alias("graph"))
        train, held = split_transformed(bags, test, steps)
        own = fold.withColumn("fold", F.when(F.col("fold") == f, 0).otherwise(1))  # this fold against the rest
        part = hyper_predicted(labels, S.Kernel(train.unionByName(held)), own, 1, grid)
        part = part.join(test.withColumnRenamed("graph", "task"), "task", "left_semi")
        votes = part if votes is None else votes.unionByName(part)
    guess = written(R.from_pairs(votes, labels.select("task", "tool")).select("task", "tool", "pos"))
    return over_folds(scored(Ranked(labels, guess), names), fold)


def cross_settings(labels: DataFrame, grams: dict[str, DataFrame], k: int = 10, grid: tuple[float, ...] = S.GRID, names: tuple[str, ...] = ("spearman", "correct"), how: str = "pairs") -> DataFrame:
    """(setting, and a column for each metric, front): each Gram's mean scores, and whether no other setting is at least as good in all."""
    out = None
    for name, gram in grams.items():
        part = cross_pairwise(labels, gram, k, how, grid, names=list(names)).select(F.lit(name).alias("setting"), "metric", "mean")
        out = part if out is None else out.unionByName(part)
    return fronted(out, names)


def fronted(means: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(setting, a column for each metric, front) of (setting, metric, mean)."""
    table = written(means.groupBy("setting").pivot("metric", list(names)).agg(F.first("mean")))
    best = R.pareto(table, list(names), "setting").select("setting", F.lit(True).alias("front"))
    return table.join(best, "setting", "left").withColumn("front", F.coalesce("front", F.lit(False)))


def cross_front(
    labels: DataFrame, grams: dict[str, DataFrame], k: int = 5, inner: int = 3, grid: tuple[float, ...] = S.GRID, names: tuple[str, ...] = ("spearman", "correct"), how: str = "pairs"
) -> DataFrame:
    """(fold, setting, and a column for each metric): for each fold the settings that no other beats within its training tasks, refitted on these and scored on the fold.

    Within the training tasks each setting is scored over inner folds; only those on the front are fitted again.
    """
    labels = written(labels)
    grams = {name: S.kept(gram) for name, gram in grams.items()}
    fold = written(folds(labels.select("task").distinct(), k))
    out = None
    for f in range(k):
        held = fold.where(F.col("fold") == f).select("task")
        train = written(labels.join(held, "task", "left_anti"))
        front = cross_settings(train, {name: _among(gram, held) for name, gram in grams.items()}, inner, grid, names, how).where("front")
        for r in front.select("setting").orderBy("setting").collect():  # settings
            own = fold.withColumn("fold", F.when(F.col("fold") == f, 0).otherwise(1))  # this fold against the rest
            votes = (pair_predicted(labels, grams[r.setting], own, 1, grid)[1] if how == "pairs" else hyper_predicted(labels, grams[r.setting], own, 1, grid)).join(held, "task", "left_semi")
            mine = written(labels.join(held, "task", "left_semi"))
            guess = written(R.from_pairs(votes, mine.select("task", "tool")).select("task", "tool", "pos"))
            part = scored(Ranked(mine, guess), list(names)).groupBy("metric").agg(F.avg("score").alias("mean")).select(F.lit(f).alias("fold"), F.lit(r.setting).alias("setting"), "metric", "mean")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("fold", "setting").pivot("metric", list(names)).agg(F.first("mean"))


def _among(gram: DataFrame, held: DataFrame) -> DataFrame:
    """The Gram without the tasks held; of a Kernel only those that are asked for are made."""
    if isinstance(gram, S.Kernel):
        return gram
    gone = lambda name: held.select(F.col("task").alias(name))
    return gram.join(gone("i"), "i", "left_anti").join(gone("j"), "j", "left_anti")


def two_tools(labels: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Labels of tasks that have both tools, and (task, expected): the one that alone solves the task, else the faster."""
    two = written(labels.where(F.col("tool").isin(x, y)))
    two = written(two.join(two.groupBy("task").agg(F.count("*").alias("n")).where("n = 2").select("task"), "task", "left_semi"))
    first = (F.col("sx") == 1) & (F.col("sy") != 1) | ((F.col("sx") == 1) == (F.col("sy") == 1)) & (F.col("tx") < F.col("ty"))
    return two, L.tool_pairs(two).select("task", F.when(first, F.col("x")).otherwise(F.col("y")).alias("expected"))


def joint_grid(
    labels: DataFrame, grams: dict[str, DataFrame], x: str, y: str, k: int = 10, inner: int = 10, grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
) -> tuple[DataFrame, DataFrame]:
    """Which of two tools to take, by three machines of a C each and one of several settings, all chosen together within each fold's training tasks.

    Gives (fold, setting, cx, cy, ct, mean, test): the best setting and triple of C (of the first tool's, the second's and the pair's
    machine) by the mean share of right choices over the inner folds, the first of equals, and the share of right choices on
    the fold itself; and (fold, setting, cx, cy, ct, mean) of all. A machine is fitted once for each C, and the triples are
    combinations of what the machines say.
    """
    two, expected = two_tools(labels, x, y)
    fold = written(folds(two.select("task").distinct(), k))
    solve, quick = solve_and_pair_rows(two)
    silent = L.tool_pairs(two).select("task", "x", "y").join(quick, ["task", "x", "y"], "left_anti").withColumn("v", F.lit(0))  # teaches nothing, but is asked for
    rows = written(_outside(solve.unionByName(quick).unionByName(silent), fold, k).withColumn("inner", N.inner_fold(inner)))
    x, y = min(x, y), max(x, y)
    means = None
    for name, gram in grams.items():
        gram = S.kept(gram)
        told = S.cross_decided(rows, gram, "x", "y", "fold", cs=tuple(grid), share=("fold",)).select("x", "y", "fold", "inner", "c", "task", (F.col("decision") > 0).alias("said"))
        told = written(told)
        one = lambda a, b, c, said: told.where((F.col("x") == a) & (F.col("y") == b)).select("fold", "inner", "task", F.col("c").alias(c), F.col("said").alias(said))  # noqa: B023, E731
        key = ["fold", "inner", "task"]
        each = one(x, x, "cx", "sx").join(one(y, y, "cy", "sy"), key).join(one(x, y, "ct", "st"), key).join(expected, "task")
        right = (_taken(F.col("sx"), F.col("sy"), F.col("st")) == (F.col("expected") == x)).cast("double")
        part = each.groupBy("fold", "inner", "cx", "cy", "ct").agg(F.avg(right).alias("s")).groupBy("fold", "cx", "cy", "ct").agg(F.round(F.avg("s"), 12).alias("mean"))
        part = part.select("fold", F.lit(name).alias("setting"), "cx", "cy", "ct", "mean")
        means = part if means is None else means.unionByName(part)
    means = written(means)
    order = Window.partitionBy("fold").orderBy(F.desc("mean"), "setting", "cx", "cy", "ct")  # settings by triples
    best = written(means.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r"))
    tests = None
    for name, gram in grams.items():
        mine = best.where(F.col("setting") == name)
        c = F.when((F.col("x") == x) & (F.col("y") == x), F.col("cx")).when((F.col("x") == y) & (F.col("y") == y), F.col("cy")).otherwise(F.col("ct"))
        machines = written(S.at_one_c(rows.where("v <> 0").join(mine, "fold").withColumn("c", c).select("x", "y", "fold", "task", "v", "c"), gram, "x", "y", "fold", share=("fold",)))
        asked = fold.join(mine.select("fold"), "fold")
        parts = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((x, x), (y, y), (x, y))])).alias("m")
        said = S.decided(machines, gram, asked.select("fold", "task", parts).select("m.*", "fold", "task"), "x", "y", "fold")
        wide = said.groupBy("fold", "task").agg(*[F.max(F.when((F.col("x") == a) & (F.col("y") == b), F.col("decision") > 0)).alias(n) for n, a, b in (("sx", x, x), ("sy", y, y), ("st", x, y))])
        right = (_taken(F.col("sx"), F.col("sy"), F.col("st")) == (F.col("expected") == x)).cast("double")
        part = wide.join(expected, "task").groupBy("fold").agg(F.avg(right).alias("test"))
        tests = part if tests is None else tests.unionByName(part)
    return best.join(tests, "fold"), means


def _taken(sx: Column, sy: Column, faster: Column) -> Column:
    """Whether the first tool is taken: it alone is said to solve the task, or both or none are and it is said to be faster."""
    return (sx & ~sy) | ((sx == sy) & faster)


def two_tool_classes(labels: DataFrame, gram: DataFrame, x: str, y: str, k: int = 10, grid: tuple[float, ...] = S.GRID) -> DataFrame:
    """(task, predicted, expected) of two tools: the one that alone solves a task, else the faster; predicted by three machines, learned outside each task's fold."""
    two, expected = two_tools(labels, x, y)
    votes = hyper_predicted(two, gram, written(folds(two.select("task").distinct(), k)), k, grid)
    return votes.select("task", F.when(F.col("p") > 0.5, F.col("x")).otherwise(F.col("y")).alias("predicted")).join(expected, "task")
