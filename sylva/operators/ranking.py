"""Rankings of tools from pairwise votes. A ranking is rows (task, tool, pos), pos from 0; grp marks ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.labels import CEILING, faster, tool_pairs


def _ranked(votes: DataFrame, *order) -> DataFrame:
    return votes.withColumn("pos", F.row_number().over(Window.partitionBy("task").orderBy(*order)) - 1)


def from_pairs(pairs: DataFrame, tools: DataFrame) -> DataFrame:
    """Each pair (task, x, y, p) gives p votes to x and 1 - p to y; ties go to the later tool. p may be a probability."""
    given = pairs.select("task", F.col("x").alias("tool"), F.col("p").alias("votes")).unionByName(pairs.select("task", F.col("y").alias("tool"), (1 - F.col("p")).alias("votes")))
    votes = tools.join(given, ["task", "tool"], "left").groupBy("task", "tool").agg(F.round(F.coalesce(F.sum("votes"), F.lit(0.0)), 6).alias("votes"))
    return _ranked(votes, F.desc("votes"), F.desc("tool"))


def full(labels: DataFrame) -> DataFrame:
    """By solve first, then by who is faster."""
    better = F.when(F.col("sx") > F.col("sy"), 1.0).when(F.col("sx") < F.col("sy"), 0.0).otherwise(faster(F.col("tx"), F.col("ty")).cast("double"))
    return from_pairs(tool_pairs(labels).select("task", "x", "y", better.alias("p")), labels.select("task", "tool"))


def with_ties(labels: DataFrame) -> DataFrame:
    """Half a vote each where both time out unsolved; equal sums of votes are one group."""
    p = (
        F.when(F.col("sx") > F.col("sy"), 1.0)
        .when(F.col("sx") < F.col("sy"), 0.0)
        .when((F.col("tx") >= CEILING) & (F.col("ty") >= CEILING), 0.5)
        .otherwise((F.col("tx") < F.col("ty")).cast("double"))
    )
    ranked = from_pairs(tool_pairs(labels).select("task", "x", "y", p.alias("p")), labels.select("task", "tool"))
    return ranked.withColumn("grp", F.dense_rank().over(Window.partitionBy("task").orderBy(F.desc("votes"))) - 1)


def borda(rankings: DataFrame) -> DataFrame:
    """Tools by the sum of places left below them, over all tasks."""
    n = F.count("*").over(Window.partitionBy("task"))
    points = rankings.withColumn("points", n - F.col("pos") - 1).groupBy("tool").agg(F.sum("points").alias("points"))
    return points.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("points"), "tool")) - 1)  # a row for each tool


def borda_major(labels: DataFrame) -> DataFrame:
    """Tools by pairs won over all tasks; pairs unsolved by both, of which x isn't faster, say nothing."""
    quick = faster(F.col("tx"), F.col("ty"))
    pairs = tool_pairs(labels).where(~((F.col("sx") == 0) & (F.col("sy") == 0) & ~quick))
    wins_x = F.when(F.col("sx") != F.col("sy"), (F.col("sx") > F.col("sy"))).otherwise(quick).cast("int")
    won = pairs.select(F.col("x").alias("tool"), wins_x.alias("w")).unionByName(pairs.select(F.col("y").alias("tool"), (1 - wins_x).alias("w")))
    return won.groupBy("tool").agg(F.sum("w").alias("wins")).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("wins"), "tool")) - 1)


def expected_votes(solved: DataFrame, quick: DataFrame) -> DataFrame:
    """Votes from probabilities that a tool solves (task, tool, p) and that x is faster (task, x, y, f)."""
    side = lambda t, p: solved.select("task", F.col("tool").alias(t), F.col("p").alias(p))
    j = quick.join(side("x", "px"), ["task", "x"]).join(side("y", "py"), ["task", "y"])
    both = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return from_pairs(j.select("task", "x", "y", (F.col("px") * (1 - F.col("py")) + both * F.col("f")).alias("p")), solved.select("task", "tool"))


#: Points of a front, at most.
FRONT = 10_000


def pareto(points: DataFrame, scores: list[str], name: str = "id") -> DataFrame:
    """Points that no other is at least as good as in all scores; of equal ones the least name stays.

    Candidates are few: parameter settings with their scores; more than FRONT are an error, as all pairs are compared.
    """
    if points.limit(FRONT + 1).count() > FRONT:
        raise ValueError(f"{FRONT} points at most")
    other = points.select(F.col(name).alias("o"), *[F.col(s).alias(f"o_{s}") for s in scores])
    at_least, equal = F.lit(True), F.lit(True)
    for s in scores:
        at_least &= F.col(f"o_{s}") >= F.col(s)
        equal &= F.col(f"o_{s}") == F.col(s)
    return points.join(other, (F.col("o") != F.col(name)) & at_least & (~equal | (F.col("o") < F.col(name))), "left_anti")


def from_preferences(pairs: DataFrame, tools: DataFrame) -> DataFrame:
    """A vote to x where v is 1, to y where it is -1, to none where it is 0 (task, x, y, v); ties go to the later tool."""
    given = pairs.where("v <> 0").select("task", F.when(F.col("v") == 1, F.col("x")).otherwise(F.col("y")).alias("tool"), F.lit(1.0).alias("votes"))
    votes = tools.join(given, ["task", "tool"], "left").groupBy("task", "tool").agg(F.coalesce(F.sum("votes"), F.lit(0.0)).alias("votes"))
    return _ranked(votes, F.desc("votes"), F.desc("tool"))


def by_result(labels: DataFrame) -> DataFrame:
    """By votes of pairs, by solve = 1 and then time; the winner of the first two tools stands before other ties, then tools in order."""
    at = labels.withColumn("at", F.row_number().over(Window.partitionBy("task").orderBy("tool")) - 1)
    ok, pair = (lambda c: F.col(c) == 1), tool_pairs(labels)
    x_wins = F.when(ok("sx") & ~ok("sy"), True).when(ok("sy") & ~ok("sx"), False).otherwise(F.col("tx") < F.col("ty"))
    won = pair.select("task", F.when(x_wins, F.col("x")).otherwise(F.col("y")).alias("tool"))
    votes = won.groupBy("task", "tool").agg(F.count("*").alias("votes"))
    first = at.where("at < 2").groupBy("task").agg(F.min("tool").alias("x"), F.max("tool").alias("y"))
    head = first.join(pair, ["task", "x", "y"]).select("task", F.when(x_wins, F.col("x")).otherwise(F.col("y")).alias("head"))
    rows = at.join(votes, ["task", "tool"], "left").join(head, "task", "left").select(
        "task", "tool", F.coalesce("votes", F.lit(0)).alias("votes"), F.when(F.col("tool") == F.col("head"), -1).otherwise(F.col("at")).alias("turn")
    )
    return _ranked(rows, F.desc("votes"), "turn").drop("turn")


def as_lists(rankings: DataFrame) -> DataFrame:
    """(task, ranking): tools as an array, the first the best."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tool")))  # a task's tools
    return rankings.groupBy("task").agg(F.transform(ordered, lambda r: r["tool"]).alias("ranking"))
