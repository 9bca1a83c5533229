"""Quality of predicted rankings (task, tool, pos) against expected ones (task, tool, pos or grp) and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_broken(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """The expected ranking with ties in predicted order."""
    both = expected.select("task", "tool", "grp").join(predicted.select("task", "tool", F.col("pos").alias("guess")), ["task", "tool"])
    return both.select("task", "tool", (F.row_number().over(Window.partitionBy("task").orderBy("grp", "guess")) - 1).alias("pos"))


def accuracy(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    first = lambda r, n: r.where("pos = 0").select("task", F.col("tool").alias(n))
    return first(expected, "e").join(first(predicted, "p"), "task").select("task", (F.col("e") == F.col("p")).cast("int").alias("score"))


def spearman(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)); null for a single tool."""
    both = expected.select("task", "tool", F.col("pos").alias("e")).join(predicted.select("task", "tool", F.col("pos").alias("p")), ["task", "tool"])
    sums = both.groupBy("task").agg(F.sum(F.pow(F.col("e") - F.col("p"), F.lit(2))).alias("d"), F.count("*").alias("n"))
    return sums.select("task", F.when(F.col("n") > 1, 1 - 6 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("score"))


def kendall(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(concordant - discordant) / pairs of different expected groups; 1 without such pairs."""
    both = expected.select("task", "tool", "grp").join(predicted.select("task", "tool", "pos"), ["task", "tool"])
    side = lambda p: both.select("task", F.col("grp").alias(f"g{p}"), F.col("pos").alias(f"p{p}"))
    pairs = side("a").join(side("b"), "task").where("ga < gb")
    tau = pairs.groupBy("task").agg(F.avg(F.when(F.col("pa") < F.col("pb"), 1.0).otherwise(-1.0)).alias("score"))
    return both.select("task").distinct().join(tau, "task", "left").select("task", F.coalesce("score", F.lit(1.0)).alias("score"))


def top_labels(labels: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each task's first tool with its label, whether any tool solves the task, and the sum of times."""
    every = labels.groupBy("task").agg(F.max((F.col("solve") == 1).cast("int")).alias("solvable"), F.sum("time").alias("total"))
    return predicted.where("pos = 0").select("task", "tool").join(labels, ["task", "tool"]).join(every, "task")


def competition(top: DataFrame) -> DataFrame:
    """1 if the first tool solves the task, -1 if only another does, else 0."""
    return top.select("task", F.when(F.col("solve") == 1, 1).when(F.col("solvable") == 1, -1).otherwise(0).alias("score"))


def correct(top: DataFrame) -> DataFrame:
    """1 if the first tool solves the task or none does."""
    return top.select("task", ((F.col("solve") == 1) | (F.col("solvable") == 0)).cast("int").alias("score"))


def time_share(top: DataFrame, extra: float = 0.0) -> DataFrame:
    """Time of the choice and its tool by the time of running all."""
    return top.select("task", ((F.col("time") + extra) / F.col("total")).alias("score"))


def fail_fast(labels: DataFrame, predicted: DataFrame) -> DataFrame:
    """1 where the first two tools both fail and the first is not slower."""
    two = predicted.where("pos < 2").join(labels, ["task", "tool"]).groupBy("task").agg(
        F.max(F.when(F.col("pos") == 0, F.struct("solve", "time"))).alias("a"), F.max(F.when(F.col("pos") == 1, F.struct("solve", "time"))).alias("b")
    )
    return two.select("task", F.coalesce(((F.col("a.solve") != 1) & (F.col("b.solve") != 1) & (F.col("a.time") <= F.col("b.time"))).cast("int"), F.lit(0)).alias("score"))


def pair_scores(expected: Column, predicted: Column) -> list[Column]:
    """Accuracy, precision, recall and f1 of 1 against the rest; 0 / 0 is 0."""
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    both = F.sum(((expected == 1) & (predicted == 1)).cast("int"))
    p, r = F.sum((predicted == 1).cast("int")), F.sum((expected == 1).cast("int"))
    return [F.avg((expected == predicted).cast("double")).alias("accuracy"), share(both, p).alias("precision"), share(both, r).alias("recall"), share(2 * both, p + r).alias("f1")]


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.percentile("score", 0.5).alias("median"), F.count("score").alias("n"))


def by_property(rows: DataFrame, value: str, props: str = "props") -> DataFrame:
    """Mean, deviation, least, greatest and number of a value over all rows ("overall", each once) and those of each property."""
    each = rows.select(F.col(value).alias("v"), F.explode(F.array_union(F.array(F.lit("overall")), F.col(props))).alias("prop"))
    return each.groupBy("prop").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.count("*").alias("n"))
