"""Weights and choices of labels over bags (graph, label, cnt); class tables are (graph, cls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_rows(weighted: DataFrame) -> DataFrame:
    """Weights v (graph, label, v) by each graph's Euclidean length."""
    size = weighted.groupBy("graph").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    return weighted.join(size, "graph").select("graph", "label", (F.col("v") / F.col("size")).alias("v"))


def tfidf(bags: DataFrame, train: DataFrame | None = None, sublinear: bool = False) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1) with unit rows; df from the training graphs only."""
    fit = bags if train is None else bags.join(train, "graph", "left_semi")
    df = fit.groupBy("label").agg(F.count("*").alias("df"))
    n = fit.select("graph").distinct().agg(F.count("*").alias("n"))
    tf = 1 + F.log("cnt") if sublinear else F.col("cnt")
    return unit_rows(bags.join(df, "label").join(F.broadcast(n)).select("graph", "label", (tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v")))


def tfidf_class(bags: DataFrame, classes: DataFrame, m: int) -> DataFrame:
    """idf over the 2^m class patterns that hold a label, unit rows."""
    seen = bags.join(classes, "graph").groupBy("label").agg(F.count_distinct("cls").alias("k"))
    return unit_rows(bags.join(seen, "label").select("graph", "label", (F.col("cnt") * (F.log((F.lit(2.0**m) + 1) / (1 + F.col("k"))) + 1)).alias("v")))


def class_code(labels: list[Column]) -> Column:
    """Label columns as one number, the first the highest digit."""
    return sum((c.cast("long") * (1 << (len(labels) - 1 - i)) for i, c in enumerate(labels)), F.lit(0).cast("long"))


def covering(bags: DataFrame, share: float = 0.001) -> DataFrame:
    """Labels in so great a share (of the number of labels, as documented) of graphs."""
    df = bags.groupBy("label").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(df.agg(F.count("*").alias("m")))).where(F.col("df") / F.col("m") >= share).select("label", "df")


def by_sum(bags: DataFrame, k: int = 10_000) -> DataFrame:
    return bags.groupBy("label").agg(F.sum("cnt").alias("score")).orderBy(F.desc("score"), "label").limit(k)


def by_coverage(bags: DataFrame, k: int = 1_000) -> DataFrame:
    df = bags.groupBy("label").agg(F.count_distinct("graph").alias("df")).join(F.broadcast(bags.agg(F.count_distinct("graph").alias("n"))))
    return df.select("label", (F.col("df") / F.col("n")).alias("score")).orderBy(F.desc("score"), "label").limit(k)


def by_density(bags: DataFrame, share: float = 0.5) -> DataFrame:
    """The heaviest labels that make up to a share of the whole. The running sum goes over distinct weights, which are few, and then within one."""
    sums = bags.groupBy("label").agg(F.sum("cnt").alias("score"))
    weights = sums.groupBy("score").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("score") * F.col("n")).over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = weights.withColumn("before", before).join(F.broadcast(sums.agg(F.sum("score").alias("total"))))
    room = weights.select("score", F.floor((F.lit(share) * F.col("total") - F.col("before")) / F.col("score")).alias("room")).where("room >= 1")
    placed = sums.join(room, "score").withColumn("r", F.row_number().over(Window.partitionBy("score").orderBy("label")))
    return placed.where("r <= room").select("label", "score")


def _by_class(bags: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    observed = bags.join(classes, "graph").groupBy("label", "cls").agg(F.sum("cnt").alias("o"), F.count("*").alias("k"))
    share = classes.groupBy("cls").agg(F.count("*").alias("c"))
    return observed, share.join(F.broadcast(share.agg(F.sum("c").alias("n"))))


def chi2(bags: DataFrame, classes: DataFrame, k: int = 1_000) -> DataFrame:
    """Sums as observed against class shares of the label's sum, the k greatest."""
    observed, share = _by_class(bags, classes)
    total = observed.groupBy("label").agg(F.sum("o").alias("t"))
    full = total.join(F.broadcast(share)).join(observed.select("label", "cls", "o"), ["label", "cls"], "left")  # classes are few
    e = F.col("t") * F.col("c") / F.col("n")
    score = F.sum(F.pow(F.coalesce("o", F.lit(0.0)) - e, F.lit(2)) / e).alias("score")
    return full.groupBy("label").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "label").limit(k)


def mutual_information(bags: DataFrame, classes: DataFrame, k: int = 1_000) -> DataFrame:
    """Of a label's presence with the class, in nats, absent graphs included."""
    observed, share = _by_class(bags, classes)
    df = observed.groupBy("label").agg(F.sum("k").alias("df"))
    full = df.join(F.broadcast(share)).join(observed.select("label", "cls", "k"), ["label", "cls"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    part = lambda x, of: F.when(x > 0, x / F.col("n") * F.log(x * F.col("n") / (of * F.col("c")))).otherwise(0.0)
    here, absent = F.col("k"), F.col("c") - F.col("k")
    score = F.sum(part(here, F.col("df")) + part(absent, F.col("n") - F.col("df")))
    return full.groupBy("label").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "label").limit(k)


def bns(bags: DataFrame, classes: DataFrame, k: int = 10_000) -> DataFrame:
    """Bi-normal separation of two classes (cls 0 and 1): distance of the normal quantiles of both rates."""
    observed, _ = _by_class(bags, classes)
    n = classes.agg(F.sum((F.col("cls") == 1).cast("int")).alias("p"), F.sum((F.col("cls") == 0).cast("int")).alias("q"))
    counts = observed.groupBy("label").agg(F.sum(F.when(F.col("cls") == 1, F.col("k")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cls") == 0, F.col("k")).otherwise(0)).alias("fp"))
    rates = counts.join(F.broadcast(n)).select("label", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("q")).alias("fpr"))

    rate = lambda c: normal_quantile(F.greatest(F.least(F.col(c), F.lit(0.9995)), F.lit(0.0005)))
    return rates.select("label", F.round(F.abs(rate("tpr") - rate("fpr")), 6).alias("score")).orderBy(F.desc("score"), "label").limit(k)


# Coefficients of the published rational approximation of the normal distribution's quantiles (Wichura 1988, AS 241),
# numerator and denominator, from the highest power: within 0.425 of the middle, and by the root of -ln of the tail up to 5.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)


def _polynomial(coefficients: tuple[float, ...], r: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * r + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal distribution's quantile, for chances from e**-25 to 1 - e**-25."""
    q = p - 0.5
    near, far = F.lit(0.180625) - q * q, F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    middle = q * _polynomial(CENTRE[0], near) / _polynomial(CENTRE[1], near)
    tail = F.signum(q) * _polynomial(TAIL[0], far) / _polynomial(TAIL[1], far)
    return F.when(F.abs(q) <= 0.425, middle).otherwise(tail)


def hsic(bags: DataFrame, patterns: DataFrame, columns: list[str], k: int = 1_000, centre: bool = False) -> DataFrame:
    """Labels by how far graphs that hold them agree in their own labels (columns of patterns, by graph), the k greatest.

    The label kernel is weighed element by element with the centring matrix; with centre it is multiplied by it on
    both sides. Graphs count by the values of each of their labels, so no two of them, nor two patterns, need to meet.
    """
    n = patterns.agg(F.count("*").alias("n"))  # one row
    held = bags.where("cnt > 0").select("graph", "label").distinct().join(patterns.select("graph", *columns), "graph")
    df = held.groupBy("label").agg(F.count("*").alias("df"))
    # Two graphs agree in a column or not, so their agreement is a sum over columns, and of squares of counts by value.
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell")
    counts = held.select("label", cells).groupBy("label", "cell").agg(F.count("*").cast("double").alias("c")).where("cell.value is not null")
    if centre:
        sizes = patterns.select(cells).groupBy("cell").agg(F.count("*").alias("size")).where("cell.value is not null")
        every = df.crossJoin(F.broadcast(sizes))  # a row for each value of the label columns
        counts = every.join(counts, ["label", "cell"], "left").join(F.broadcast(n)).select("label", (F.coalesce("c", F.lit(0.0)) - F.col("df") * F.col("size") / F.col("n")).alias("c"))
    sums = counts.groupBy("label").agg((F.sum(F.col("c") * F.col("c")) / len(columns)).alias("s"))
    if centre:
        return sums.select("label", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "label").limit(k)
    one = 1 / F.col("n")
    score = F.col("s") * one * one + F.col("df") * ((1 - one) * (1 - one) - one * one)
    return sums.join(df, "label").join(F.broadcast(n)).select("label", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "label").limit(k)


def prepared(levels: DataFrame, vocabulary: DataFrame, h: int) -> DataFrame:
    """Sublinear weights of the vocabulary's labels, counts summed over the levels up to h."""
    summed = levels.where(F.col("h") <= h).groupBy("graph", "label").agg(F.sum("cnt").alias("cnt"))
    return tfidf(summed.join(vocabulary.select("label"), "label", "left_semi"), sublinear=True)


def split_transformed(bags: DataFrame, test: DataFrame, steps: list) -> tuple[DataFrame, DataFrame]:
    """Training and test bags over the labels that steps, one after the other, keep of the training bags."""
    train = bags.join(test, "graph", "left_anti")
    for step in steps:
        train = train.join(step(train).select("label"), "label", "left_semi")
    kept = train.select("label").distinct()
    return train, bags.join(test, "graph", "left_semi").join(kept, "label", "left_semi")


def hamming_kernel(patterns: DataFrame, columns: list[str]) -> DataFrame:
    """1 less the share of labels that differ, for pairs of distinct patterns (columns plus n)."""
    side = lambda p: patterns.select(*[F.col(c).alias(f"{p}_{c}") for c in columns])
    same = sum((F.col(f"i_{c}") == F.col(f"j_{c}")).cast("int") for c in columns)
    return side("i").crossJoin(side("j")).withColumn("v", same / len(columns))  # 2^m patterns at most


def chained(*steps):
    """Selection steps one after the other: each takes bags and returns the labels that stay."""

    def run(bags: DataFrame) -> DataFrame:
        for step in steps:
            bags = bags.join(step(bags).select("label"), "label", "left_semi")
        return bags

    return run
