"""Gram tables (i, j, v) with i <= j over bags (graph, label, cnt); extra key columns (such as h) are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import written


#: Graphs of one label that meet all others of it in one task.
HOT = 2_000


def _split(bags: DataFrame, keys: list[str]) -> DataFrame:
    """bags with parts: how many parts the graphs of each label are dealt into, more than one for labels of very many graphs only."""
    hot = bags.groupBy(*keys).agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    return written(bags.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1))))


def _pairs(bags: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs i <= j of graphs that share a label. A label of very many graphs is split: each part of them meets all."""
    keys = [*keys, "label"]
    spread = _split(bags.select(*keys, "graph", "cnt"), keys)
    left = spread.select(*keys, F.pmod(F.xxhash64("graph"), "parts").cast("int").alias("part"), F.col("graph").alias("i"), F.col("cnt").alias("a"))
    right = spread.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("graph").alias("j"), F.col("cnt").alias("b"))
    return left.join(right, [*keys, "part"]).where("i <= j")


def similar(bags: DataFrame, least: float) -> DataFrame:
    """Pairs i < j of Jaccard similarity least and more, whole: only labels that a pair as alike must share make candidates.

    Of a bag with a sum of s counts, labels are taken from the rarest on until those left hold less than least * s: two bags
    that share none of these cannot be as alike. Sums must also be within the share least of each other. What two bags
    have in common stands at or after the first label that they share, so neither may have less left there than they need
    in common. A label of very many graphs is split.
    """
    bags = written(bags.select("graph", "label", "cnt"))
    df = bags.groupBy("label").agg(F.count("*").alias("df"))
    size = bags.groupBy("graph").agg(F.sum("cnt").alias("s"))
    order = Window.partitionBy("graph").orderBy("df", "label").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = bags.join(df, "label").withColumn("rest", F.sum("cnt").over(order)).join(size, "graph")
    few = _split(placed.where(F.col("rest") >= F.lit(least) * F.col("s") - 1e-9).select("graph", "label", "s", "rest"), ["label"])
    side = lambda part, g, s, r: few.select("label", part.alias("part"), F.col("graph").alias(g), F.col("s").alias(s), F.col("rest").alias(r))
    left = side(F.pmod(F.xxhash64("graph"), "parts").cast("int"), "i", "x", "ri")
    right = side(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "j", "y", "rj")
    fits = (F.col("i") < F.col("j")) & (F.least("x", "y") >= F.lit(least) * F.greatest("x", "y") - 1e-9)
    fits &= F.least("ri", "rj") >= F.lit(least / (1 + least)) * (F.col("x") + F.col("y")) - 1e-9
    pairs = written(left.join(right, ["label", "part"]).where(fits).select("i", "j", "x", "y").distinct())
    one = lambda g, c: bags.select(F.col("graph").alias(g), "label", F.col("cnt").alias(c))
    shared = pairs.join(one("i", "a"), "i").join(one("j", "b"), ["j", "label"]).groupBy("i", "j", "x", "y").agg(F.sum(F.least("a", "b")).alias("m"))
    v = F.col("m") / (F.col("x") + F.col("y") - F.col("m"))
    return shared.select("i", "j", v.alias("v")).where(F.col("v") >= least)


def linear(bags: DataFrame, *keys: str) -> DataFrame:
    """Sums of products over shared labels; pairs without one are 0 and left out."""
    return _pairs(bags, list(keys)).groupBy(*keys, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def jaccard(bags: DataFrame, *keys: str) -> DataFrame:
    """Shared counts by all counts; the sum of greater counts is what both sizes leave."""
    keys = list(keys)
    size = bags.groupBy(*keys, "graph").agg(F.sum("cnt").alias("s"))
    shared = _pairs(bags, keys).groupBy(*keys, "i", "j").agg(F.sum(F.least("a", "b")).alias("m"))
    side = lambda g, s: size.select(*keys, F.col("graph").alias(g), F.col("s").alias(s))
    both = shared.join(side("i", "x"), [*keys, "i"]).join(side("j", "y"), [*keys, "j"])
    return both.select(*keys, "i", "j", (F.col("m") / (F.col("x") + F.col("y") - F.col("m"))).alias("v"))


#: Parts of the graphs, each of which meets each in a task of its own, where all pairs are asked for.
BLOCKS = 16


def squared_distance(bags: DataFrame, *keys: str) -> DataFrame:
    """All pairs, those without a shared label too, as a distance has no zeros to leave out: the result grows with the square of the graphs. Blocks of pairs are dealt by a key."""
    keys = list(keys)
    dot = linear(bags, *keys)
    own = bags.groupBy(*keys, "graph").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("s")).withColumn("p", F.pmod(F.xxhash64("graph"), F.lit(BLOCKS)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    left = own.select(*keys, "p", F.explode(every).alias("q"), F.col("graph").alias("i"), F.col("s").alias("x"))
    right = own.select(*keys, F.explode(every).alias("p"), F.col("p").alias("q"), F.col("graph").alias("j"), F.col("s").alias("y"))
    all_pairs = left.join(right, [*keys, "p", "q"]).where("i <= j").drop("p", "q")
    return all_pairs.join(dot, [*keys, "i", "j"], "left").select(*keys, "i", "j", F.greatest(F.col("x") + F.col("y") - 2 * F.coalesce("v", F.lit(0.0)), F.lit(0.0)).alias("v"))


def rbf(bags: DataFrame, gamma: float | None = None, *keys: str) -> DataFrame:
    gamma = 1.0 / max(1, bags.select("label").distinct().count()) if gamma is None else gamma
    return squared_distance(bags, *keys).withColumn("v", F.exp(-F.lit(gamma) * F.col("v")))


def to_similarity(distances: DataFrame, *keys: str) -> DataFrame:
    """The greatest distance less each."""
    if not keys:
        top = distances.agg(F.max("v").alias("top"))
        return distances.join(F.broadcast(top)).select("i", "j", (F.col("top") - F.col("v")).alias("v"))  # one row
    return distances.withColumn("v", F.max("v").over(Window.partitionBy(*keys)) - F.col("v"))


def distance(bags: DataFrame, *keys: str) -> DataFrame:
    return squared_distance(bags, *keys).withColumn("v", F.sqrt("v"))


def euclidean(bags: DataFrame, *keys: str) -> DataFrame:
    return to_similarity(distance(bags, *keys), *keys)


def normalized(gram: DataFrame, *keys: str) -> DataFrame:
    """v by the root of both diagonal values."""
    keys = list(keys)
    own = gram.where("i = j")
    side = lambda g, s: own.select(*keys, F.col("i").alias(g), F.col("v").alias(s))
    both = gram.join(side("i", "x"), [*keys, "i"]).join(side("j", "y"), [*keys, "j"])
    return both.select(*keys, "i", "j", (F.col("v") / F.sqrt(F.col("x") * F.col("y"))).alias("v"))


def summed(gram: DataFrame) -> DataFrame:
    """The sum over levels."""
    return gram.groupBy("i", "j").agg(F.sum("v").alias("v"))


def vector_gram(vectors: DataFrame, name: str = "v", metric: str | None = None) -> DataFrame:
    """Products of dense vectors (id, v) for all pairs i <= j; with a metric (euclidean, cosine), 1 less the distance. The result has the square of the rows; blocks of pairs are dealt by a key."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = vectors.select("id", F.col(name).alias("v")).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    left = rows.select("p", every.alias("q"), F.col("id").alias("i"), F.col("v").alias("a"))
    right = rows.select(every.alias("p"), F.col("p").alias("q"), F.col("id").alias("j"), F.col("v").alias("b"))
    pairs = left.join(right, ["p", "q"]).where("i <= j")
    product = dot(F.col("a"), F.col("b"))
    value = {
        None: product,
        "euclidean": 1 - F.sqrt(F.greatest(dot(F.col("a"), F.col("a")) + dot(F.col("b"), F.col("b")) - 2 * product, F.lit(0.0))),
        "cosine": product / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))),
    }[metric]
    return pairs.select("i", "j", value.alias("v"))


def reduced_gram(vectors: DataFrame, name: str = "x", metric: str | None = None) -> DataFrame:
    """The normalised Gram of reduced features (id, x), in place of the sum over levels; by a metric, 1 less the distance."""
    gram = vector_gram(vectors, name, metric)
    return normalized(gram) if metric is None else gram


def levels_gram(levels: DataFrame, kernel: str = "linear", h: int | None = None, distance: bool = False) -> DataFrame:
    """The normalised sum over levels (column h, up to h) of a kernel's Gram; a distance's levels become similarities first."""
    levels = levels if h is None else levels.where(F.col("h") <= h)
    gram = KERNELS[kernel](levels, "h")
    return normalized(summed(to_similarity(gram, "h") if distance else gram))


def pairwise(bags: DataFrame, kernel, distance: bool = False) -> DataFrame:
    """A kernel's Gram; of a distance, all pairs i < j as similarities and the diagonal as the greatest of them."""
    gram = kernel(bags)
    return to_similarity(gram) if distance else gram


def levels_similarity(levels: DataFrame) -> DataFrame:
    """(h, i, j, v) of pairs i < j: each level's Jaccard similarity, normalised."""
    return normalized(jaccard(levels, "h"), "h").where("i < j")


def split_gram(bags: DataFrame, test: DataFrame, kernel: str = "linear") -> tuple[DataFrame, DataFrame]:
    """The normalised Gram of training graphs among themselves (i <= j), and of test graphs (i) with training graphs (j), from one product over both."""
    gram = normalized(KERNELS[kernel](bags))
    flag = lambda k: test.select(F.col("graph").alias(k), F.lit(True).alias(f"{k}_test"))
    marked = gram.join(flag("i"), "i", "left").join(flag("j"), "j", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("i_test", "j_test")})
    across = marked.where("i_test <> j_test").select(F.when(F.col("i_test"), F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("i_test"), F.col("j")).otherwise(F.col("i")).alias("j"), "v")
    return marked.where("not i_test and not j_test").select("i", "j", "v"), across


#: Kernels by name; each takes bags.
KERNELS = {"linear": linear, "jaccard": jaccard, "rbf": lambda bags, *keys: rbf(bags, None, *keys), "euclidean": euclidean, "distance": distance}
