"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source asks for the same fraction of copies. Two units that share a source's
words move words from one to the other, at random and without bias, until one of them is whole.
Long documents go first, from the longest down, each against all shorter ones taken as one unit,
so that those can make up for it. All others are dealt into small groups by hash and pivoted pair
by pair; a group's last fractional document goes up a reduction tree. The one document that the
root keeps is short, and rounded at random. Every document's expected copies are the fraction asked
for. Only DataFrame functions are used, and no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import SPACE, cut, uniform
from sylva.operators.bags import dense_index
from sylva.session import table

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
#: Documents in a group, and groups in a node of the tree, on average.
FAN_IN = 256
#: Documents of more than such a part of their source are long; a source has fewer than so many.
LONG = 512
#: Ranges of sources of which one is looked into further, and equal rows that one task numbers or repeats.
BINS, WIDE = 256, 4096
_WHOLE = 1e-9
_FIELDS = ["rid", "h", "g", "key", "size", "copies", "x"]
_KIND = "struct<rid:bigint,h:bigint,g:bigint,key:bigint,size:bigint,copies:int,x:double>"


def word_count(text: Column) -> Column:
    """The number of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source, source_size, n, sid (the source's number by code point, null last) and target, for a table of one row per source.

    Weights repeat over the sources. What a weight of one gets is the level at which all shares, each
    stopped at its limit, make up the sum of all sizes.
    """
    name = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("of")).alias("name")
    number = dense_index(sizes.select(name), "name").select("name.of", F.col("idx").alias("sid"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.join(number, sizes["source"].eqNullSafe(number["of"])).drop("of")
    ranked = cut(ranked.withColumn("weight", weight).withColumn("most", F.lit(limit) * F.col("source_size")))
    share = F.lit(_level(ranked)) * F.col("weight")
    return ranked.select("source", "source_size", "n", "sid", F.when(F.col("most") < share, F.col("most")).otherwise(share).cast("double").alias("target"))


def _level(ranked: DataFrame) -> float:
    """What a weight of one gets, so that all get the sum of sizes: a source stops where its limit by weight is below it.

    Each round sums the sources between two levels by BINS ranges, and goes on in the range where the sum of sizes is reached.
    """
    full_at = F.col("most") / F.col("weight")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    low, high, fixed, free = -1.0, None, 0.0, 0.0  # sums of the limits up to low, and of the weights above high
    while total:
        within = ranked.where((full_at > low) & (full_at <= high if high is not None else F.lit(True)))
        levels = within.select(full_at.alias("level")).distinct()
        cuts = sorted(set(levels.agg(F.percentile_approx("level", [i / BINS for i in range(1, BINS + 1)], 10 * BINS)).first()[0]))
        sums = within.groupBy(F.expr(f"array_position(transform(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c >= most / weight), true)").alias("bin"))
        sums = {r.bin: r for r in sums.agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"), F.count_distinct(full_at).alias("n")).collect()}  # BINS rows and one
        above = free + sum(r.weight for r in sums.values())
        for k, c in enumerate([*cuts, None]):
            r = sums.get(k + 1 if c is not None else 0)
            if r is None:
                continue
            if c is not None and fixed + r.most + c * (above - r.weight) < total:
                low, fixed, above = c, fixed + r.most, above - r.weight  # all of these stop
                continue
            if r.n == 1:  # of equal limits, none stops
                return (total - fixed) / above
            high, free = c, above - r.weight
            break
        else:
            return (total - fixed) / above if above else float("inf")
    return 0.0


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_x(u: Column, x: Column) -> Column:
    return F.struct(*[u[f].alias(f) for f in _FIELDS[:-1]], x.alias("x"))


def _snapped(x: Column) -> Column:
    return F.when(x < _WHOLE, F.lit(0.0)).when(x > 1 - _WHOLE, F.lit(1.0)).otherwise(x)


def _pivot(units: Column, seed: str) -> Column:
    """Settle all but one of the units, keeping the words that they ask for in sum."""

    def step(acc: Column, u: Column) -> Column:
        c = acc["carry"]
        mass = c["size"] * c["x"] + u["size"] * u["x"]
        # All that fits to the carry, or all that fits to the unit.
        to_c, to_u = F.least(F.lit(1.0), mass / c["size"]), F.least(F.lit(1.0), mass / u["size"])
        c_low = (mass - u["size"] * to_u) / c["size"]
        chance = (c["x"] - c_low) / (to_c - c_low)

        def settle(p: Column) -> Column:
            x = _snapped(F.when(p["first"], p["to_c"]).otherwise(p["c_low"]))
            y = _snapped((p["mass"] - c["size"] * x) / u["size"])
            whole = (x == 0.0) | (x == 1.0)
            return F.when(
                whole, F.struct(_with_x(u, y).alias("carry"), F.array_append(acc["out"], _with_x(c, x)).alias("out"))
            ).otherwise(F.struct(_with_x(c, x).alias("carry"), F.array_append(acc["out"], _with_x(u, F.round(y))).alias("out")))

        pair = F.struct(
            mass.alias("mass"), to_c.alias("to_c"), c_low.alias("c_low"), (uniform(seed, c["rid"], u["rid"]) < chance).alias("first")
        )
        c_whole = (c["x"] == 0.0) | (c["x"] == 1.0)
        return F.when(c.isNull(), F.struct(u.alias("carry"), acc["out"].alias("out"))).when(
            c_whole, F.struct(u.alias("carry"), F.array_append(acc["out"], c).alias("out"))
        ).otherwise(_let(pair, settle))

    zero = F.struct(F.lit(None).cast(_KIND).alias("carry"), F.array().cast(f"array<{_KIND}>").alias("out"))
    return F.aggregate(units, zero, step, lambda acc: F.array_append(acc["out"], acc["carry"]))


def _against_rest(units: Column, whole: Column, x: Column, seed: str) -> Column:
    """The units (long documents, the longest first) with their x, and rest, the fraction then asked of each shorter document.

    All documents of the source hold whole words and ask for x. A unit meets all that come after it, as
    one unit. If these become whole first, it stays fractional.
    """

    def step(acc: Column, u: Column) -> Column:
        size, rest, r = u["size"], acc["words"] - u["size"], acc["rest"]
        mass = (size + rest) * r
        to_u, to_rest = F.least(F.lit(1.0), mass / size), F.when(rest > 0, F.least(F.lit(1.0), mass / rest)).otherwise(r)
        u_low = F.when(rest > 0, (mass - rest * to_rest) / size).otherwise(r)
        chance = F.when(to_u > u_low, (r - u_low) / (to_u - u_low)).otherwise(0.0)
        up = (rest > 0) & (uniform(seed, u["rid"]) < chance)
        drawn = F.struct(_snapped(F.when(up, to_u).otherwise(u_low)).alias("x"), _snapped(F.when(up, (mass - size * to_u) / rest).otherwise(to_rest)).alias("rest"))
        same = F.struct(r.alias("x"), r.alias("rest"))
        settled = (r == 0.0) | (r == 1.0) | (rest <= 0)
        return _let(F.when(settled, same).otherwise(drawn), lambda d: F.struct(rest.alias("words"), d["rest"].alias("rest"), F.array_append(acc["out"], _with_x(u, d["x"])).alias("out")))

    zero = F.struct(whole.cast("double").alias("words"), x.alias("rest"), F.array().cast(f"array<{_KIND}>").alias("out"))
    return F.aggregate(units, zero, step)


def content(*columns: Column) -> list[Column]:
    """h and g: 128 bits that tell contents apart, whatever file or partition they stand in."""
    parts = [p for c in columns for p in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit("again"), *parts).alias("g")]


def numbered(docs: DataFrame) -> DataFrame:
    """rid, h, g, key, source and size: a row for each row of docs (h, g, key, source, size), where rows that agree in all are numbered.

    Such rows are counted where they stand; only of more than WIDE are the numbers dealt out.
    """
    equal = cut(docs.groupBy("h", "g", "key", "source", "size").agg(F.count("*").alias("n")))
    few = equal.where(F.col("n") <= WIDE).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    wide = equal.where(F.col("n") > WIDE).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(WIDE)))).repartition("h", "from")
    wide = wide.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + WIDE - 1, "n")))).drop("from")
    return few.unionByName(wide).select(F.xxhash64("h", "g", "nth").alias("rid"), "h", "g", "key", "source", "size")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, seed: str = "mix", key: str = "doc_id", size: Column | None = None
) -> DataFrame:
    """rid, key, source, size, source_size, target, copies and taken for each row of docs.

    Targets share the sum of all sizes by weight and stop at limit times a source's size. Each
    document gets floor(rate) copies or one more; taken = copies * size. A source's words meet its
    target to within one document: a short one, or, where one document holds most of the source, that.
    Null texts and documents of no words have size 0 and take none. Null sources form one source, the
    last. Repeated rows and null keys are rows like any other, rounded apart. Documents of equal size
    go by hash. Very long texts are counted whole. An empty table gives an empty result; other columns
    are ignored. The draw depends on the seed and on what the rows hold (key, source, text), and not on
    where they stand, so reruns agree on any cluster; rid is a hash of these and, among equal rows, a number.
    """
    return _mixed(docs, weights, limit, seed, key, size).drop("h", "g")


def _mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, seed: str = "mix", key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """mix_sources, with the content h, g that each row was drawn by."""
    words = word_count(F.col("text")) if size is None else size
    held = [F.col(key), F.col("source"), *([F.col("text")] if "text" in docs.columns else [])]
    sized = cut(numbered(docs.select(*content(*held), F.col(key).alias("key"), "source", words.alias("size"))))
    goal = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, limit))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).cast("long")
    widest = goal.agg(F.max(groups)).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(limit), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rate = F.when(F.abs(rate - F.round(rate)) < _WHOLE, F.round(rate)).otherwise(rate)
    g = goal.select(F.col("source").alias("of"), "sid", "source_size", groups.alias("groups"), rate.alias("rate"))
    joined = sized.join(g, sized["source"].eqNullSafe(g["of"])).select("rid", "h", "g", "key", "size", "sid", "source_size", "groups", F.floor("rate").cast("int").alias("copies"), (F.col("rate") - F.floor("rate")).alias("x"))
    unit = F.struct(*_FIELDS).alias("u")
    asks = (F.col("size") > 0) & (F.col("x") > 0)
    long = F.col("size") * LONG > F.col("source_size")
    done = [joined.where(~asks).withColumn("x", F.lit(0.0)).select("sid", unit)]

    in_turn = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), uniform(seed, "long", "rid").alias("order"), unit)))  # fewer than LONG
    heads = joined.where(asks & long).groupBy("sid", "source_size", "x").agg(in_turn.alias("m"))
    heads = cut(heads.select("sid", _against_rest(F.transform("m", lambda m: m["u"]), F.col("source_size"), F.col("x"), f"{seed}long").alias("f")))
    led = heads.select("sid", F.explode("f.out").alias("u"))
    short = joined.where(asks & ~long).join(heads.select("sid", "f.rest"), "sid", "left").withColumn("x", F.coalesce("rest", "x"))
    rest = short.select("sid", "groups", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.col("groups")).alias("node"), unit)
    k = 0
    while True:
        members = F.sort_array(F.collect_list(F.struct(uniform(seed, F.lit(k), F.col("u.rid")).alias("order"), F.col("u").alias("u"))))
        folded = rest.groupBy("sid", "groups", "node").agg(_pivot(F.transform(members, lambda m: m["u"]), f"{seed}{k}").alias("units"))
        folded = cut(folded.select("sid", "groups", "node", F.explode("units").alias("u")))
        done.append(folded.where("u.x in (0.0, 1.0)").select("sid", "u"))
        rest = folded.where("u.x not in (0.0, 1.0)")
        if widest <= 1:
            break
        widest = -(-widest // FAN_IN)
        rest = rest.withColumn("groups", F.ceil(F.col("groups") / FAN_IN).cast("long")).withColumn("node", F.pmod("node", "groups"))
        k += 1
    done.append(led.where("u.x in (0.0, 1.0)"))
    # One document of each source is left at most.
    last = rest.select("sid", "u").unionByName(led.where("u.x not in (0.0, 1.0)"))
    drawn = F.when(uniform(seed, "root", F.col("u.rid")) < F.col("u.x"), 1.0).otherwise(0.0)
    out = last.select("sid", _with_x(F.col("u"), drawn).alias("u"))
    for part in done:
        out = out.unionByName(part)
    copies = (F.col("u.copies") + F.col("u.x").cast("int")).alias("copies")
    out = out.select("sid", "u.rid", "u.h", "u.g", "u.key", "u.size", copies).join(goal.select("sid", "source", "source_size", "target"), "sid")
    return out.select("rid", "h", "g", F.col("key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("rid")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row repeated as often as the mix takes it.

    Rows without words go, as they are taken no times; rows of null source or key are mixed like others. Of
    rows that agree in key, source and text one (the first by its other columns) is repeated for all, however
    long. An empty table stays empty, and no column's name can clash.
    """
    taken = _mixed(docs).groupBy("h", "g").agg(F.sum("copies").alias("copies")).where("copies > 0")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    held = docs.select(*content(F.col("doc_id"), F.col("source"), F.col("text")), others.alias("others"), F.struct("*").alias("row"))
    one = held.groupBy("h", "g").agg(F.min_by("row", "others").alias("row")).join(taken, ["h", "g"])
    few = one.where(F.col("copies") <= WIDE).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    wide = one.where(F.col("copies") > WIDE).select("row", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"), F.lit(WIDE))).alias("from")).repartition("row.doc_id", "from")
    wide = wide.select("row", F.explode(F.sequence("from", F.least(F.col("from") + WIDE - 1, "copies"))))
    return few.union(wide).select("row.*")
