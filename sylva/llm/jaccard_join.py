"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents of equal shingle sets are one. With shingles in one order (seldom ones first), two sets
that overlap in T shingles share L of those in their prefixes of size - T + L. A document takes
the L of LENGTHS for which the listed frequencies let expect the least cost; a pair needs as many
common prefix shingles, at places that its sizes allow, as the shorter of both lengthenings, before
its sets are compared. Pairs are met in two turns. First each prefix shingle's documents meet the one
among them whose shingles are the most frequent, so that a large group of near copies is joined in
about as many comparisons as it has members. Then all pairs meet on the prefix shingles that
still stand in two components, but for those within one, which can add nothing; these also need as many shingles in
both whole prefixes as their sizes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import at_most, chunks, components, cut, laid_out, mix, prefix_sums, row_ids, span_hashes, text_batches, turned, whole_rows, word_spans
from sylva.session import table

WORDS, PERCENT = 4, 85
#: By how much a prefix can be lengthened.
LENGTHS = (1, 2, 4, 8)
#: Rows of one prefix shingle that meet all others of it in one task.
HOT = 1_000
#: Shingles listed as frequent, at most; a place in the order and a cost, nothing else, depends on the list.
LISTED = 400_000
#: What comparing a candidate pair costs, in pair rows: most fall to a comparison of short prefixes.
COMPARING = 0.5
#: Bits of the filter for rows whose sets are compared: a bound on what is broadcast, not on rows.
FILTER = 1 << 24
CHUNK, SPAN = 1_000_000, 2_000_000
_A = np.uint64(0x9FB21C651E98DF25)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes, text by text and sorted within it, and where each text's start (and, last, the end)."""
    data, starts = laid_out([t.lower() for t in texts])
    begin, end = word_spans(data)
    of = np.searchsorted(starts, begin, side="right") - 1
    w = span_hashes(prefix_sums(data), begin, end)
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    h = np.zeros(len(w), np.uint64)
    left = (first + n)[of] - np.arange(len(w))  # words of the text from here on
    for k in range(words):
        some = np.flatnonzero(left > k)
        h[some] = (h[some] + w[some + k] + np.uint64(1)) * _A
    use = (left >= words) | ((n[of] < words) & (left == n[of]))
    h, of = mix(h[use]).view(np.int64), of[use]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _lists(values: np.ndarray, at: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind or pa.int64()))


def describe(docs: DataFrame, words: int) -> DataFrame:
    """rid, n and signature (two numbers) of each row; and, with rid null, shingles (s1) and how often (s2) a task met them more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "n", "s1", "s2"]

        def listed(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(h), pa.array(c, pa.int64())], names)

        parts, held_back = [], 0
        for held, texts in chunks(batches, CHUNK):
            h, at = shingles(texts, words)
            u = h.view(np.uint64)
            s1, s2 = (_sums(mix(u + np.uint64(k)), at).view(np.int64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(held["rid"], pa.int64()), pa.array(np.diff(at)), pa.array(s1), pa.array(s2)], names)
            parts.append(h)
            held_back += len(h)
            if held_back >= SPAN:
                yield listed(parts)
                parts, held_back = [], 0
        if parts:
            yield listed(parts)

    return docs.select("rid", "text").mapInArrow(run, "rid bigint, n bigint, s1 bigint, s2 bigint")


def prefixes(docs: DataFrame, listed: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """rid, n, extra (how far the prefix is lengthened), the mean frequency of the shingles, and the prefix's."""
    given = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = given.value
        for held, texts in chunks(batches, CHUNK):
            h, at = shingles(texts, words)
            if len(names):
                i = np.minimum(np.searchsorted(names, h), len(names) - 1)
                cost = np.where(names[i] == h, counts[i], 0)
            else:
                cost = np.zeros(len(h), np.int64)
            n = np.diff(at)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, cost, of))
            h, cost = h[order], cost[order]
            overlap = -(-n * percent // 100)
            total = np.concatenate([[0], np.cumsum(cost)])
            best, extra = np.full(len(n), np.inf), np.ones(len(n), np.int64)
            for k in LENGTHS:
                reads = (total[at[:-1] + np.minimum(n, n - overlap + k)] - total[at[:-1]]).astype(float)
                expected = np.where(k <= overlap, reads + COMPARING * reads / k, np.inf)
                better = expected < best
                best, extra = np.where(better, expected, best), np.where(better, k, extra)
            size = np.where(n > 0, n - overlap + extra, 0)
            keep = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(size, n)
            ends = np.concatenate([[0], np.cumsum(size)])
            central = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
            columns = [pa.array(held["rid"], pa.int64()), pa.array(n), pa.array(extra), pa.array(central), _lists(h[keep], ends)]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n", "extra", "central", "prefix"])

    return docs.select("rid", "text").mapInArrow(run, "rid bigint, n bigint, extra bigint, central double, prefix array<bigint>")


def shared_tokens(placed: DataFrame) -> DataFrame:
    """A row of rid, n, extra, central, pos and token for each prefix shingle of placed that stands in another prefix too; the others make no pair."""
    every = placed.select("rid", "n", "extra", "central", F.posexplode("prefix").alias("pos", "token"))
    twice = every.groupBy(turned("token").alias("t")).agg(F.count("*").alias("c")).where("c > 1")
    return cut(every.join(twice.select(turned("t").alias("token")), "token", "left_semi"))


def _both(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of a and b shingles need to link."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _matched(met: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of rows x and y met on a shingle that have as many common ones, at places that their sizes allow, as both lengthenings ask for."""
    x, y = F.col("x"), F.col("y")
    overlap, longer = _both(x["n"], y["n"], percent), F.least(x["extra"], y["extra"])
    fits = (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & (x["pos"] < x["n"] - overlap + longer) & (y["pos"] < y["n"] - overlap + longer)
    pair = met.where(fits).groupBy(x["rid"].alias("a"), y["rid"].alias("b")).agg(F.count("*").alias("c"), F.first(longer).alias("longer"))
    return pair.where("c >= longer").select("a", "b")


def sets(docs: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """rid and shingles of the rows named (column rid), and of a few more that a filter of FILTER bits lets through."""
    bit = F.pmod(F.xxhash64("rid"), F.lit(FILTER))
    words_of_bits = named.groupBy(F.shiftright(bit, 5).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("b")).toArrow()  # FILTER / 32 rows at most
    bits = np.zeros(FILTER // 32, np.uint32)
    bits[words_of_bits.column("w").to_numpy()] = words_of_bits.column("b").to_numpy()
    asked = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def through() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(1).to_numpy()
                keep = (asked.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
                if keep.any():
                    yield batch.filter(pa.array(keep))

        for held, texts in chunks(through(), CHUNK):
            h, at = shingles(texts, words)
            yield pa.RecordBatch.from_arrays([pa.array(held["rid"], pa.int64()), _lists(h, at)], ["rid", "shingles"])

    return docs.select("rid", bit.alias("bit"), "text").mapInArrow(run, "rid bigint, shingles array<bigint>")


def linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b of rids whose sets are near enough."""
    pairs = cut(pairs)
    named = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    held = cut(sets(docs, named, words))
    both = pairs.join(held.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"))


def group_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """rid, key, n_shingles, group (least rid of the component) and component_id (its least key) for each row of docs.

    Two rows link when 100 * intersection >= percent * union of their sets of distinct shingles. Texts
    of fewer words are one shingle; null texts and texts without words have none, link with nothing
    and are their own component. Very long texts are shingled whole. Repeated rows each get a row and
    link as equal sets. Null keys come last: a component of null keys only has a null id. Shingles
    of equal frequency go by their hash, so ties are the same on every run. An empty table gives an
    empty result; other columns are ignored. Shingles are told apart by 64-bit hashes, equal sets by
    their number and two sums.
    """
    docs = row_ids(text_batches(docs).select(F.col(key).alias("key"), "text"))
    described = cut(describe(docs, words))
    rows = described.where("rid is not null")
    one = cut(rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("rid")))
    often = at_most(described.where("rid is null").groupBy("s1").agg(F.sum("s2").alias("c")), LISTED).toArrow()  # LISTED rows at most
    h, c = often.column("s1").to_numpy(), often.column("c").to_numpy()
    order = np.argsort(h)
    placed = cut(prefixes(docs, (h[order], c[order]), words, percent).join(one.select("rid"), "rid", "left_semi"))
    tokens = shared_tokens(placed)
    chief = tokens.groupBy(turned("token").alias("t")).agg(F.max(F.struct("central", "rid", "n", "extra", "pos")).alias("y")).select(turned("t").alias("token"), "y")
    met = tokens.select("token", F.struct("rid", "n", "extra", "pos").alias("x")).join(chief, "token")
    found = components(linked(_matched(met.where("x.rid <> y.rid"), percent), docs, words, percent))
    tokens = tokens.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n", "extra", F.coalesce("label", "rid").alias("label"), "pos", "token")
    shared = tokens.groupBy(turned("token").alias("t")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c")).where("low <> high")
    shared = shared.select(turned("t").alias("token"), F.ceil(F.col("c") / HOT).cast("int").alias("parts"))
    live = cut(tokens.join(shared, "token"))
    # The smaller set of a pair overlaps the other by more than half of what both sizes ask for, so less of it needs to be looked up.
    here = live.where(F.col("pos") < F.col("n") - _both(F.col("n"), F.col("n"), percent) + F.col("extra"))
    row = F.struct("rid", "n", "extra", "pos", "label")
    here = here.select("token", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), row.alias("x"))
    there = live.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), row.alias("y"))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rid") < F.col("y.rid")))
    pair = _matched(here.join(there, ["token", "part"]).where((F.col("x.label") != F.col("y.label")) & smaller), percent)
    # Of two whole prefixes, the one that ends first misses common shingles in its own rest only, so the
    # common ones in both prefixes and the longer rest must reach the overlap.
    side = lambda k: placed.select(F.col("rid").alias(k), F.struct("n", "prefix").alias(f"p{k}"))
    pair = pair.join(side("a"), "a").join(side("b"), "b")
    rest = F.greatest(F.col("pa.n") - F.size("pa.prefix"), F.col("pb.n") - F.size("pb.prefix"))
    pair = pair.where(F.size(F.array_intersect("pa.prefix", "pb.prefix")) >= _both(F.col("pa.n"), F.col("pb.n"), percent) - rest)
    joined = linked(pair.select("a", "b"), docs, words, percent)
    # The second turn's links join components of the first by their labels.
    for k in ("a", "b"):
        joined = joined.join(found.select(F.col("node").alias(k), F.col("label").alias(f"{k}l")), k, "left").withColumn(k, F.coalesce(f"{k}l", k)).drop(f"{k}l")
    above = components(joined.where("a <> b"))
    nodes = found.union(above.select("node", F.col("node").alias("label")).join(found.select("node"), "node", "left_anti"))
    found = nodes.join(above.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))

    keyed = docs.select("rid", "key").join(rows.select("rid", "n", "s1", "s2"), "rid")
    final = one.select("n", "s1", "s2", F.col("rid").alias("node")).join(found, "node", "left").select("n", "s1", "s2", F.coalesce("label", "node").alias("found"))
    grouped = cut(keyed.join(final, ["n", "s1", "s2"], "left").select("rid", "key", "n", F.coalesce("found", "rid").alias("group")))
    ids = grouped.groupBy(turned("group").alias("t")).agg(F.min("key").alias("component_id")).select(turned("t").alias("group"), "component_id")
    return grouped.join(ids, "group").select("rid", F.col("key").alias(key), F.col("n").alias("n_shingles"), "group", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(table(spark, sf_dir, "documents")).drop("rid", "group")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group: that of the least key (null keys last), of equal ones that of the least hash of its text. The pipeline takes five words and 80 percent.

    Rows without words (null texts too) are groups of their own and stay; of repeated rows one stays, whatever
    their keys, so which text stays does not depend on files or partitions; very long texts are shingled whole;
    an empty table stays empty, and no column's name can clash.
    """
    order = row_ids(docs.select(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")).alias("order")))
    kept = group_documents(docs, words=5, percent=80).select("rid", "group").join(order, "rid").groupBy("group").agg(F.min_by("rid", "order").alias("rid")).select("rid")
    return whole_rows(docs).join(kept, "rid", "left_semi").select("row.*")
