"""Removal of long repeated byte strings, by suffix arrays over shards.

Every window of LENGTH bytes belongs to its anchor, the place of least hash among its short grams,
so that equal windows have equal anchors at equal distances. The windows of one anchor whose
distances fall in one step share a core of bytes; the core's hash names a group, and equal windows
are always in one group. Groups of one place only hold no repeats and go. The stretches of text
that the windows of the other groups cover, each distinct one once, are laid into shards, group by
group; induced sorting gives each shard's suffix array, and the permuted common prefixes tell which
windows repeat. A group of too many distinct stretches for one shard is dealt on by finer steps of
distance, whose cores are longer, down to one window to a stretch, where equal ones are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import chunks, cut, laid_out, mix, powers, prefix_sums, row_ids, span_hashes, text_batches, whole_rows, word_spans
from sylva.llm.induced import permuted_common_prefixes, suffix_array
from sylva.session import drop_written, table, tables_written

LENGTH = 400
#: Bytes of a gram, and of the distances that share a core: the first step, and those by which large groups are dealt on.
GRAM, REACHES = 20, (128, 16, 1)
#: Bytes of a shard, as whole groups, and the distinct stretches from which a group is too large for one. The stage's
#: shards are smaller, as its executors hold other stages' memory.
SHARD, STAGE_SHARD, WIDE = 1_200_000, 400_000, 500
CHUNK = 1_000_000
#: The stage removes repeated runs of so many words. A word is CODE bytes of its hash; one of over LONG bytes
#: (text without spaces) stands as it is, and a run with such words may also count by LENGTH bytes.
WORDS, CODE, LONG = 51, 4, 32
#: Runs of WORDS words meet at the one of their grams of so many words that has the least hash.
WORD_GRAM = 8


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of h[i:i+width] stands (the first, among equals), for each i."""
    n = len(h)
    code = (h & ~np.uint64((1 << 32) - 1)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = code
    grid = full.reshape(blocks, width)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & np.uint64((1 << 32) - 1)).astype(np.int64)


def stretches(texts: list[bytes], length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows and core's hash of each stretch: windows of one anchor and one step of distance."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    gram = min(GRAM, length)
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    owner = _least(span_hashes(sums, at, at + gram), length - gram + 1)
    s = np.arange(len(owner))
    of = np.searchsorted(starts, s, side="right") - 1
    whole = s + length <= starts[of + 1]
    far = length - gram
    step = (s - owner + far) // reach
    new = np.ones(len(s), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    count = np.add.reduceat(whole.astype(np.int64), first)  # windows past a text's end are last in their stretch
    keep = (count > 0) & whole[first]
    first, count = first[keep], count[keep]
    d = step[first] * reach
    base = owner[first] - far
    core = span_hashes(sums, base + np.minimum(d + reach - 1, far), base + d + length)
    return of[first], first - starts[of[first]], count, mix(core + d.astype(np.uint64) + np.uint64(1))


def word_stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, number of runs, gram's hash and 48 bits of the words' hash of each stretch: runs of WORDS words that have one least gram.

    Last come all runs' hashes, stretch by stretch. White space between words does not count.
    """
    data, starts = laid_out(texts)
    a, b = word_spans(data)
    n = len(a) - WORDS + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 3
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(span_hashes(prefix_sums(data), a, b) * powers(len(a)), out=sums[1:])
    at = np.arange(len(a) - WORD_GRAM + 1)
    grams = span_hashes(sums, at, at + WORD_GRAM)
    owner = _least(grams, WORDS - WORD_GRAM + 1)
    of = np.searchsorted(starts, a, side="right") - 1
    s = np.flatnonzero(of[:n] == of[WORDS - 1 :])  # within one text
    if not len(s):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 3
    new = np.ones(len(s), bool)
    new[1:] = (owner[s[1:]] != owner[s[:-1]]) | (of[s[1:]] != of[s[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    first = s[first]
    words = span_hashes(sums, first, first + count + WORDS - 1) >> np.uint64(16)
    return of[first], count, grams[owner[first]], words, span_hashes(sums, s, s + WORDS)


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each stretch of bytes, whether each window stands anywhere else in any of them."""
    sizes = np.array([len(p) for p in parts])
    t = np.ones(int(sizes.sum()) + len(parts) + 1, np.uint16)  # 1 parts them, 0 ends all
    at = np.cumsum(sizes + 1) - sizes - 1
    for p, a in zip(parts, at.tolist(), strict=True):
        t[a : a + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    shared = permuted_common_prefixes(t, sa) >= length
    # The parting symbol may lie within a common prefix, but not within the first length symbols of a window.
    repeated = shared.copy()
    repeated[sa[:-1][shared[sa[1:]]]] = True
    return [repeated[a : a + n - length + 1] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return turns[::2].tolist(), turns[1::2].tolist()


_RUNS = pa.list_(pa.int32())


_OWN = ["grp", "h1", "h2"]
_FOUND = "grp bigint, h1 bigint, h2 bigint, a array<int>, b array<int>"


def _digest(part: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(part, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _repeats(distinct: DataFrame, length: int, most: int, level: int = 0) -> DataFrame:
    """grp, h1, h2, a and b (first repeated windows, and those past the last) of the rows of distinct
    (grp, h1, h2, c: places, n: distinct ones of its group, bytes) that have any; shards have about most bytes."""
    # A stretch alone in its group has no other to be sorted with; at several places, all of it repeats.
    windows_of = F.array((F.length("bytes") - length + 1).cast("int"))
    alone = distinct.where("n = 1 and c > 1").select(*_OWN, F.array(F.lit(0)).alias("a"), windows_of.alias("b"))
    last = level == len(REACHES) - 1  # one window to a stretch: all of a group are one
    if last:
        return alone

    def sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (g, h1, h2, c, b), flags in zip(rows, repeated_windows([r[4] for r in rows], length), strict=True):
                out.append((g, h1, h2, *_runs(np.ones(len(flags), bool) if c > 1 else flags)))
            return _batch(out, dict.fromkeys(_OWN, pa.int64()) | {"a": _RUNS, "b": _RUNS})

        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and size >= most and r[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield shard(rows)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sorting is long for its bytes: no merging of small ones
    narrow = distinct.where((F.col("n") > 1) & (F.col("n") <= WIDE)).select(*_OWN, "c", "bytes").repartition(parts, "grp").sortWithinPartitions("grp")
    found = narrow.mapInArrow(sorted_shards, _FOUND).unionByName(alone)
    wide = distinct.where(F.col("n") > WIDE)
    if wide.isEmpty():
        return found

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("grp", "h1", "h2", "ogrp", "oh1", "oh2", "c"), pa.int64()) | {"first": pa.int32(), "bytes": pa.binary()}
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            for start in range(0, len(rows), 200):
                some, out = rows[start : start + 200], []
                of, first, count, group = stretches([r[4] for r in some], length, REACHES[level + 1])
                for k, f, n, g in zip(of.tolist(), first.tolist(), count.tolist(), group.view(np.int64).tolist(), strict=True):
                    part = some[k][4][f : f + n + length - 1]
                    out.append((g, *_digest(part), *some[k][:4], f, part))
                yield _batch(out, kinds)

    schema = "grp bigint, h1 bigint, h2 bigint, ogrp bigint, oh1 bigint, oh2 bigint, c bigint, first int, bytes binary"
    dealt = cut(wide.select(*_OWN, "c", "bytes").mapInArrow(finer, schema))
    below = _repeats(_distinct(dealt, F.sum("c")), length, most, level + 1)
    back = dealt.drop("bytes", "c").join(below, _OWN)
    moved = lambda k: F.flatten(F.collect_list(F.transform(k, lambda x: x + F.col("first")))).alias(k)  # noqa: E731  no more than a stretch has windows
    back = back.groupBy(F.col("ogrp").alias("grp"), F.col("oh1").alias("h1"), F.col("oh2").alias("h2")).agg(moved("a"), moved("b"))
    return found.unionByName(back)


def _distinct(placed: DataFrame, places) -> DataFrame:
    """Distinct stretches (grp, h1, h2, bytes) of placed, c by places, and n, how many their group has.

    Sizes are joined before rows are grouped, so that the join can split a large group.
    """
    sizes = cut(placed.groupBy(*_OWN).agg(F.lit(1).alias("one")).groupBy("grp").agg(F.count("*").alias("n")))
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(1))  # noqa: E731  another key than the join's: else rows are grouped where they were joined, and no join is split
    rows = placed.join(sizes, "grp").groupBy(turned("grp").alias("g"), "h1", "h2").agg(places.alias("c"), F.first("n").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"))
    return cut(rows.select(turned("g").alias("grp"), "h1", "h2", "c", "n", "bytes"))


def _word_marks(spots: DataFrame) -> DataFrame:
    """rid, sure and grams of rows of spots (rid, grp, words): a row is sure to have a repeated run of WORDS words where all
    stretches of a gram, two or more, are equal; the grams of other rows whose stretches differ are those to be compared."""
    least = spots.groupBy("grp").agg(F.count("*").alias("c"), F.min("words").alias("lo"), F.max("words").alias("hi"))
    same = cut(least.where("c > 1").select("grp", F.expr("lo = hi").alias("same")))  # written, so that the join can split a large group
    met = cut(spots.select("rid", "grp").join(same, "grp"))
    sure = met.where("same").select("rid").distinct()
    mixed = met.where("not same").select("rid", "grp")
    asked = cut(mixed.join(sure, "rid", "left_anti").select("grp").distinct())
    grams = mixed.join(asked, "grp").groupBy("rid").agg(F.collect_set("grp").alias("grams"))  # no more than the text has runs
    return sure.select("rid", F.lit(True).alias("sure")).join(grams, "rid", "full")


def removed_runs(docs: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """rid and runs (array of start, end in bytes, neither sorted nor joined) of each row with repeats.

    With words also worded, true in rows of which a run of WORDS words also starts anywhere else; either may be null.
    """
    spark, before = docs.sparkSession, len(tables_written(docs.sparkSession))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "grp", "first", "count", "words"]
        for held, texts in chunks(batches, CHUNK):
            rid = np.array(held["rid"], np.int64)
            of, first, count, group = stretches(texts, length, REACHES[0])
            yield pa.RecordBatch.from_arrays([pa.array(rid[of]), pa.array(group.view(np.int64)), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.nulls(len(of), pa.int64())], names)
            if words:
                of, _, group, digest, _ = word_stretches(texts)
                none = pa.nulls(len(of), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(rid[of]), pa.array(group.view(np.int64)), none, none, pa.array(digest.view(np.int64))], names)

    named_at = cut(docs.mapInArrow(named, "rid bigint, grp bigint, first int, count int, words bigint"))
    places = named_at.where("words is null").drop("words")
    alive = cut(places.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp"))  # written, so that the join can split a large group
    marked = places.join(alive, "grp").groupBy("rid").agg(F.collect_list(F.struct("grp", "first", "count")).alias("at"))  # no more than the text has windows
    if words:
        marked = marked.join(_word_marks(named_at.where("words is not null").select("rid", "grp", "words")), "rid", "full")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("rid", *_OWN), pa.int64()) | {"first": pa.int32(), "count": pa.int32(), "bytes": pa.binary(), "runs": pa.list_(pa.int64())}
        seen, rows = set(), []
        for held, texts in chunks(batches, CHUNK):
            for rid, at, text in zip(held["rid"], held["at"], texts, strict=True):
                for x in at or ():
                    part = text[x["first"] : x["first"] + x["count"] + length - 1]
                    d = _digest(part)
                    rows.append((rid, x["grp"], *d, x["first"], x["count"], None if d in seen else part, None))
                    seen.add(d)
                if len(seen) > 200_000:
                    seen.clear()
                if len(rows) > 5_000:
                    yield _batch(rows, kinds)
                    rows = []
            if words:
                rows += [(rid, *[None] * 6, []) for rid, sure in zip(held["rid"], held["sure"], strict=True) if sure]
                asked = [(k, set(g)) for k, g in enumerate(held["grams"]) if g]
                of, count, group, _, hashes = word_stretches([texts[k] for k, _ in asked])
                ends = np.cumsum(count)
                for k, n, end, g in zip(of.tolist(), count.tolist(), ends.tolist(), group.view(np.int64).tolist(), strict=True):
                    if g in asked[k][1]:
                        rows.append((held["rid"][asked[k][0]], g, *[None] * 5, hashes[end - n : end].view(np.int64)))
        if rows:
            yield _batch(rows, kinds)

    placed = cut(docs.join(marked, "rid").mapInArrow(laid, "rid bigint, grp bigint, h1 bigint, h2 bigint, first int, count int, bytes binary, runs array<bigint>"))
    drop_written(spark, before, keep=1)
    by_words = placed.where("runs is not null").select("rid", "grp", "runs")
    placed = placed.where("runs is null").drop("runs")
    found = cut(_repeats(_distinct(placed, F.count("*")), length, SHARD if words else STAGE_SHARD).where(F.size("a") > 0))
    spans = F.arrays_zip("a", "b")
    runs = placed.select("rid", *_OWN, "first").join(found, _OWN)
    runs = runs.select("rid", F.transform(spans, lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] - 1 + length).alias("b"))).alias("runs"))
    runs = runs.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # no more than the text has windows
    if words:
        hashes = by_words.select("rid", "grp", F.explode("runs").alias("h"))
        twice = cut(hashes.groupBy("grp", "h").agg(F.count("*").alias("c")).where("c > 1").select("grp", "h"))
        worded = hashes.join(twice, ["grp", "h"]).select("rid").union(by_words.where("size(runs) = 0").select("rid")).distinct()
        runs = runs.join(worded.withColumn("worded", F.lit(True)), "rid", "full")
    return cut(runs)


def _kept(text: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """What stays, the bytes removed and the number of joined runs."""
    if not runs:
        return text, 0, 0
    spans = np.array(sorted((r["a"], r["b"]) for r in runs))
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    a, b = spans[new, 0], reach[np.concatenate([new[1:], [True]])]
    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), int((b - a).sum()), len(a)


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """rid, key, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether the row lost bytes) and repeats_words of each row of docs; with_text adds the text that stays.

    repeats_words says whether a run of WORDS words of the row also starts anywhere else, whatever its bytes and white
    space: most such runs are shorter than length and stay.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in any text.
    Null and empty texts have no bytes and lose none; in the text returned null is empty. Very long
    texts are judged whole. All copies of a repeated string go, so repeated rows of length bytes or more
    lose everything, and ties need no order. Null keys stay null. An empty table gives an empty result;
    other columns are ignored. Text cut within a character loses its loose bytes.
    """
    keyed = row_ids(text_batches(docs).select(F.col(key).alias("key"), "text"))
    runs = removed_runs(keyed.select("rid", "text"), length, words=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in chunks(batches, CHUNK):
            rows = [_kept(t, r) for t, r in zip(texts, held["runs"], strict=True)]
            out = [pa.array(held[k], pa.int64()) for k in ("rid", "key")]
            out += [pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            out += [pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows]), pa.array([r[1] > 0 for r in rows]), pa.array([bool(w) for w in held["worded"]])]
            yield pa.RecordBatch.from_arrays(out + [pa.array([r[0].decode("utf-8", "ignore") for r in rows])] * with_text, names)

    names = ["rid", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "repeats_words"] + ["text"] * with_text
    schema = "rid bigint, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, repeats boolean, repeats_words boolean" + ", text string" * with_text
    rows = keyed.select("rid", F.col("key").cast("long").alias("key"), "text").join(runs, "rid", "left")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("rid")


def coded(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Texts in words' codes: start, end and word of each unit (a word, or a byte of a long one) in the texts laid out,
    each unit's place in the codes (and, last, the end), each text's first unit (and, last, their number), and the codes."""
    data, starts = laid_out(texts)
    a, b = word_spans(data)
    long = b - a > LONG
    n = np.where(long, b - a, 1)
    word = np.repeat(np.arange(len(a)), n)
    ua = a[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    raw = long[word]
    ub = np.where(raw, ua + 1, b[word])
    at = np.concatenate([[0], np.cumsum(np.where(raw, 1, CODE))])
    out = np.empty(at[-1], np.uint8)
    out[at[:-1][raw]] = data[ua[raw]]
    h = span_hashes(prefix_sums(data), a[~long], b[~long])
    out[at[:-1][~raw][:, None] + np.arange(CODE)] = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
    return ua, ub, word, at, np.searchsorted(ua, starts), out


def without_repeats(docs: DataFrame) -> DataFrame:
    """rid and text (what stays) of each row of docs (rid, text) that loses something.

    A word goes if a run of WORDS words that covers it also starts anywhere else, in any text; white space
    between words does not count, and goes with the words around it. What lies in long words goes with LENGTH bytes.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in chunks(batches, CHUNK):
            *_, at, first, out = coded(texts)
            ends = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(held["rid"], pa.int64()), pa.array([out[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["rid", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in chunks(batches, CHUNK):
            ua, ub, word, at, first, _ = coded(texts)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            rids, out = [], []
            for k, (rid, text, runs) in enumerate(zip(held["rid"], texts, held["runs"], strict=True)):
                spans = np.array([(r["a"], r["b"]) for r in runs]) + at[first[k]]
                u, v = np.searchsorted(at, spans[:, 0]), np.searchsorted(at, spans[:, 1], side="right") - 1  # whole units
                whole = at[v] - at[u] >= WORDS * CODE
                u, v = u[whole], v[whole]
                if not len(u):
                    continue
                order = np.argsort(u)
                u, reach = u[order], np.maximum.accumulate(v[order])
                new = np.concatenate([[True], u[1:] > reach[:-1]])
                u, v = u[new], reach[np.concatenate([new[1:], [True]])] - 1
                gone = (word[v] - word[u] + 1 >= WORDS) | (ub[v] - ua[u] >= LENGTH)
                if gone.any():
                    edges = [0, *(np.stack([ua[u[gone]], ub[v[gone]]], 1).ravel() - starts[k]).tolist(), len(text)]
                    rids.append(rid)
                    out.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(out, pa.string())], ["rid", "text"])

    runs = removed_runs(docs.mapInArrow(encoded, "rid bigint, text binary"), WORDS * CODE)
    return docs.join(runs, "rid").mapInArrow(run, "rid bigint, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated runs of over 50 words removed from their texts; rows whose whole text repeats stay, with an empty text.

    All copies of a run go, repeated rows' too, so ties need no order. Null and empty texts stay as they are, very
    long ones are read whole, null keys and equal ids are rows like others, an empty table stays empty, and no
    column's name can clash.
    """
    kept = without_repeats(row_ids(text_batches(docs).select("text"))).withColumnRenamed("text", "kept")
    joined = whole_rows(docs).join(kept, "rid", "left")
    return joined.select(*[F.coalesce("kept", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
