"""Document fingerprints by context-triggered piecewise hashing.

A hash over the last seven bytes ends a piece wherever it hits a multiple of the block size; each
piece gives one character of a signature. The block size follows the text's length, and a second
signature is made at twice the size, so that fingerprints of texts of up to twice the length stay
comparable. Likeness is one less the edit distance of signatures of equal block size, by length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import mix, prefix_sums, span_hashes
from sylva.session import table

#: Bytes that a boundary depends on, the least block size, and the longest signature.
WINDOW, LEAST, LONGEST = 7, 3, 64
#: The characters of a signature.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Fingerprints compared at once.
ROWS = 512


def triggers(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the WINDOW - 1 before it."""
    x = data.astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(x), np.uint32)
    for k in range(min(WINDOW, len(x))):
        h[k:] += x[: len(x) - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def signature(h: np.ndarray, sums: np.ndarray, size: int) -> bytes:
    """A character for each piece; pieces past the last place share that place."""
    ends = np.flatnonzero(h % np.uint32(size) == size - 1) + 1
    if len(ends) >= LONGEST:
        ends = ends[: LONGEST - 1]
    if not len(ends) or ends[-1] < len(h):
        ends = np.append(ends, len(h))
    starts = np.concatenate([[0], ends[:-1]])
    return ALPHABET[(span_hashes(sums, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(text: bytes) -> str:
    """block size : signature : signature at twice the block size; equal for equal texts."""
    if not text:
        return f"{LEAST}::"
    data = np.frombuffer(text, np.uint8)
    h, sums = triggers(data), prefix_sums(data)
    size = LEAST
    while size * LONGEST < len(data):
        size *= 2
    one = signature(h, sums, size)
    while size > LEAST and len(one) < LONGEST // 2:
        size //= 2
        one = signature(h, sums, size)
    return f"{size}:{one.decode()}:{signature(h, sums, 2 * size).decode()}"


def _distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distance (insert, delete, replace) of each a to each b, row by row for all at once."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.maximum(n, m)
    if not len(a) or not n.max() or not m.max():
        return out
    x, y = np.zeros((n.max(), len(a)), np.uint8), np.zeros((m.max(), len(b)), np.uint8)
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x[: len(s), i], y[: len(t), i] = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
    above = np.repeat(np.arange(len(y) + 1, dtype=np.int16)[:, None], len(a), 1)
    each = np.arange(len(a))
    steps = np.arange(len(y) + 1, dtype=np.int16)[:, None]
    for i in range(len(x)):
        row = np.empty_like(above)
        row[0] = i + 1
        np.minimum(above[1:] + 1, above[:-1] + (y != x[i]), out=row[1:])
        row = np.minimum.accumulate(row - steps, axis=0) + steps  # insertions from the left
        at = n == i + 1
        out[at] = row[m[at], each[at]]
        above = row
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """From 0 (no compatible block size, or nothing alike) to 1 (equal) for each pair of fingerprints."""
    out = np.zeros(len(a))
    left, right, of = [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        if p == q:
            out[i] = 1.0
            continue
        (s, p1, p2), (t, q1, q2) = p.split(":"), q.split(":")
        s, t = int(s), int(t)
        for x, y in [(p1, q1), (p2, q2)] if s == t else [(p2, q1)] if 2 * s == t else [(p1, q2)] if s == 2 * t else []:
            left.append(x.encode())
            right.append(y.encode())
            of.append(i)
    for start in range(0, len(of), ROWS):
        x, y, at = left[start : start + ROWS], right[start : start + ROWS], of[start : start + ROWS]
        longest = np.array([max(len(s), len(t), 1) for s, t in zip(x, y, strict=True)])
        np.maximum.at(out, at, 1 - _distances(x, y) / longest)
    return out


def _places(quantiles: list[int], rows: int, nulls: int, parts: int) -> tuple[np.ndarray, ...]:
    """Distinct quantiles from the greatest, the first place of the keys above each (and, last, of null keys), places of each one's own rows, and places of null keys.

    A key that is several quantiles has as many places of its own, after those of the keys above it.
    """
    cuts, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    cuts, own = cuts[::-1], np.where(times > 1, times, 0)[::-1]
    first = np.concatenate([[0], np.cumsum(1 + own)])
    return cuts, np.append(first, first[-1] + 1), own, np.array(max(1, -(-nulls * parts // max(rows, 1))))


def in_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """place, ahead, key and text, dealt so that each place (a range of keys, and a task) also gets the row that follows its last, marked ahead.

    Ranges end at quantiles of the keys, as many as there are shuffle partitions. Rows go by descending
    key, nulls last, rows of one key by a draw from their places in the files; the first row also
    follows the last. Rows of one key are split by the draw where they fill more than a range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("key"), "text", F.xxhash64(F.monotonically_increasing_id()).alias("draw"))
    r = docs.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q"), F.count("*").alias("n"), F.count("key").alias("k")).first()
    cuts, first, own, of_null = _places(r.q or [], r.n, r.n - r.k, parts)

    @F.pandas_udf("int")
    def place_of(keys: pd.Series, none: pd.Series, draws: pd.Series) -> pd.Series:
        draw = 1.0 - (draws.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5)  # greater draws come first
        draw = np.clip(draw, 0.0, 1.0 - 2.0**-40)
        k = keys.to_numpy(np.int64)
        at = len(cuts) - np.searchsorted(cuts[::-1], k, side="right")  # cuts above the key
        mine = np.minimum(at, max(len(cuts) - 1, 0))
        n = np.where((at < len(cuts)) & (cuts[mine] == k), own[mine], 0) if len(cuts) else np.zeros(len(k), np.int64)
        out = first[at] + np.where(n > 0, 1 + (draw * n).astype(np.int64), 0)
        return pd.Series(np.where(none, first[len(cuts) + 1] + (draw * of_null).astype(np.int64), out).astype(np.int32))

    place = place_of.asNondeterministic()(F.coalesce("key", F.lit(0)), F.col("key").isNull(), F.col("draw"))  # else it is computed again for the join's filter
    placed = docs.withColumn("place", place)
    heads = placed.groupBy("place").agg(F.max(F.struct("key", "draw")).alias("head"))
    by_place = Window.orderBy("place")  # a row for each place
    last = F.max("place").over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("place", F.col("head.draw").alias("head"), F.coalesce(F.lag("place").over(by_place), last).alias("before"))
    marked = placed.join(F.broadcast(heads), "place")  # places at most
    goes = F.array(F.struct(F.col("place").alias("place"), F.lit(False).alias("ahead")))
    extra = F.array(F.struct(F.col("before").alias("place"), F.lit(True).alias("ahead")))
    out = marked.select("key", "text", "draw", F.explode(F.when(F.col("draw") == F.col("head"), F.concat(goes, extra)).otherwise(goes)).alias("to")).select("to.*", "key", "text", "draw")
    every = int(first[len(cuts) + 1]) + int(of_null)
    return out.repartitionById(every, F.col("place")).sortWithinPartitions("place", "ahead", F.desc_nulls_last("key"), F.desc("draw"))


def fingerprint_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next row's. Null text counts as empty; rows of equal keys follow each other in an order
    drawn from their places in the files; very long texts are hashed and edited whole; a single row follows itself; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            last = None
            for batch in batches:
                for place, ahead, k, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    now = (place, ahead, k, t or "")
                    if last is not None and last[0] == place and not last[1]:
                        yield *last[2:], now[3]
                    last = now

        rows, prints = [], {}

        def printed(text: str) -> str:
            if (p := prints.get(text)) is None:
                p = prints[text] = fingerprint(text.encode())
            return p

        def flush() -> pa.RecordBatch:
            keys, n, sha, own, edited, following = zip(*rows, strict=True)
            data = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(own), pa.array(edited)]
            return pa.RecordBatch.from_arrays([*data, pa.array(likeness(own, edited)), pa.array(likeness(own, following))], names)

        for k, t, following in pairs():
            n = len(t)
            edited = t[: n - n // 3] + following[: n // 3]
            own, after = printed(t), printed(following)
            changed = edited.encode()
            rows.append((k, n, hashlib.sha256(changed).hexdigest(), own, fingerprint(changed), after))
            prints = {t: own, following: after}
            if len(rows) == ROWS:
                yield flush()
                rows = []
        if rows:
            yield flush()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = in_order(docs, key).select("place", "ahead", "key", "text")
    return ordered.mapInArrow(run, schema).withColumnRenamed("doc_id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_texts(table(spark, sf_dir, "documents"))
