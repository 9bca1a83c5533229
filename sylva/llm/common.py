"""What several operators share: whole-row keys, cut lineage, code-point rules and hashing of bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.session import written as cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but these bytes; the same set splits Python's bytes.split().
SPACE = "\\x20\\x09-\\x0D"


#: Rows with whole texts that go to Python at once, where the session doesn't say otherwise; Spark's own 10,000 hold tens of MB on either side.
BATCH_ROWS = "2000"


def text_batches(docs: DataFrame) -> DataFrame:
    """docs, of which tasks give BATCH_ROWS rows to Python at once, so that texts fill little memory beside a task's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name, None) is None:
        docs.sparkSession.conf.set(name, BATCH_ROWS)
    return docs


def row_ids(df: DataFrame, name: str = "rid") -> DataFrame:
    """A key for each row, equal on every read of the same files, so repeated rows stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


def whole_rows(df: DataFrame) -> DataFrame:
    """rid and the row itself as one column, so that no other name can clash."""
    return df.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few given rows, as literals of the plan."""
    names = [f.split()[0] for f in schema.split(", ")]
    one = lambda r: F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(f.split()[1]).alias(n) for v, f, n in zip(r, schema.split(", "), names, strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(one, rows))))


def turned(c: Column | str) -> Column:
    """A whole number as another one and back: rows grouped by it are dealt again for a join on the number, which can so split a large group."""
    return (F.col(c) if isinstance(c, str) else c).bitwiseXOR(F.lit(1))


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    bits = F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo a number; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(of)), F.lit(-1))


def at_most(counts: DataFrame, most: int, value: str = "c") -> DataFrame:
    """The rows of the greatest values, never more than most: those above a threshold set from a histogram."""
    step = F.floor(F.log2(value) * 16).cast("int")
    bins = sorted(counts.groupBy(step.alias("b")).count().collect(), reverse=True)  # a row for each sixteenth of a power of two
    total, least = 0, None
    for b, n in bins:
        total += n
        if total > most:
            break
        least = b
    return counts.where(step >= least) if least is not None else counts.limit(0)


def components(edges: DataFrame) -> DataFrame:
    """node and label (its component's least node) for each node of the edges a, b.

    Each round takes the least label next to a node and then follows labels one step further, so
    long chains close quickly. Sums over a node's edges are combined before the shuffle.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = cut(step.join(far, "label", "left").select("node", "old", F.least("label", "far").alias("label")))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def give_back() -> None:
    """Free memory goes back to the system, so that workers which wait for their next task hold little of it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than glibc keeps what it wants
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_REMEMBERED: list = []


def remembered(f: Callable) -> Callable:
    """f, whose results a worker keeps for all its tasks, until a task of another operator begins in it (forget): workers outlive stages and jobs."""
    _REMEMBERED.append(held := cache(f))
    return held


def forget() -> None:
    """What a worker remembers for other operators' tasks goes."""
    if any(f.cache_info().currsize for f in _REMEMBERED):
        for f in _REMEMBERED:
            f.cache_clear()
        give_back()


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Other columns and UTF-8 texts (column text; null is empty), about so many bytes at once."""
    forget()
    held, texts, size = {}, [], 0
    for batch in batches:
        names = batch.schema.names
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n != "text"}
        for k, t in enumerate(batch.column(names.index("text"))):
            b = t.as_buffer()
            texts.append(b.to_pybytes() if b is not None else b"")
            for n, v in columns.items():
                held.setdefault(n, []).append(v[k])
            size += len(texts[-1])
            if size >= most:
                yield held, texts
                held, texts, size = {}, [], 0
        del batch, columns
        pa.default_memory_pool().release_unused()
    if texts:
        yield held, texts
        del held, texts
    give_back()


# ---------------------------------------------------------------- bytes in numpy

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, which: str = "up") -> np.ndarray:
    """BASE**i (or its inverse) mod 2**64 for i < n."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 20, 2 * len(have) if have is not None else 0)
        out = np.full(size, BASE if which == "up" else INVERSE, dtype=np.uint64)
        out[0] = 1
        _POWERS[which] = have = np.multiply.accumulate(out)
    return have[:n]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers, from which any substring's hash follows."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), "down")[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array with a space after each, and where each starts (and, last, the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts
