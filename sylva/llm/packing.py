"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Tasks count tokens and cut long documents into pieces. A sequence's worth of lengths is all that the plan
needs: from the longest down, all pieces of a length at once go to the open sequences with the least room
that is enough. The plan is a table of slots: so many places of a length, in which sequences, and where.
Pieces then take slots by their rank within their length. Ranks come from running counts of each task's
pieces by length, so neither pieces of one length nor all lengths ever meet in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import cut
from sylva.llm.units import encoder, text_chunks
from sylva.session import table

VOCABULARY = "byte_bpe_50k.json"
#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 1024, 2
#: Code points of text handled at once; a bound on memory, not on texts.
CHUNK = 8_000_000
SLOTS = pa.schema([(n, pa.int64()) for n in ("length", "first", "n", "sequence", "per", "at")])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first, n, sequence, per, at) for so many pieces of each length.

    Pieces of ranks first to first + n - 1 within their length go into the sequences from sequence on, per
    of them into each, the first at offset at. Best-fit decreasing: a piece goes where the least room is
    left over, and only if none has room into a new sequence. Their number is bounded by the capacity alone.
    """
    slots, opened = [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs of sequences by the room that each has

    def fill(length: int, rank: int, sequence: int, n: int, left: int, each: int) -> None:
        slots.append((length, rank, n * each, sequence, each, capacity - left))
        if left > each * length:
            room[left - each * length].append((sequence, n))

    for length in range(capacity, 0, -1):
        todo, rank = counts.get(length, 0), 0
        while todo:
            left = next((r for r in range(length, capacity) if room[r]), capacity)
            each = left // length
            if left < capacity:
                sequence, have = room[left].pop()
            else:
                sequence, have = opened, -(-todo // each)
                opened += have
            whole = min(have, todo // each)
            if whole:
                fill(length, rank, sequence, whole, left, each)
                todo, rank = todo - whole * each, rank + whole * each
            if todo and whole < have:
                fill(length, rank, sequence + whole, 1, left, todo)
                todo, whole = 0, whole + 1
            if whole < have:
                room[left].append((sequence + whole, have - whole))
    return slots


def cut_pieces(docs: DataFrame, path: str | None = None, key: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, part and place for each piece of each row of docs.

    part is the task that made the piece, place its rank among that task's pieces of its length.
    with_ids adds the piece's ids.
    """
    path = path or default_path()
    names = ["key", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, placed = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for keys, texts in text_chunks(batches, CHUNK):
            rows = []
            for k, own in zip(keys, encoder(path).encode(texts), strict=True):
                own = np.append(own, np.uint32(end)).astype("<u4")
                stop = (len(own) - 1) % capacity + 1  # all pieces but the first are whole
                for piece, last in enumerate(range(stop, len(own) + 1, capacity)):
                    start = max(last - capacity, 0)
                    row = (k, piece, start, last - start, zlib.crc32(own[start:last]), part, int(placed[last - start]))
                    rows.append((*row, own[start:last].astype(np.int32)) if with_ids else row)
                    placed[last - start] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset for each piece of each row of docs (and ids, if asked).

    Null and empty texts are one token, the end. Texts of more than a sequence, however long, become
    pieces of the whole capacity but for the first. Repeated rows and null keys are packed like others;
    pieces of equal length go in the order of their tasks. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, path, key, capacity, end, with_ids))
    runs = pieces.groupBy("part", "length").agg(F.count("*").alias("have"))
    before = F.coalesce(F.sum("have").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("part", "length", "have", before.alias("before")))  # a row for each task and length
    counts = {r.length: r.n for r in runs.groupBy("length").agg(F.sum("have").alias("n")).collect()}  # capacity rows at most
    slots = plan(counts, capacity)
    planned = spark.createDataFrame(pa.table([pa.array([s[i] for s in slots], pa.int64()) for i in range(len(SLOTS))], SLOTS))
    low, high = F.greatest(F.col("first"), F.col("before")), F.least(F.col("first") + F.col("n"), F.col("before") + F.col("have"))
    met = runs.join(F.broadcast(planned), "length").where(low < high)  # the plan's size follows the capacity, not the pieces
    met = met.select("part", "length", "before", "first", "sequence", "per", "at", low.alias("low"), high.alias("high"))
    rank, nth = F.col("before") + F.col("place"), F.col("before") + F.col("place") - F.col("first")
    taken = pieces.join(met, ["part", "length"]).where((rank >= F.col("low")) & (rank < F.col("high")))
    sequence, offset = F.col("sequence") + F.floor(nth / F.col("per")), F.col("at") + nth % F.col("per") * F.col("length")
    out = [F.col("key").alias(key), "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset")]
    return taken.select(*out, *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
