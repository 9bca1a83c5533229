"""Alignment of two tokenizers over a corpus.

Both encode a text to the same bytes; where tokens of both end, the text falls into groups, and each
token of one is linked with each of the other in its group. Links are packed into 64 bits. Tasks count
the documents of each pair by np.unique; the partial counts are dealt by ranges of pairs and sorted, runs
of a pair are summed, and each range becomes a shard, an array file in the shared folder. The same pass writes
each text's different links, packed; a second one reads them instead of the texts, maps the shards into memory
and finds its pairs by searchsorted, so that neither counts nor links are shuffled to documents. A unit's tokens,
groups and links are made once in a task.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import cut, text_batches
from sylva.llm.units import AT_ONCE, Remembered, Spaced, byte_bpe, gathered, parts, text_chunks
from sylva.session import shared_dir, table, tables_written

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points of text handled at once, and different pairs that a task counts before it gives them on.
CHUNK, PAIRS = 2_000_000, 1_000_000
#: Units, and their pairs, that a worker remembers from chunk to chunk.
REMEMBERED, KEYS = 250_000, 2_500_000
#: Links of a group beyond which it is counted by different tokens instead of one by one.
LARGE = 1 << 16
SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A), public_tokenizers.path(B)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = byte_bpe(a, special_as_text=True), sentencepiece.SentencePieceProcessor(model_file=b)
        self.spaced = Spaced(self.a)
        letters = _byte_of_letter()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [b""] * (self.a.get_vocab_size() + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = special.get(i) or bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(t) for t in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character, so texts can't be cut before spaces")

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of space+word by each tokenizer, one word after the other, how many each has, and whether both give back its bytes; others have none."""
        ids_a, n_a = self.spaced.encode(words)
        of_b = self.b.encode(words, num_threads=1)
        ids_b, n_b = np.fromiter(chain.from_iterable(of_b), np.int64), np.fromiter(map(len, of_b), np.int64)
        ids_a, texts = ids_a.astype(np.int64), [b" " + w.encode() for w in words]
        equal = np.fromiter(map(len, texts), np.int64)
        equal = (_sums(self.length_a[ids_a], n_a) == equal) & (_sums(self.length_b[ids_b], n_b) == equal)
        whole = b"".join(texts)
        if equal.all() and all(b"".join(map(of.__getitem__, ids.tolist())) == whole for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            return ids_a, n_a, ids_b, n_b, equal
        for of, ids, n in ((self.bytes_a, ids_a, n_a), (self.bytes_b, ids_b, n_b)):
            ends = np.cumsum(n)
            equal &= [b"".join([of[i] for i in ids[e - k : e].tolist()]) == t for e, k, t in zip(ends.tolist(), n.tolist(), texts, strict=True)]
        return ids_a[np.repeat(equal, n_a)], n_a * equal, ids_b[np.repeat(equal, n_b)], n_b * equal, equal


def linked(owner: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, packed pair and times of each different link; owner is by group, groups are numbered in order."""
    p, q = np.bincount(group_a, minlength=len(owner)), np.bincount(group_b, minlength=len(owner))
    first_b = np.cumsum(q) - q
    small = (p * q <= LARGE)[group_a]
    at, of = np.flatnonzero(small), group_a[small]
    each = q[of]
    left = np.repeat(ids_a[at], each)
    right = ids_b[np.arange(int(each.sum())) + np.repeat(first_b[of] - (np.cumsum(each) - each), each)]
    key, who, times = [left << 32 | right], [np.repeat(owner[of], each)], [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(p * q > LARGE):
        x, n = np.unique(ids_a[group_a == g], return_counts=True)
        y, m = np.unique(ids_b[group_b == g], return_counts=True)
        key.append((x[:, None] << 32 | y).ravel())
        who.append(np.full(len(x) * len(y), owner[g]))
        times.append(np.outer(n, m).ravel())
    who, key, times = np.concatenate(who), np.concatenate(key), np.concatenate(times)
    order = np.lexsort((key, who))
    who, key, times = who[order], key[order], times[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))) if len(key) else np.empty(0, np.int64)
    return who[new], key[new], np.add.reduceat(times, new) if len(key) else times


@dataclass
class Counts:
    """Where the shards of sorted pairs and counts are, their first pairs, and the highest count by A's id."""

    paths: list[str]
    first: np.ndarray
    best: np.ndarray

    def of(self, key: np.ndarray) -> np.ndarray:
        """The count of each sorted pair; 0 for those that no shard holds."""
        out = np.zeros(len(key), np.int64)
        bounds = np.append(np.searchsorted(key, self.first), len(key))
        for path, start, stop in zip(self.paths, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if start < stop:
                pairs, counts = np.load(path, mmap_mode="r")
                at = np.minimum(np.searchsorted(pairs, key[start:stop]), len(pairs) - 1)
                out[start:stop] = np.where(pairs[at] == key[start:stop], counts[at], 0)
        return out


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each run of n values."""
    up = np.append(0, np.cumsum(values))
    ends = np.cumsum(n)
    return up[ends] - up[ends - n]


class Units(Remembered):
    """Tokens, groups and links of units, remembered from text to text."""

    FIELDS = ("equal", "n_a", "n_b", "n_groups", "n_links", "n_pairs")

    def __init__(self, pair: Pair):
        super().__init__(REMEMBERED)
        self.pair = pair
        self.equal, self.groups = np.empty(0, bool), np.empty(0, object)
        self.n_a = self.n_b = self.n_groups = self.n_links = self.n_pairs = self.key = self.times = np.empty(0, np.int64)

    @cached_property
    def _names(self) -> np.ndarray:
        """Ids as text, with what stands after one in a group, after A's last and after B's last."""
        ids = range(max(len(self.pair.bytes_a), len(self.pair.bytes_b)))
        return np.array([[f"{i}{mark}" for i in ids] for mark in (",", "|", ";")], object)

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text by number; what is remembered holds them all."""
        if len(self.known) > self.most or len(self.key) > KEYS:
            keep = self.kept()
            at = gathered(self.first(), self.n_pairs, keep)
            self.key, self.times, self.groups = self.key[at], self.times[at], self.groups[keep]
            for name in self.FIELDS:
                setattr(self, name, getattr(self, name)[keep])
        out, new = self.number([parts(t) if t else [] for t in texts])
        added = [self._add(new[start : start + AT_ONCE]) for start in range(0, len(new), AT_ONCE)]
        if added:
            for name, values in zip((*self.FIELDS, "key", "times", "groups"), zip(*added, strict=True), strict=True):
                setattr(self, name, np.concatenate([getattr(self, name), *values]))
        return out

    def _add(self, words: list[str]) -> tuple[np.ndarray, ...]:
        ids_a, n_a, ids_b, n_b, equal = self.pair.ids(words)
        ends_a, ends_b = np.cumsum(self.pair.length_a[ids_a]), np.cumsum(self.pair.length_b[ids_b])  # units follow each other, of equal length by either
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        owner = np.repeat(np.arange(len(words)), n_a)[np.searchsorted(ends_a, both)]
        p, q = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        n_groups, n_links = np.bincount(owner, minlength=len(words)), np.zeros(len(words), np.int64)
        np.add.at(n_links, owner, p * q)
        # All ids as text in the order of groups, A's before B's, each with the mark that follows it.
        last_a, last_b = np.cumsum(p) - 1, np.cumsum(q) - 1
        mark_a, mark_b = np.zeros(len(ids_a), np.int8), np.zeros(len(ids_b), np.int8)
        mark_a[last_a], mark_b[last_b] = 1, 2
        texts = np.empty(len(ids_a) + len(ids_b), object)
        texts[np.arange(len(ids_a)) + (last_b + 1 - q)[group_a]] = self._names[mark_a, ids_a]
        texts[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = self._names[mark_b, ids_b]
        texts, ends, groups = texts.tolist(), np.cumsum(n_a + n_b).tolist(), np.empty(len(words), object)
        groups[:] = ["".join(texts[start:end]) for start, end in zip([0, *ends[:-1]], ends, strict=True)]
        who, key, times = linked(owner, group_a, group_b, ids_a, ids_b)
        return equal, n_a, n_b, n_groups, n_links, np.bincount(who, minlength=len(words)), key, times, groups

    def joined(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The units of each text whose bytes both tokenizers give back; others have none."""
        return [c if self.equal[c].all() else c[:0] for c in codes]

    def first(self) -> np.ndarray:
        return np.cumsum(self.n_pairs) - self.n_pairs


@cache
def units_of(a: str, b: str) -> Units:
    """What a worker remembers for all its tasks."""
    return Units(Pair(a, b))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sum of each one's counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    out, of = np.unique(key, return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, of, count)
    return out, total


def text_links(units: Units, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted different pairs of some texts, and text, pair (by its place among them) and times of each text's different links, in order."""
    used, local = np.unique(np.concatenate(codes), return_inverse=True)
    doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    held, often = np.unique(doc * max(len(used), 1) + local, return_counts=True)  # each unit once a text
    doc, unit = held // max(len(used), 1), used[held % max(len(used), 1)] if len(used) else held
    at = gathered(units.first(), units.n_pairs, unit)
    own, number = np.unique(units.key[at], return_inverse=True)
    slot, times = np.repeat(doc, units.n_pairs[unit]) * max(len(own), 1) + number, units.times[at] * np.repeat(often, units.n_pairs[unit])
    order = np.argsort(slot)
    slot, times = slot[order], times[order]
    new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else slot
    slot, times = slot[new], np.add.reduceat(times, new) if len(new) else times
    return own, slot // max(len(own), 1), slot % max(len(own), 1), times


class Counted:
    """In how many of a task's texts each pair is linked, in sorted runs."""

    def __init__(self):
        self.key = self.count = np.empty(0, np.int64)

    def add(self, own: np.ndarray, pair: np.ndarray) -> None:
        self.key, self.count = _summed([self.key, own], [self.count, np.bincount(pair, minlength=len(own))])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """What was counted, as columns pair and docs; others of names are null."""
        held = {"pair": pa.array(self.key), "docs": pa.array(self.count)}
        out = pa.RecordBatch.from_arrays([held.get(n, pa.nulls(len(self.key), KINDS.get(n, pa.int64()))) for n in names], names)
        self.key = self.count = np.empty(0, np.int64)
        return out


def partial_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """pair and docs: in how many of a task's texts each pair is linked, in sorted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted()
        for _, texts in text_chunks(batches, CHUNK):
            units = units_of(a, b)
            own, _, pair, _ = text_links(units, units.joined(units.codes(texts)))
            counted.add(own, pair)
            if len(counted.key) > PAIRS:
                yield counted.batch(["pair", "docs"])
        if len(counted.key):
            yield counted.batch(["pair", "docs"])

    return docs.select(F.lit(0).alias("key"), "text").mapInArrow(run, "pair bigint, docs bigint")


KINDS = {"groups_sha256": pa.string(), "groups": pa.string(), "links": pa.binary()}
#: Rows of texts, whose column docs is null, and rows of pairs, where all but pair and docs are.
FIRST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, pair bigint, docs bigint"


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and their times as bytes, in which small steps, ids and times are few."""
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    low = [int(x.max(initial=0)) < 1 << 16 for x in (a, b, times)]
    parts = [np.diff(a, prepend=0), b, times]
    return bytes(low) + len(pairs).to_bytes(8, "little") + b"".join(x.astype("<u2" if small else "<i8").view(np.uint8).reshape(len(x), 2 if small else 8).T.tobytes() for x, small in zip(parts, low, strict=True))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int.from_bytes(data[3:11], "little"), 11, []
    for small in data[:3]:
        width = 2 if small else 8
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        at += n * width
        out.append(planes[0] + planes[1].astype(np.int64) * 256 if small else np.ascontiguousarray(planes.T).view("<i8").ravel())
    return np.cumsum(out[0]) << 32 | out[1], out[2]


def first_pass(docs: DataFrame, a: str, b: str, with_groups: bool) -> DataFrame:
    """What each text has before counts are known, with its different links packed, and the task's counts of pairs (FIRST)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, codec = Counted(), pa.Codec("zstd", compression_level=1)
        for keys, texts in text_chunks(batches, CHUNK):
            units = units_of(a, b)
            codes = units.joined(units.codes(texts))
            own, doc, pair, times = text_links(units, codes)
            counted.add(own, pair)
            flat, stops = np.concatenate(codes), np.cumsum([len(c) for c in codes])
            starts = stops - [len(c) for c in codes]
            columns = [pa.array(keys, pa.int64())]
            for v in (units.n_a, units.n_b, units.n_groups, units.n_links):
                up = np.append(0, np.cumsum(v[flat]))
                columns.append(pa.array(up[stops] - up[starts]))
            groups = ["".join(units.groups[c].tolist())[:-1] for c in codes]  # each group ends with a mark
            columns.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]))
            pairs, ends = own[pair], np.searchsorted(doc, np.arange(len(codes)), side="right").tolist()
            packed = [_packed(pairs[i:j], times[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            columns.append(pa.array([len(p).to_bytes(8, "little") + codec.compress(p, asbytes=True) for p in packed], pa.binary()))
            nulls = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, nulls, nulls, *[pa.array(groups)] * with_groups], names)
            if len(counted.key) > PAIRS:
                yield counted.batch(names)
        if len(counted.key):
            yield counted.batch(names)

    schema = FIRST + ", groups string" * with_groups
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def _as_files(spark: SparkSession) -> bool:
    """Whether executors see the shared folder as files."""
    return shared_dir(spark).rpartition(":")[0] in ("", "file")


def count_shards(partial: DataFrame, tokens: int) -> Counts:
    """The shards of all pairs, written by the tasks that sort a range each; a task that runs again writes a file of its own.

    The driver gets a row for each shard, and the highest counts: tokens numbers, however many pairs there are.
    """
    spark = partial.sparkSession
    folder = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex}"
    if not _as_files(spark):
        raise ValueError("the count shards are mapped into memory: spark.checkpoint.dir must be a folder that executors see as files")
    at = "/" + folder.rpartition(":")[2].lstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.schema([("pair", pa.int64()), ("docs", pa.int64())])
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.columns, schema=named) for x in batches], named)  # Spark's own may say not null
        if not table.num_rows:
            return
        pair, docs = table.column("pair").to_numpy(), table.column("docs").to_numpy()
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        key, count = pair[new], np.add.reduceat(docs, new)
        os.makedirs(at, exist_ok=True)
        path = f"{at}/{uuid.uuid4().hex}.npy"
        with open(f"{path}.new", "wb") as f:
            np.save(f, np.stack([key, count]))
        os.replace(f"{path}.new", path)
        a = key >> 32
        turn = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rows = [pa.array([path] * len(turn)), pa.array([int(key[0])] * len(turn)), pa.array(a[turn]), pa.array(np.maximum.reduceat(count, turn))]
        yield pa.RecordBatch.from_arrays(rows, ["path", "first", "a", "most"])

    shards = cut(partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run, "path string, first bigint, a bigint, most bigint"))
    tables_written(spark).append(folder)
    index = shards.select("path", "first").distinct().orderBy("first").collect()  # a row for each shard
    best = np.zeros(tokens, np.int64)
    for r in shards.groupBy("a").agg(F.max("most").alias("most")).collect():  # a row for each token of A
        best[r.a] = r.most
    return Counts([r.path for r in index], np.array([r["first"] for r in index], np.int64), best)


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs (and groups, if asked).

    Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros and ''. Repeated
    rows count as documents of their own, null keys get a row each; ties for the highest count all count.
    Very long texts are read whole. An empty table gives an empty result; other columns are ignored.
    Where executors don't see the shared folder as files, counts are joined to the links instead.
    """
    a, b = a or default_paths()[0], b or default_paths()[1]
    docs = text_batches(docs).select(F.col(key).cast("long").alias("key"), "text")
    if not _as_files(docs.sparkSession):
        return _joined(docs, a, b, key, with_groups)
    first = cut(first_pass(docs, a, b, with_groups))
    counts = count_shards(first.where("docs IS NOT NULL").select("pair", "docs"), Pair(a, b).a.get_vocab_size() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            held = dict(zip(batch.schema.names, batch.columns, strict=True))
            links = [_unpacked(codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)) for x in held["links"].to_pylist()]
            n = np.array([len(x[0]) for x in links])
            pairs = pa.array(np.concatenate([x[0] for x in links])).dictionary_encode()
            known, of, times = pairs.dictionary.to_numpy(), pairs.indices.to_numpy(), np.concatenate([x[1] for x in links])
            order = np.argsort(known)
            count = np.empty(len(known), np.int64)
            count[order] = counts.of(known[order])
            held["n_best"] = pa.array(_sums((count == counts.best[known >> 32])[of] * times, n))
            held["count_sum"] = pa.array(_sums(count[of] * times, n))
            yield pa.RecordBatch.from_arrays([held[k] for k in names], names)

    names = [f.split()[0] for f in (SCHEMA + ", groups string" * with_groups).split(", ")]
    rows = first.where("docs IS NULL").drop("pair", "docs")
    return rows.mapInArrow(run, SCHEMA + ", groups string" * with_groups).withColumnRenamed("doc_id", key)


def _joined(docs: DataFrame, a: str, b: str, key: str, with_groups: bool) -> DataFrame:
    """The same rows where no file can be mapped: each text's links (a row for each different pair) meet the counts by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, keys = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            units = units_of(a, b)
            codes = units.joined(units.codes([t or "" for t in batch.column(1).to_pylist()]))
            first, rows = units.first(), []
            for c in codes:
                at = gathered(first, units.n_pairs, c)
                pairs, times = _summed([units.key[at]], [units.times[at]])
                groups = "".join(units.groups[c].tolist())[:-1]
                rows.append((*(int(v[c].sum()) for v in (units.n_a, units.n_b, units.n_groups, units.n_links)), hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups if with_groups else None, pairs, times))
            columns = list(zip(*rows, strict=True))
            lists = [pa.array(columns[i], pa.list_(pa.int64())) for i in (6, 7)]
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(keys, pa.int64()), *[pa.array(columns[i], pa.int64()) for i in range(4)], pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), *lists], names)

    names = ["rid", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"]
    schema = "rid bigint, key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<bigint>"
    rows = cut(docs.select("key", "text", F.monotonically_increasing_id().alias("rid")).mapInArrow(run, schema))
    counts = cut(partial_counts(docs, a, b).groupBy("pair").agg(F.sum("docs").alias("docs")))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))  # a row for each token of A
    links = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    met = links.join(counts, "pair").join(F.broadcast(best), F.shiftright("pair", 32) == F.col("a"))
    sums = met.groupBy("rid").agg(F.sum(F.when(F.col("docs") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return rows.join(sums, "rid", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", *["groups"] * with_groups)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
