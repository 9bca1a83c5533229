"""Packing: ids against the tokenizer on whole texts, sequences without gaps, and as few as plain best-fit needs."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.llm import packing, units

VOCABULARY = packing.default_path()


@pytest.fixture(scope="module")
def tokenizer():
    return units.byte_bpe(VOCABULARY)


def best_fit(lengths, capacity):
    """The number of sequences of best-fit decreasing, piece by piece."""
    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(room, x)
        left = room.pop(at) if at < len(room) else capacity
        n += left == capacity and at >= len(room)
        if left > x:
            insort(room, left - x)
    return n


def whole(rows, texts, tokenizer, capacity, end=2):
    """Checks every rule of the result; texts holds (key, text) in any order."""
    want = []
    for k, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        stops = list(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity))
        for piece, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
            want.append((k, piece, a, b - a, zlib.crc32(ids[a:b])))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == best_fit([w[3] for w in want], capacity)


@pytest.mark.parametrize("capacity", [1024, 7])
def test_rows(spark, odd, none, tokenizer, capacity):
    rng = random.Random(capacity)
    texts = [(i, " ".join(rng.choice(["tree", "oak,", "a", "b\n\n c", "  ", "don't", "᠎ x", "x ​", "<|endoftext|>", "\U0001f600"]) for _ in range(int(rng.lognormvariate(3, 1.5))))) for i in range(200)]
    df = odd.unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"), allowMissingColumns=True).repartition(5)
    whole(packing.pack(df, capacity=capacity).collect(), [(r.doc_id, r.text) for r in df.collect()], tokenizer, capacity)
    assert packing.pack(none).count() == 0


def test_one_length_holds_nearly_all(spark, tokenizer):
    texts = [(i, "same words here") for i in range(3000)] + [(None, "longer than all the others are")] * 7
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(16)
    whole(packing.pack(df, capacity=64).collect(), texts, tokenizer, 64)


def test_ids_of_pieces(spark, tokenizer):
    rows = packing.pack(spark.createDataFrame([(1, "one two three " * 40)], "doc_id bigint, text string"), capacity=16, with_ids=True).orderBy("piece").collect()
    assert sum((r.ids for r in rows), []) == [*tokenizer.encode("one two three " * 40).ids, 2] and len(rows) > 3


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 64, 1024])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 50, 100_000 if capacity < 64 else 900]) for _ in range(rng.choice([3, 40, 800]))}
    slots, room = packing.plan(counts, capacity), {}
    for length, n in counts.items():
        own = sorted((s[1], s[2]) for s in slots if s[0] == length)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == n
    for length, _, n, sequence, per, at in slots:
        for i in range(n):
            s = sequence + i // per
            assert room.get(s, 0) == at + i % per * length
            room[s] = room.get(s, 0) + length
    assert max(room.values()) <= capacity and len(room) == best_fit([x for x, n in counts.items() for _ in range(n)], capacity)
    assert len(slots) < 50 * capacity


def test_long_texts(spark, tokenizer):
    texts = [(1, "long text, " * 300_000), (2, "z" * 200_000), (3, "9" * 3000)]
    whole(packing.pack(spark.createDataFrame(texts, "doc_id bigint, text string")).collect(), texts, tokenizer, 1024)


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("part", "place", "length", "first", "ids", "before")})
    assert packing.pack(df).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
