"""Alignment against a plain version that encodes whole texts and lists every link."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_paths())


def plain(texts, pair):
    """Rows of the result for (key, text), in the texts' order."""
    out, links = [], []
    for _, t in texts:
        a, b = (pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)) if t else ([], [])
        x, y = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
        if not t or not b"".join(x) == b"".join(y) == b" " + t.encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = lambda of: [sum(map(len, of[: i + 1])) for i in range(len(of))]
        ends_a, ends_b = ends(x), ends(y)
        groups, own, start = [], [], 0
        for e in sorted({*ends_a} & {*ends_b}):
            g = [i for i, at in zip(a, ends_a, strict=True) if start < at <= e], [i for i, at in zip(b, ends_b, strict=True) if start < at <= e]
            groups.append("|".join(",".join(map(str, ids)) for ids in g))
            own += [(i, j) for i in g[0] for j in g[1]]
            start = e
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    docs = Counter(p for own in links for p in set(own))
    best = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    return [(k, *n, len(own), sum(docs[p] == best[p[0]] for p in own), sum(docs[p] for p in own), sha) for (k, _), (*n, sha), own in zip(texts, out, links, strict=True)]


def same(df, pair):
    want = plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], pair)
    got = [tuple(r) for r in alignment.align(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_odd_rows(odd, none, pair):
    got = same(odd, pair)
    assert [r[1:] for r in got if r[0] in (1, 2)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.align(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, pair, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(alignment, "LARGE", 3)
    rng = random.Random(seed)
    bits = ["tree", " oak", "ing", "  ", "\n", "\r\n", "\t", "é", "中文", "\U0001f600", "▁", "<|endoftext|>", "</s>", "<unk>", "<0x0A>", "1234567", "don't", "ﬁ", "é", " ", "\x1c", "᠎", "﻿", "ſ", "ing.", "\0", "Ġ"]
    texts = [(i, rng.choice(["", " "]) + "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.choice([1, 2, 5, 40])))) for i in range(400)]
    same(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), pair)


def test_documents(spark, sf, pair):
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    got = same(df, pair)
    assert sum(r[1] > 0 for r in got) > 0.9 * len(got)


def test_units_are_forgotten_and_counts_given_on(spark, sf, pair, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    small = {"CHUNK": 5_000, "REMEMBERED": 300, "PAIRS": 500}
    whole = sorted(map(tuple, alignment.align(df).collect()))
    for name, value in small.items():
        monkeypatch.setattr(alignment, name, value)
    units, counts = alignment.Units(pair), []
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    for start in range(0, len(texts), 5):
        codes = units.joined(units.codes(texts[start : start + 5]))
        counts += [(int(units.n_a[c].sum()), int(units.n_links[c].sum()), "".join(units.groups[c])[:-1]) for c in codes]
    assert len(units.known) < 5_000
    assert [(n, m, hashlib.sha256(g.encode()).hexdigest() if g else "") for n, m, g in counts] == [(r[1], r[4], r[7]) for r in whole]


def test_long_texts(spark, pair):
    texts = [(1, "long texts " * 100_000), (2, "ab" * 30_000)]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame(texts, "doc_id bigint, text string"), with_groups=True).collect()}
    assert got[1].n_a == len(pair.a.encode(" " + texts[0][1]).ids) and got[2].n_b == len(pair.b.encode(texts[1][1]))
    assert got[1].groups.count(";") == got[1].n_groups - 1


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("pair", "docs", "key", "path", "first", "groups")})
    assert sorted((r.doc_id is None, r.n_best, r.count_sum) for r in alignment.align(df).collect()) == [(False, 2, 5), (False, 2, 5), (True, 1, 3)]


def test_shards_need_files(spark, monkeypatch, odd, none, sf):
    rows = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)).repartition(3)
    rows = alignment.cut(rows)
    want = sorted(map(str, alignment.align(rows).collect()))
    monkeypatch.setattr(alignment, "shared_dir", lambda _: "hdfs://nowhere/at/all")
    assert sorted(map(str, alignment.align(rows).collect())) == want  # counts are joined instead
    assert alignment.align(none).count() == 0
    with pytest.raises(ValueError, match="see as files"):
        alignment.count_shards(spark.range(1).selectExpr("id AS pair", "id AS docs"), 2)


def test_texts_are_read_and_encoded_once(spark, sf):
    df = alignment.cut(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    alignment.align(df.select("doc_id", counted("text").alias("text"))).collect()
    assert read.value == df.count()


def test_links_are_packed_and_back():
    for a, b, times in (([], [], []), ([0, 0, 5], [1, 7, 0], [1, 2, 65_535]), ([3, 70_000], [70_001, 2], [1, 1 << 40])):
        pairs, times = np.array(a, np.int64) << 32 | np.array(b, np.int64), np.array(times, np.int64)
        got = alignment._unpacked(alignment._packed(pairs, times))
        assert got[0].tolist() == pairs.tolist() and got[1].tolist() == times.tolist()
