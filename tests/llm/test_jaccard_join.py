import random
import re

import pytest
from sylva.llm import jaccard_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, words, percent):
    """(n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posts = {}
    for i, s in enumerate(sets):
        for x in s:
            posts.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in posts[x] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(j)] = root(i)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[root(i)] = min(ids.get(root(i), key), key)
    return sorted((str(k), len(s), ids.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def run(df, **kw):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.group_documents(df, **kw).collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_brute_force_on_a_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.query(spark, sf).collect()) == brute(rows, 4, 85)


@pytest.mark.parametrize(("words", "percent", "hot"), [(4, 85, 1000), (5, 80, 3), (2, 60, 2)])
def test_chains_and_shared_passages(spark, monkeypatch, words, percent, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "FILTER", 64)
    rng = random.Random(5)
    passage = [rng.choice("abcdefghij") * 3 + str(i) for i in range(40)]
    rows = []
    for d in range(300):
        if d % 3 == 0:
            base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))]
        else:  # an edited copy of the one before: chains of near copies
            base = [w if rng.random() > 0.04 else f"e{rng.randrange(50)}" for w in base]
        rows.append((rng.randrange(10**6), " ".join(base + passage * (d % 5 == 0))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).cache()
    rows = [tuple(r) for r in df.collect()]
    assert run(df, words=words, percent=percent) == brute(rows, words, percent)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert run(odd) == brute(rows, 4, 85)
    assert run(none) == []


def test_stage_keeps_one_of_each_group(spark, odd):
    assert jaccard_join.stage(spark, odd, "").count() == 9 and jaccard_join.stage(spark, odd, "").columns == odd.columns


def test_only_shared_shingles_are_kept(spark):
    """A prefix shingle that no other prefix holds is written nowhere, however few or many rows share one."""
    prefixes = {1: [1, 2, 3], 2: [3, 4], 3: [5, -6], 4: [], 5: [4, 3, -6]} | {k: [7, 1000 + k] for k in range(10, 60)}
    placed = spark.createDataFrame([(r, 9, 1, 0.5, p) for r, p in prefixes.items()], "rid bigint, n bigint, extra bigint, central double, prefix array<bigint>")
    rows = {(r.rid, r.pos, r.token) for r in jaccard_join.shared_tokens(placed.repartition(4)).collect()}
    assert rows == {(1, 2, 3), (2, 0, 3), (2, 1, 4), (3, 1, -6), (5, 0, 4), (5, 1, 3), (5, 2, -6)} | {(k, 0, 7) for k in range(10, 60)}


def test_the_join_writes_shared_shingles_only(spark):
    """Of texts without common shingles no table holds a row for each shingle."""
    from sylva.session import tables_written

    df = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(60))) for k in range(200)], "doc_id bigint, text string").repartition(4)
    before = len(tables_written(spark))
    assert jaccard_join.group_documents(df).count() == 200
    tables = [spark.read.parquet(p) for p in tables_written(spark)[before:]]
    tokens = [t for t in tables if {"rid", "pos", "token"} <= set(t.columns)]
    assert tokens and all(t.isEmpty() for t in tokens)
    assert not any({"token", "y"} <= set(t.columns) or {"token", "parts"} == set(t.columns) for t in tables)
