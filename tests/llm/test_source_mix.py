"""The mix against a plain version of the same pivots and draws, and its mean over many seeds against the fractions."""

import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F
from sylva.llm import source_mix


def uniform(*parts):
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return (h >> 11) / (1 << 53)


def home(seed, rid, groups):
    h = xxhash.xxh64_intdigest(rid.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(seed.encode(), 42))
    return (h - (1 << 64) * (h >> 63)) % groups


def snapped(x):
    return 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def targets(sizes, weights=(5.0, 2.0, 1.0), limit=3.0):
    """Target by source: water rises until no source is above its limit."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[n] for n in free)
        full = {n for n in free if limit * sizes[n] < level * w[n]}
        if not full:
            return out | {n: level * w[n] for n in free}
        for n in full:
            out[n] = limit * sizes[n]
        left -= sum(out[n] for n in full)
        free -= full
    return out


def pivoted(units, seed):
    """units are [rid, size, x]; all but the one returned become whole."""
    carry = None
    for u in units:
        if carry is None or carry[2] in (0.0, 1.0):
            carry = u
            continue
        c = carry
        mass = c[1] * c[2] + u[1] * u[2]
        to_c, to_u = min(1.0, mass / c[1]), min(1.0, mass / u[1])
        low = (mass - u[1] * to_u) / c[1]
        x = snapped(to_c if uniform(seed, c[0], u[0]) < (c[2] - low) / (to_c - low) else low)
        y = snapped((mass - c[1] * x) / u[1])
        c[2] = x
        if x in (0.0, 1.0):
            u[2], carry = y, u
        else:
            u[2] = float(round(y))
    return carry


def brute(rows, seed="mix", fan=256, long=512, limit=3.0):
    """copies by rid for rows (rid, source, size)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, copies = targets(sizes), {}
    for s, total in sizes.items():
        own = [(r, n) for r, of, n in rows if of == s]
        rate = min(limit, goal[s] / total) if total else 0.0
        rate = float(round(rate)) if abs(rate - round(rate)) < 1e-9 else rate
        base, x = math.floor(rate), rate - math.floor(rate)
        units = [[r, n, x] for r, n in own if n > 0 and x > 0]
        rest = [u for u in units if u[1] * long <= total]
        left, asked, words, last = [], x, float(total), []
        for u in sorted((u for u in units if u[1] * long > total), key=lambda u: (-u[1], uniform(seed, "long", u[0]))):
            words -= u[1]
            u[2] = asked
            if asked not in (0.0, 1.0) and words > 0:
                mass = (u[1] + words) * asked
                to_u, to_rest = min(1.0, mass / u[1]), min(1.0, mass / words)
                low = (mass - words * to_rest) / u[1]
                chance = (asked - low) / (to_u - low) if to_u > low else 0.0
                up = uniform(f"{seed}long", u[0]) < chance
                u[2], asked = snapped(to_u if up else low), snapped((mass - u[1] * to_u) / words if up else to_rest)
            if u[2] not in (0.0, 1.0):
                last.append(u)
        for u in rest:
            u[2] = asked
        groups = max(1, -(-len(own) // fan))
        level = [(home(seed, u[0], groups), u) for u in rest if u[2] not in (0.0, 1.0)]
        k = 0
        while level:
            nodes = {}
            for at, u in level:
                nodes.setdefault(at, []).append(u)
            level = []
            for at, members in nodes.items():
                carry = pivoted(sorted(members, key=lambda u: uniform(seed, k.to_bytes(4, "little", signed=True), u[0])), f"{seed}{k}")
                if carry[2] not in (0.0, 1.0):
                    level.append((at, carry))
            if groups <= 1:
                break
            groups = -(-groups // fan)
            level = [(at % groups, u) for at, u in level]
            k += 1
        for u in last + [u for _, u in level]:
            u[2] = 1.0 if uniform(seed, "root", u[0]) < u[2] else 0.0
        copies |= {r: base for r, _ in own}
        for u in units:
            copies[u[0]] = base + int(u[2])
    return copies


def corpus(seed=1):
    rng = random.Random(seed)
    size = lambda: int(rng.lognormvariate(4.5, 1.1))
    rows = [("b", size()) for _ in range(50)] + [("a", size()) for _ in range(3000)] + [(None, size()) for _ in range(40)] + [("c", 4000), ("c", 10), ("c", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("fan", "long"), [(256, 512), (8, 512), (4, 20)])
def test_equals_plain_pivots(spark, monkeypatch, fan, long):
    monkeypatch.setattr(source_mix, "FAN_IN", fan)
    monkeypatch.setattr(source_mix, "LONG", long)
    df = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(corpus())], "doc_id bigint, source string, text string")
    got = source_mix.mix_sources(df).collect()
    want = brute([(r.rid, r.source, r.size) for r in got], fan=fan, long=long)
    assert {r.rid: r.copies for r in got} == want
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    goal = targets(sizes)
    for s in sizes:
        rows = [r for r in got if r.source == s]
        assert rows[0].source_size == sizes[s] and math.isclose(rows[0].target, goal[s], rel_tol=1e-12)
        if s != "c":  # one document holds nearly all of c
            assert abs(sum(r.taken for r in rows) - goal[s]) <= sizes[s] / long + max(r.size for r in rows if r.size * long <= sizes[s])


def test_mean_copies_are_the_fractions():
    rng = random.Random(3)
    rows = [(i, "ab"[i % 3 == 0], int(rng.lognormvariate(4, 1)) + 1) for i in range(90)]
    sizes = {s: sum(n for _, of, n in rows if of == s) for s in "ab"}
    goal, runs = targets(sizes), 3000
    sums = dict.fromkeys(range(90), 0)
    for k in range(runs):
        for rid, c in brute(rows, f"s{k}", fan=8, long=16).items():
            sums[rid] += c
    for rid, s, _ in rows:
        rate = goal[s] / sizes[s]
        spread = math.sqrt(max((rate % 1) * (1 - rate % 1), 1e-9) / runs)
        assert abs(sums[rid] / runs - rate) <= 5 * spread + 1e-9


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i:04d}": rng.randrange(1, 10 ** rng.randrange(1, 7)) for i in range(500)} | {None: 77}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n bigint")
    got = {r.source: r.target for r in source_mix.targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)


def test_level_is_found_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BINS", 3)
    test_targets_of_many_sources(spark)
    same = spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("c", 5, 1), ("d", 0, 1)], "source string, source_size bigint, n bigint")
    got = {r.source: r.target for r in source_mix.targets(same).collect()}
    want = targets({"a": 5, "b": 5, "c": 5, "d": 0})
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in want)
    assert {r.target for r in source_mix.targets(same.withColumn("source_size", F.lit(0))).collect()} == {0.0}


def test_draws_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(corpus(5)[:1500])] + [(7, "a", "same text")] * 40 + [(None, None, "same text")] * 30
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    seen = []
    for k, parts in enumerate((1, 3, 13)):
        at = str(tmp_path / str(k))
        df.orderBy(F.xxhash64(F.lit(k), "doc_id", "text")).repartition(parts).write.parquet(at)
        docs = spark.read.parquet(at)
        seen.append((sorted(map(str, source_mix.mix_sources(docs).collect())), sorted(map(str, source_mix.stage(spark, docs, "").collect()))))
    assert seen[0] == seen[1] == seen[2]
    assert len({r.rid for r in source_mix.mix_sources(df).collect()}) == len(rows)


def test_draws_do_not_depend_on_split_size(spark):
    docs = "/root/testdata/sf0.01/documents.parquet"
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("134217728", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(sorted(map(str, source_mix.mix_sources(spark.read.parquet(docs)).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("wide", [4096, 5])
def test_stage_repeats_rows_as_taken(spark, monkeypatch, wide):
    monkeypatch.setattr(source_mix, "WIDE", wide)
    rows = [(i, f"text of {i} " * (i % 5 + 1), "en", "ab"[i % 3 == 0], i) for i in range(60)] + [(99, "equal rows here", "en", "a", k % 2) for k in range(23)] + [(None, "no key", None, None, 0), (3, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    taken = {}
    for r in source_mix.mix_sources(docs).collect():
        taken[r.doc_id, r.source, r.size] = taken.get((r.doc_id, r.source, r.size), 0) + r.copies
    got = {}
    for r in source_mix.stage(spark, docs, "").collect():
        assert tuple(r) in rows and (r.doc_id != 99 or r.n_chars == 0)
        k = (r.doc_id, r.source, len((r.text or '').split()))
        got[k] = got.get(k, 0) + 1
    assert {k: n for k, n in got.items() if k[2]} == {k: n for k, n in taken.items() if n and k[2]}
    assert source_mix.stage(spark, docs.limit(0), "").count() == 0
