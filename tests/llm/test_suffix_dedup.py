import hashlib
import random
from collections import Counter

import pytest
from sylva.llm import suffix_dedup


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(k), len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_table(spark, sf):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 400)
    assert sum(r[2] > 0 for r in want) > 5
    assert got(suffix_dedup.query(spark, sf)) == want


@pytest.mark.parametrize(
    ("wide", "shard", "reaches", "length"),
    [(500, 10**6, (128, 16, 1), 60), (1, 10**6, (16, 1), 60), (2, 500, (16, 4, 1), 25), (500, 300, (7, 1), 20), (3, 500, (64, 16, 1), 60)],
)
def test_planted(spark, monkeypatch, wide, shard, reaches, length):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "REACHES", reaches)
    rng = random.Random(wide + reaches[0])
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [word(n) for n in (length - 1, length, length + 1, 3 * length)]
    rows = [(i, word(rng.randrange(80)) + rng.choice(passages) + word(rng.randrange(80)) + rng.choice(passages) * (i % 3 == 0)) for i in range(60)]
    rows += [(60, "z" * 3 * length), (61, "ab" * length), (62, rows[0][1]), (63, rows[1][1][5:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).cache()
    assert got(suffix_dedup.dedup(df, length)) == brute([(k, t.encode()) for k, t in rows], length)


def worded(rows):
    """Places in rows of which a run of 51 words also starts anywhere else."""
    words = [t.split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    return sorted(str(k) for (k, _), w in zip(rows, words, strict=True) if any(seen[tuple(w[i : i + 51])] > 1 for i in range(len(w) - 50)))


def test_repeated_words_of_the_table(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = suffix_dedup.query(spark, sf).where("repeats_words").collect()
    assert sorted(str(r.doc_id) for r in found) == worded(rows) and found


def test_repeated_words_planted(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcde") + rng.choice(["", "x", "yz", "é"]) + rng.choice([" ", " ", "\n", " \t"]) for _ in range(n))
    rows = []
    for n in (50, 51, 51, 52, 55, 60, 70, 100):  # all are shorter than 400 bytes but the last
        p = text(n).split()
        rows += [(len(rows) + j, f"{text(rng.randrange(90))} {(' ', chr(10))[j % 2].join(p)} {text(rng.randrange(90))}") for j in range(rng.choice([2, 3, 40]))]
    base = text(300).split()
    for j in range(60):  # near copies, of which few stretches are equal in all
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((len(rows), " ".join(w)))
    once = text(51)
    rows += [(len(rows), f"{once} {text(3)} {once}"), (len(rows) + 1, "z " * 51), (len(rows) + 2, "ab " * 52), (len(rows) + 3, "q r " * 26)]
    rows += [(len(rows) + j, text(200)) for j in range(40)] + [(5, None), (5, ""), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).cache()
    out = suffix_dedup.dedup(df).collect()
    want = worded([(k, (t or "").encode()) for k, t in rows])
    assert sorted(str(r.doc_id) for r in out if r.repeats_words) == want and 100 < len(want) < len(rows) - 40
    assert sum(r.repeats_words and not r.repeats for r in out) > 20  # runs of fewer than 400 bytes
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    assert got(suffix_dedup.dedup(odd)) == brute(rows, 400)
    assert suffix_dedup.dedup(none).count() == 0
    kept = suffix_dedup.stage(spark, odd, "")
    assert kept.columns == odd.columns and {r.doc_id: r.text for r in kept.collect()}[9] == ""


@pytest.mark.parametrize("lang", ["en", "de", "es", "fr"])
def test_stage_finds_51_words_of_any_length(spark, lang):
    rng = random.Random(lang)
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(f"lang = '{lang}'").limit(2000).collect()
    words = sorted({w for r in texts for w in (r.text or "").split() if w.isalpha()})
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    short = " ".join(rng.choice("abcdefgh") for _ in range(51))
    passages = [short, *(text(n) for n in (51, 52, 55, 58, 61, 65))]
    rows = [(10 * i + j, f"{text(70)}  {p}\n{text(30 + j)}") for i, p in enumerate(passages) for j in range(3)]
    common = text(50)  # too short to go
    rows += [(100 + j, f"{text(60)} {common} {text(60)}") for j in range(3)] + [(200 + j, text(90)) for j in range(5)]
    seen = Counter(tuple(w[i : i + 51]) for _, t in rows for w in [t.split()] for i in range(len(w) - 50))
    want = {}
    for k, t in rows:
        w = t.split()
        gone = {i + j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(51)}
        want[k] = [x for i, x in enumerate(w) if i not in gone]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    kept = {r.doc_id: r.text for r in suffix_dedup.stage(spark, df, "").collect()}
    assert {k: t.split() for k, t in kept.items()} == want
    assert all(kept[k] == t for k, t in rows if k >= 100)
    assert all(p not in kept[10 * i + j] for i, p in enumerate(passages) for j in range(3))
