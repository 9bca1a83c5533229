import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sylva.llm import common, fuzzy_hash


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        a, b = fuzzy_hash.fingerprint(t.encode()), fuzzy_hash.fingerprint(edited.encode())
        out.append((str(k), n, hashlib.sha256(edited.encode()).hexdigest(), a, b))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *r[1:5]) for r in df.collect())


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = fuzzy_hash.query(spark, sf).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in out) == expected([(r.doc_id, r.text) for r in docs.collect()])
    far = [r for r in out if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in far]) > np.mean([r.near_next for r in far]) + 0.3
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(fuzzy_hash.fingerprint_texts(odd)) == expected(rows)
    assert fuzzy_hash.fingerprint_texts(none).count() == 0
    assert got(fuzzy_hash.fingerprint_texts(odd.where("doc_id = 8"))) == expected([r for r in rows if r[0] == 8])
    assert got(fuzzy_hash.fingerprint_texts(odd.where("doc_id is null"))) == expected([r for r in rows if r[0] is None])


def test_edit_distance():
    rng = random.Random(1)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
            d = e
        return d[-1]

    words = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    assert fuzzy_hash._distances(words[:100], words[100:]).tolist() == [slow(a, b) for a, b in zip(words[:100], words[100:], strict=True)]


@pytest.mark.parametrize("hot", [5, None])
def test_order_splits_hot_keys(spark, hot, tmp_path):
    rng = random.Random(4)
    rows = [(hot if i % 3 == 0 else rng.randrange(40) - 20, f"t{i}") for i in range(400)] + [(None, "same")] * 5 + [(2**62, "far"), (2**62 + 1, "farther")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    out = [(r.place, r.ahead, r.key, r.text) for r in fuzzy_hash.in_order(df).select("place", "ahead", "key", "text").withColumn("at", F.spark_partition_id()).orderBy("at", F.monotonically_increasing_id()).collect()]
    by = {}
    for place, ahead, key, text in out:
        by.setdefault(place, []).append((ahead, key, text))
    places = sorted(by)
    chain = [x[1:] for p in places for x in by[p] if not x[0]]
    assert sorted(map(str, chain)) == sorted(map(str, rows))
    keys = [k for k, _ in chain]
    assert keys == sorted(keys, key=lambda k: (k is None, -(k or 0)))
    assert max(len(v) for v in by.values()) < 200  # a third of the rows is split
    for i, p in enumerate(places):
        assert [x[0] for x in by[p]] == [False] * (len(by[p]) - 1) + [True]
        assert by[p][-1][1:] == by[places[(i + 1) % len(places)]][0][1:]


def plain_fingerprint(text):
    """The same by loops over bytes: a hash of seven bytes ends a piece, a sum over a piece names its character."""
    if not text:
        return "3::"

    def trigger(i):
        h = sum((text[i - k] + 1) * pow(0x01000193, k + 1, 1 << 32) for k in range(min(7, i + 1))) % (1 << 32)
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)
        return h ^ (h >> 12)

    def character(a, b):
        word = 1 << 64
        inverse = pow(int(common.BASE), -1, word)
        h = sum(int(common._TABLE[text[i]]) * pow(int(common.BASE), i, word) for i in range(a, b)) * pow(inverse, a, word) + b - a
        h %= word
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD % word
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 % word
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(h ^ (h >> 33)) >> 58]

    def signed(size):
        out, a = "", 0
        for i in range(len(text)):
            if trigger(i) % size == size - 1 and len(out) < 63:
                out += character(a, i + 1)
                a = i + 1
        return out + (character(a, len(text)) if a < len(text) else "")

    size = 3
    while size * 64 < len(text):
        size *= 2
    one = signed(size)
    while size > 3 and len(one) < 32:
        size //= 2
        one = signed(size)
    return f"{size}:{one}:{signed(2 * size)}"


def test_equals_plain_fingerprints():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc d\xc3\xa9") for _ in range(n)) for n in (1, 2, 6, 7, 8, 50, 191, 192, 193, 500, 3000)] + [b"x" * 900, b"ab" * 400]
    for t in texts:
        assert fuzzy_hash.fingerprint(t) == plain_fingerprint(t)
