import base64
import hashlib
import random
import struct
import weakref

import public_tokenizers as P
import pytest
import tiktoken
from sylva.llm import byte_bpe


def expected(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.VOCABULARY), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, text in rows:
        ids = t.encode_ordinary(text or "")
        out.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


def test_equals_the_library_and_round_trips(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.query(spark, sf).collect()) == expected(rows)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.encode(odd).collect()) == expected(rows)
    assert byte_bpe.encode(none).count() == 0


def test_decode(spark, odd):
    coded = byte_bpe.encode(odd, with_ids=True)
    assert sorted(bytes(r["bytes"]).decode() for r in byte_bpe.decode(coded).collect()) == sorted(r.text or "" for r in odd.collect())


@pytest.mark.parametrize("rows", [byte_bpe.ROWS, 20_000])
def test_long_words(spark, monkeypatch, rows):
    monkeypatch.setattr(byte_bpe, "ROWS", rows)
    rng = random.Random(2)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = ["x" * 65, "a" * 70_001, drawn("0123456789", 1500), drawn("ACGT", 1500), drawn("theandrsi", 700), drawn("abcdeé文中", 400), "-=" * 300, "\n \t" * 90, "ab" * 40, drawn("ing", 65)]
    texts = [(i, w) for i, w in enumerate(words)] + [(100, " ".join(words)), (101, "one two " * 20_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.encode(df).collect()) == expected(texts)


@pytest.mark.parametrize("most", [byte_bpe.REMEMBERED, 3])
def test_words_are_remembered_from_chunk_to_chunk(monkeypatch, most):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", most)
    words, asked = byte_bpe.Words(byte_bpe.read_ranks(byte_bpe.default_path())), []
    monkeypatch.setattr(words, "encode", lambda ws, f=words.encode: asked.append(len(ws)) or f(ws))
    texts = ["Thathere onnt onnt, it's  two\x1cspaces", " onnt Thathere\nonnt ééai文", "", "\u3000 onnt \t", "onnt onnt onnt edshti"]
    for some in (texts, texts[::-1], texts):
        rows = [(len(i), hashlib.sha256(i.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b).hexdigest()) for i, b in byte_bpe.encode_texts(some, words, byte_bpe.default_pattern())]
        assert sorted(rows) == sorted(r[1:] for r in expected(list(enumerate(some))))
    assert asked[2] == 0 if most > 3 else 0 < asked[2] < asked[0]


def test_stage_with_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.stage(spark, odd, "").collect()) == expected(rows)
    assert byte_bpe.stage(spark, none, "").count() == 0


def test_a_task_of_another_operator_forgets_the_words():
    """Workers are used again: what they remember of this operator goes when they work for another."""
    from sylva.llm import common, toxicity

    for other in (lambda: list(common.chunks(iter([]), 1)), lambda: list(toxicity._texts(iter([])))):
        words = byte_bpe.words_of(byte_bpe.default_path())
        assert byte_bpe.words_of(byte_bpe.default_path()) is words
        gone = weakref.ref(words)
        del words
        other()
        assert gone() is None
