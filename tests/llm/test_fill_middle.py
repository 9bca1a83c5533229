"""The arrangement against a plain version on odd texts, block edges and texts with sentinels; SQL is in test_native."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from sylva.llm import fill_middle


def plain(key, text, salt="1:"):
    """n, form, prefix_chars, middle_chars and output."""
    text = text or ""
    h = hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def same(df, salt="1:"):
    out = fill_middle.transform(df, salt=salt).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == df.count()
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, salt) and r.back == r.text
    return out


def test_odd_rows(odd, none):
    same(odd)
    assert fill_middle.transform(none).count() == 0


@pytest.mark.parametrize("block", [1, 4, 256])
def test_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = random.Random(block)
    alphabet = ["a", "é", "中", "\U0001f600", "\n", "\r", "<", ">", "P", "S", "M", "$1", "\\", "\0", "́"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 30, 255, 256, 257, 600])))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(["<P", "<P>", "a<S>b", "x<M>", "<P<S<M", "<<P", ">>"] * 20)]
    forms = {r.form for r in same(spark.createDataFrame(rows, "doc_id bigint, text string"), salt=f"{block}:")}
    assert forms == {"plain", "psm", "spm"}


def test_text_of_megabytes(spark):
    text = "ab \U0001f600é" * 800_000
    same(spark.createDataFrame([(i, text) for i in (1, 2)], "doc_id bigint, text string"))
