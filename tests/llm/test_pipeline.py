"""The pipeline against its stages' brute-force versions, and that planted cases go while clean documents stay."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sylva.llm import suffix_dedup
from sylva.llm.source_mix import mix_sources
from tests_llm_brute import encoded

WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "s", "t", "nd", "st")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = text(120)
    docs = [(i, text(80), "en", f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "s0") for i in range(5)]  # exact copies
    docs += [(300 + i, docs[10 + i][1] + " more", "en", "s1") for i in range(5)]  # near copies
    docs += [(400 + i, text(150) + " " + passage + " " + text(150), "en", "s2") for i in range(4)]  # a shared passage
    docs += [(500 + i, text(40) + " vilename " + text(40), "en", "s0") for i in range(60)]  # toxic
    at = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i >= 500)) for i, *_ in docs if i < 200 or i >= 500]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {i: t for i, t, *_ in docs}, passage


def test_stages(spark, corpus):
    at, texts, passage = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, at))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.collect())
    clean, single, cut_down, mixed = kept
    assert sorted(r.doc_id for r in clean) == sorted(i for i in texts if i < 500)
    assert len(single) == 124 and len({r.doc_id for r in single}) == 124
    for r in cut_down:
        assert (passage in r.text) == False and (r.text == texts[r.doc_id] or r.doc_id >= 400)  # noqa: E712
    copies = {r.doc_id: r.copies for r in mix_sources(spark.createDataFrame(cut_down)).collect()}
    assert set(copies) == {r.doc_id for r in cut_down}
    assert {r.doc_id for r in mixed} <= set(copies)
    out = sorted(tuple(r) for r in corpus_pipeline.run(spark, at).collect())
    assert out == encoded([(r.doc_id, r.text) for r in mixed])


def test_rows_whose_text_goes_stay(spark):
    df = spark.createDataFrame([(1, "x" * 900), (2, "x" * 900), (3, "y")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.stage(spark, df, "").collect()) == [(1, ""), (2, ""), (3, "y")]


def _written(spark, at, rows, labels=()):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_run_without_rows_labels_or_texts(spark, tmp_path):
    assert corpus_pipeline.run(spark, _written(spark, tmp_path / "none", [])).count() == 0
    nulls = [(i, None, "en", None, 0) for i in range(3)] + [(None, "", None, "a", 0), (7, None, "en", "a", 0)]
    assert corpus_pipeline.run(spark, _written(spark, tmp_path / "nulls", nulls)).count() == 0  # a mix takes no texts without words
    plain = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, "seven eight nine ten", None, None, 20)]
    out = corpus_pipeline.run(spark, _written(spark, tmp_path / "plain", plain)).collect()
    assert {r.doc_id for r in out} <= {1, None}


@pytest.mark.parametrize("n", [51, 55, 60])
def test_short_shared_passages_go(spark, tmp_path, n):
    rng = random.Random(n)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = text(n)
    rows = [(i, f"{text(60)} {passage} {text(60)}", "en", "a", 0) for i in range(4)] + [(10 + i, text(120), "en", "b", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.text for r in suffix_dedup.stage(spark, docs, "").collect()}
    for i, t, *_ in rows:
        assert (passage in kept[i]) is False if i < 10 else kept[i] == t


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, none, tmp_path, name):
    at = _written(spark, tmp_path, [])
    out = dict(corpus_pipeline.STAGES)[name](spark, none, at)
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == none.columns)


def test_run_with_clashing_columns(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)), "en", "ab"[i % 2], 0) for i in range(12)]
    names = ("rid", "key", "h", "g", "row", "others", "copies", "group", "order", "kept", "runs", "words", "label", "from", "part")
    wide = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(1) for c in names})
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(range(12)) and all(r.n_tokens > 0 for r in out)
