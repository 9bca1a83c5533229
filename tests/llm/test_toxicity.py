import random

from sylva.llm import toxicity
from sylva.llm.common import remainder


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    out = {r.doc_id: r for r in toxicity.query(spark, at).collect()}
    assert len(out) == spark.read.parquet(f"{at}/documents.parquet").count()
    labels = spark.read.parquet(f"{at}/labels.parquet").withColumn("held", remainder(F.col("doc_id"), 4) == 2).collect()
    rows = [(out[r.doc_id].predicted, r.toxic) for r in labels if r.held]
    assert all(out[r.doc_id].held_out == r.held for r in labels)
    assert sum(p == t for p, t in rows) >= 0.93 * len(rows)


def test_folding_and_exceptions():
    table = toxicity._Fold()
    assert toxicity.folded("ST​UP1D сlоwn, l0$er!", table) == ["stupid", "clown", "loser"]
    lexicon = toxicity.Lexicon({" trash ": 2.0, " stup": 3.0}, {" trash can "})
    assert [w for *_, w in lexicon.hits(["trash", "can", "stupid", "trash"])[1]] == [3.0, 2.0]
    assert toxicity.Lexicon({}).features("") == (1.0, 0.0, 0.0)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(8, 0), (9, 0), (7, 1), (7, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    rows = toxicity.score_texts(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_texts(none, labels).count() == 0
    assert toxicity.score_texts(odd, labels.limit(0)).where("predicted = 1").count() == 0


def _learned(spark, n, before, copies=0, share=0.1):
    """Lexicon from n labelled texts; the toxic ones hold an insult after one of a few words."""
    rng = random.Random(n + copies)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    insults = ["vileqname", "wrqetch"]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(40)]
        toxic = i < share * n
        # one clean text in 450 quotes an insult too
        if toxic or i % 450 == 0:
            at = rng.randrange(30)
            t[at : at + 2] = [rng.choice(before), rng.choice(insults)]
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    one = [rng.choice(words) + "zz" for _ in range(40)]
    for i in range(copies):  # near copies of one toxic text
        t = list(one)
        t[rng.randrange(40)] = rng.choice(words)
        rows.append((n + i, " ".join(t)))
        labels.append((n + i, 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))[0], one, insults


def test_insults_after_few_words_are_learned(spark):
    for before in (["you"], ["you", "a", "the"]):
        weights, _, insults = _learned(spark, 2000, before)
        assert all(any(f" {w} ".startswith(e) for e in weights) for w in insults)


def test_near_copies_do_not_fill_the_lexicon(spark):
    weights, one, insults = _learned(spark, 2000, ["you", "a", "the"], copies=100)
    assert all(any(f" {w} ".startswith(e) for e in weights) for w in insults)
    assert sum(any(f" {w} ".startswith(e) for e in weights) for w in one) <= 4


def test_matches_equal_a_plain_search():
    rng = random.Random(6)
    for _ in range(200):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 25))]
        weights = {rng.choice((" {} ", " {}")).format("".join(rng.choice("abc") for _ in range(rng.randrange(2, 5)))): rng.random() for _ in range(6)}
        spared = {" " + " ".join(rng.choice(words) for _ in range(2)) + " " for _ in range(2)} - set(weights) if words else set()
        text = " " + " ".join(words) + " "
        holes = [(i, i + len(p)) for p in spared for i in range(len(text)) if text.startswith(p, i)]
        want = []
        for i in range(len(text)):
            here = [e for e in weights if text.startswith(e, i)]
            if words and here:
                e = max(here, key=len)
                if not any(a <= i and i + len(e) <= b for a, b in holes):
                    want.append((i, i + len(e), weights[e]))
        assert toxicity.Lexicon(weights, spared).hits(words)[1] == want


def test_stage_with_odd_rows(spark, odd, none, tmp_path):
    at = str(tmp_path / "sf")
    spark.createDataFrame([(8, 1, 0), (9, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    kept = toxicity.stage(spark, odd, at)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert toxicity.stage(spark, none, at).count() == 0
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert toxicity.stage(spark, odd, empty).count() == odd.count()
