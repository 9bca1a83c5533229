"""License scans by a positional index of rare words.

Of each template's key phrase, the words that the fewest documents hold are looked up in every
file; each place names a template and where it would start. Starts on which all of a template's
rare words agree are verified against the whole key phrase, and then scored by how much of the
full template stands around it. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import cut, few_rows, row_ids
from sylva.session import table

#: (label, full template, key phrase that must stand there, whether it is a base phrase)
TEMPLATES = [
    ("mit", "under the mit license", "under the mit license", True),
    ("apache-2", "apache license version 2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", "cc by nc", True),
    ("mit", "released under the mit license", "mit license", False),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0", False),
    ("cc-by-nc-4", "licensed under cc by nc 4 0", "cc by nc 4 0", False),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", False),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2", False),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license", False),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2", False),
    ("bsd-3", "licensed under the bsd 3 clause license", "bsd 3 clause", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False),
]
#: Rare words looked up of each template.
RARE = 2
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """Lower case in which ASCII letters come from A-Z alone; the two other code points whose lower case has one are kept."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.when(text.rlike("[\\u212A\\u0130]"), F.translate(text, "Kİ", "��")).otherwise(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _BREAK), "")


def _words(phrase: str) -> list[str]:
    return phrase.split(" ")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, rare: int = RARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs.

    n_words counts the words, n_base all places of base phrases, first_word and last_word are their
    smallest and largest starts. base_labels and labels are distinct, sorted and comma-joined, empty
    where there are none. score is the largest share of a template that stands around one of its
    verified key phrases, 0 without any. Null text counts as empty; very long texts are scanned whole;
    repeated rows and null keys each get a row; labels found at several places or by several templates
    count once. An empty table gives an empty result; other columns are ignored.
    """
    vocabulary = sorted({w for _, _, phrase, _ in templates for w in _words(phrase)})
    source = row_ids(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    seen = source.select("rid", "key", words_of(lowered(F.col("text"))).alias("words")).select(
        "rid", "key", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])).alias("holds")
    )
    seen = cut(seen)
    # One number for each word of the templates, so bounded by them.
    held = {r["w"]: r["n"] for r in seen.select(F.explode("holds").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    postings = []
    for t, (_, _, phrase, _) in enumerate(templates):
        ws = _words(phrase)
        order = sorted(range(len(ws)), key=lambda i: (held.get(ws[i], 0), ws[i], i))[:rare]
        postings += [(ws[i], t, i, len(order)) for i in order]
    lookup = sorted({p[0] for p in postings})
    reach = max(len(_words(full)) for _, full, _, _ in templates)
    spark = docs.sparkSession
    index = F.broadcast(few_rows(spark, postings, "word string, template int, at int, needed int"))  # templates x RARE rows
    parts = [(t, label, base, _words(phrase), _words(full), _start(_words(full), _words(phrase))) for t, (label, full, phrase, base) in enumerate(templates)]
    detail = F.broadcast(few_rows(spark, parts, "template int, label string, base boolean, phrase array<string>, whole array<string>, lead int"))

    ws = F.col("words")
    low = lambda i: F.greatest(i - reach, F.lit(0))
    hit = lambda w, i: F.when(w.isin(lookup), F.struct(i.alias("pos"), w.alias("word"), low(i).alias("from"), F.slice(ws, low(i) + 1, 2 * reach + 1).alias("near")))
    hits = (
        source.select("rid", lowered(F.col("text")).alias("text"))
        .where(F.col("text").rlike("|".join(lookup)))
        .select("rid", words_of(F.col("text")).alias("words"))
        .select("rid", F.explode(F.filter(F.transform(ws, hit), lambda h: h.isNotNull())).alias("h"))
    )
    starts = hits.select("rid", "h.*").join(index, "word").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0")
    agreed = starts.groupBy("rid", "template", "start").agg(
        F.count("*").alias("n"), F.first("needed").alias("needed"), F.min(F.struct("from", "near")).alias("c")
    ).where("n = needed")
    offset = F.col("start") - F.col("c.from")
    found = agreed.join(detail, "template").where((offset >= 0) & (F.slice("c.near", F.greatest(offset, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase")))
    around = F.transform("whole", lambda w, i: F.coalesce(F.get("c.near", offset - F.col("lead") + i) == w, F.lit(False)))
    found = found.select("rid", "start", "label", "base", (F.size(F.filter(around, lambda x: x)) / F.size("whole")).alias("share"))
    start = F.when(F.col("base"), F.col("start").cast("long"))
    verdicts = found.groupBy("rid").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return seen.join(verdicts, "rid", "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _start(whole: list[str], phrase: list[str]) -> int:
    """Where the key phrase stands in the full template."""
    for i in range(len(whole) - len(phrase) + 1):
        if whole[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"the template {whole} does not hold its key phrase {phrase}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(
        f"('{label}', {str(base).lower()}, {_words(phrase)!r}, {_words(full)!r}, {_start(_words(full), _words(phrase))})" for label, full, phrase, base in TEMPLATES
    )
    return f"""
WITH t(label, base, phrase, whole, lead) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
p AS (SELECT rid, words, unnest(generate_series(1, len(words))) AS i FROM d),
f AS (SELECT rid, i - 1 AS start, label, base,
        len(list_filter(generate_series(1, len(whole)), lambda k: i - lead + k - 1 >= 1 AND coalesce(words[i - lead + k - 1] = whole[k], false))) / len(whole)::DOUBLE AS share
      FROM p JOIN t ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
v AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM f GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN v ON d.rid = v.rid
"""


SQL = _sql()
