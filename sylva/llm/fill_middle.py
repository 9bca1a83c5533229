"""Fill-in-middle transformation in Spark SQL functions.

regexp_extract_all makes the array of a text's units, conv and substring of sha2 give the cuts, slice and
array_join build the arrangement, and a split at the sentinels restores the text. Units stand in blocks of
so many; only a block that holds a cut is taken apart into single units, so that the arrays of a very long
text stay as small as the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.session import table

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units (code points) in a block.
BLOCK = 256
#: Percent of texts that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SENTINELS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"

SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""


def draws(key: Column, salt: str = "1:") -> list[Column]:
    """Four numbers below 2**32 from the salt and the key in decimal; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _units(text: Column, at_once: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{at_once}}}"), F.lit(0))


def _part(c: Column, start: Column | int, length: Column | int) -> Column:
    """length elements from start, counted from 0."""
    return F.slice(c, (F.lit(start) + 1).cast("int"), F.lit(length).cast("int"))


def transform(docs: DataFrame, key: str = "doc_id", salt: str = "1:", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """key, text, n, form, prefix_chars, middle_chars and output for each row of docs.

    The two cuts are drawn from the key alone. Null and empty texts have no units and stay plain, as do
    texts that hold a sentinel; nothing is lost from very long texts. Repeated rows are arranged alike,
    null keys draw as an empty key; where both cuts meet, or stand at an end, the parts there are empty.
    An empty table gives an empty result; other columns are ignored.
    """
    text, (h1, h2, h3, h4) = F.col("text"), (F.col(f"h{k}") for k in range(1, 5))
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("key", "text", F.char_length("text").cast("long").alias("n"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("key"), salt), 1)])
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(sentinel))
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("key", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))

    none = F.array().cast("array<string>")
    cut = F.col("form") != "plain"
    rows = rows.withColumn("blocks", F.when(cut, _units(text, BLOCK)).otherwise(none))
    block = lambda at: _units(F.coalesce(F.get("blocks", F.floor(F.col(at) / BLOCK).cast("int")), F.lit("")))  # noqa: E731  a cut at the end may lie past the last block
    rows = rows.withColumns({"ua": F.when(cut, block("a")).otherwise(none), "ub": F.when(cut, block("b")).otherwise(none)})
    ia, ib, la, lb = F.floor(F.col("a") / BLOCK), F.floor(F.col("b") / BLOCK), F.col("a") % BLOCK, F.col("b") % BLOCK
    prefix = F.concat(_part(F.col("blocks"), 0, ia), _part(F.col("ua"), 0, la))
    across = F.concat(_part(F.col("ua"), la, BLOCK), _part(F.col("blocks"), ia + 1, F.greatest(ib - ia - 1, F.lit(0))), _part(F.col("ub"), 0, lb))
    middle = F.when(ia == ib, _part(F.col("ua"), la, F.col("b") - F.col("a"))).otherwise(across)
    suffix = F.concat(_part(F.col("ub"), lb, BLOCK), _part(F.col("blocks"), ib + 1, F.size("blocks")))
    rows = rows.select("key", "text", "n", "form", "a", "b", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    mark = lambda sentinel, part: F.concat(F.array(F.lit(sentinel)), F.col(part))
    psm = F.concat(mark(PREFIX, "prefix"), mark(SUFFIX, "suffix"), mark(MIDDLE, "middle"))
    spm = F.concat(mark(SUFFIX, "suffix"), mark(PREFIX, "prefix"), mark(MIDDLE, "middle"))
    output = F.when(~cut, text).otherwise(F.array_join(F.when(F.col("form") == "psm", psm).otherwise(spm), ""))
    return rows.select(
        F.col("key").alias(key), "text", "n", "form",
        F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of: what stands between the sentinels, put back in order."""
    parts = lambda *order: F.concat(*[F.get(F.split(output, SENTINELS), F.lit(k)) for k in order])
    return F.when(form == "plain", output).when(form == "psm", parts(1, 3, 2)).otherwise(parts(2, 3, 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
