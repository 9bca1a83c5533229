"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL is expanded into every (host suffix, path prefix) that a rule could name. Expressions
meet rules on the first four bytes of their SHA-256; the full digest then confirms the match and
the longest rule wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import ascii_lower, few_rows, row_ids
from sylva.session import table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rule tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _expressions(host: Column, path: Column, labels: int, depth: int, lengths: list[int]) -> Column:
    """All texts host suffix + path prefix that a rule of at most so many labels and slashes can equal."""
    parts = F.split(host, "\\.")
    n = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    steps = F.split(path, "/")
    slashes = F.least(F.size(steps) - 1, F.lit(depth))
    prefixes = F.when(
        slashes >= 1,
        F.transform(F.sequence(F.lit(1), slashes), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    if lengths:
        exact = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: k <= F.length(path))
        prefixes = F.array_union(prefixes, F.transform(exact, lambda k: path.substr(F.lit(1), k)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """A verdict for each row of pages.

    rules has host, path and verdict. A rule fits its host and all subdomains where the URL's path
    starts with the rule's path; the longest rule text wins, ties go to block, then to the greater
    text. URLs that are null or lack "://" have an empty host and path and get the default. Very long
    ones are judged whole. Repeated rows and null keys each get a row; empty tables give empty results;
    other columns of pages are left out, so their names cannot clash.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).where("rule_host is not null")
    rule = F.concat("rule_host", "rule_path")
    rules = rules.select(
        rule.alias("rule"), "rule_verdict", F.sha2(rule, 256).alias("rule_digest"), _short(F.sha2(rule, 256)).alias("short"), "rule_host", "rule_path"
    )
    bound = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("rule_host", "\\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/")) - 1).alias("depth"),
        F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))).alias("lengths"),
    ).first()
    rules = rules.drop("rule_host", "rule_path")
    if bound.n <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    urls = row_ids(pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    expanded = urls.withColumn("text", F.explode_outer(_expressions(F.col("host"), F.col("path"), bound.labels or 1, bound.depth or 0, sorted(bound.lengths or []))))
    digest = F.sha2("text", 256)
    found = expanded.select("rid", "key", "host", "path", digest.alias("digest"), _short(digest).alias("short")).join(rules, "short", "left")
    hit = F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("block"), F.col("rule"), F.col("rule_verdict")),
    )
    best = found.groupBy("rid", "key", "host", "path").agg(F.max(hit).alias("best"))
    return best.select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = few_rows(spark, RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('net','/','block'), ('example.net','/en/','allow'), ('example.com','/de/','block'), ('org','/fr/','allow')),
p AS (SELECT row_number() OVER () AS rid, page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT rid, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC, rule_verdict DESC, rule_host || rule_path DESC) AS k
      FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.rid = m.rid AND k = 1
"""
