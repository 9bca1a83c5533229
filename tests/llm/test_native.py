"""The operators in DataFrame functions: SQL where it can express them, invariants where it can't."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from sylva.llm import license_scan, queries, source_mix, url_filter


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in queries.queries()[name](spark, sf).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_license_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan_licenses(odd).collect()}
    assert (got[10, 12].n_base, got[10, 12].first_word, got[10, 12].last_word, got[10, 12].base_labels) == (3, 0, 8, "mit")
    assert got[1, 0].labels == "" and len(license_scan.scan_licenses(odd).collect()) == odd.count()
    assert license_scan.scan_licenses(none).count() == 0


def test_url_odd_rows(spark):
    urls = [(1, None), (2, "no scheme"), (3, "https://A.Example.NET/en/x?y"), (4, "x://net/"), (5, "x://planet/"), (6, "x://org/fr/#"), (7, "x://"), (7, "x://"), (8, "a://b.net?x/en/")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumns({c: F.lit("z") for c in ("host", "rule", "rid", "text")})
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "net", "/", "net/", "block"),
        (5, "planet", "/", None, "allow"), (6, "org", "/fr/", "org/fr/", "allow"), (7, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "b.net", "", None, "allow"),
    ]
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule is not null").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_mix_meets_targets(spark):
    at = "/root/testdata/sf0.01"
    assert os.path.exists(at)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = source_mix.mix_sources(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, rows)) == sorted(map(tuple, source_mix.mix_sources(docs).collect()))
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= 0.02 * v[0].target + max(r.size for r in v)


def test_mix_odd_rows(spark, odd, none):
    rows = source_mix.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert source_mix.mix_sources(none).count() == 0
    assert set(source_mix.stage(spark, odd, "").columns) == set(odd.columns)


def test_long_urls(spark):
    host = ".".join(["a"] * 3000) + ".example.net"
    urls = [(1, f"http://{host}/en/" + "x/" * 3000), (2, "http://" + "b" * 50_000 + "/fr/"), (3, "http://example.com/de/" + "?" * 30_000)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("example.com/de/", "block")}


def test_long_text_for_licenses(spark):
    text = "word " * 60_000 + "under the MIT license " + "x" * 100_000
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (60_005, 1, 60_000, "mit")
