"""Texts that every operator must stand: nulls, empty, white space, ties, repeats, long ones, clashing column names."""

import pytest

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "One two three", "en", "b", 13),
    (4, "One two three", "en", "b", 13),
    (None, "one TWO three four five six seven eight", None, "b", None),
    (6, "one two\x0bthree four five six seven  eight", "fr", "c", 39),
    (7, "Éa ñ ß 中文 \U0001f600 stupid ſtuff K", "de", "c", 20),
    (8, "word " * 4000, "en", "a", 20000),
    (9, "x" * 5000, "en", "a", 5000),
    (10, "under the MIT license; " * 3, "en", "a", 69),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("rid", "key", "label", "score", "words", "size", "a", "b", "n", "group", "copies")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
