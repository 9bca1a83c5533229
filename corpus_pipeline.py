"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import byte_bpe, jaccard_join, source_mix, suffix_dedup, toxicity
from sylva.llm.common import cut
from sylva.session import drop_written, tables_written

#: (name, function); each takes (spark, docs, sf_dir). Toxic documents go, one document of each group
#: of near copies stays, repeated passages go from the texts, documents are repeated or left out to
#: meet the sources' weights, and what is left is encoded.
STAGES = [
    ("toxicity", toxicity.stage),
    ("jaccard_join", jaccard_join.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("source_mix", source_mix.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Learning, hashing draws and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training reads: a row of token counts and digests for each copy of each document that stays.

    Null texts and keys, repeated rows, empty tables and other columns are treated as each stage says: rows
    without words go in the mix, of repeated rows one stays, an empty table gives no rows, and without labels
    none is toxic. Very long texts are read whole by every stage, and of equal documents the one of the least key
    stays. Each stage but the last is written as Parquet and read again; then the tables that it
    was made of are dropped.
    """
    before = len(tables_written(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop_written(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
