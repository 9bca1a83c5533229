"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import alignment, byte_bpe, fill_middle, fuzzy_hash, graph_search, jaccard_join, license_scan, lm_score, packing, source_mix, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm_score.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_source_mix": source_mix.query,
        "op4_url_filter": url_filter.query,
        "op5_fuzzy_hash": fuzzy_hash.query,
        "op6_byte_bpe": byte_bpe.query,
        "op7_toxicity": toxicity.query,
        "op8_license_scan": license_scan.query,
        "op9_graph_search": graph_search.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "op11_fill_middle": fill_middle.query,
        "op12_token_alignment": alignment.query,
        "op13_best_fit_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.SQL, "op8_license_scan": license_scan.SQL, "op11_fill_middle": fill_middle.SQL}
