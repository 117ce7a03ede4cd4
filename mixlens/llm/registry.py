"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from mixlens.llm import op1_quality, op2_packing, op3_counts, op4_urls, op5_bpe, op6_html, op7_topk, op8_substring, op9_langid, op10_jaccard, op11_trie, op12_pii, op13_hotjoin, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_rules": op1_quality.query,
        "op2_best_fit_packing": op2_packing.query,
        "op3_token_counts": op3_counts.query,
        "op4_url_filters": op4_urls.query,
        "op5_bpe_round_trip": op5_bpe.query,
        "op6_html_extraction": op6_html.query,
        "op7_exact_topk": op7_topk.query,
        "op8_substring_dedup": op8_substring.query,
        "op9_language_id": op9_langid.query,
        "op10_jaccard_join": op10_jaccard.query,
        "op11_prefix_trie": op11_trie.query,
        "op12_pii": op12_pii.query,
        "op13_hot_key_join": op13_hotjoin.query,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
