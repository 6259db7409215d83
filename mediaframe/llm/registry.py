"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaframe.llm import bpe, decontaminate, embed_dedup, jaccard, lpf_dedup, pii, secrets, toxicity, tree_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_pii": pii.op5_pii,
        "op6_suffix_dedup": lpf_dedup.op6_suffix_dedup,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_tree_dedup": tree_dedup.op8_tree_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_embed_dedup": embed_dedup.op10_embed_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.ORACLE,
        "op4_jaccard_join": jaccard.ORACLE,
        "op6_suffix_dedup": lpf_dedup.ORACLE,
        "op8_tree_dedup": tree_dedup.ORACLE,
        "op9_decontaminate": decontaminate.ORACLE,
        "op10_embed_dedup": embed_dedup.ORACLE,
    }
