"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, jaccard, mixing, neardup_vectors, pii, quality, substrings, suffix_tree, token_files, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix,
    "op2_near_vectors": neardup_vectors.op2_near_vectors,
    "op3_token_files": token_files.op3_token_files,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality_crf": quality.op6_quality,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_top_k": topk.op8_top_k,
    "op9_suffix_tree": suffix_tree.op9_suffix_tree,
    "op10_pii": pii.op10_pii,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_near_vectors": neardup_vectors.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
}
