"""The queries of this package and their SQL; __spark_entry__ adds them where the package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import huffman, jaccard_join, line_dedup, media, mixing, pii, sentencepiece_bpe, spotsigs, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.query,
    "op2_pseudonyms": pii.query,
    "op3_line_dedup": line_dedup.query,
    "op4_sentencepiece": sentencepiece_bpe.query,
    "op5_document_fingerprints": spotsigs.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_token_files": huffman.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_media_columns": media.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op3_line_dedup": line_dedup.SQL,
}
