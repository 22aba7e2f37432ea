"""The corpus pipeline over documents: five stages, each one operator on all that the stage before kept.

toxicity      documents that the factorization machine calls toxic go
line_dedup    lines that an earlier line equals or is one edit away from go, and documents left without text
jaccard_join  one document of each group of near duplicates stays (five words, 0.8)
mixing        source, language and topic are raked to their targets and documents sampled by cell
encoding      what is left, as SentencePiece ids

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. SQL can't express the first stage's model nor the last one's merges, so there is none for the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import common, jaccard_join, line_dedup, mixing, sentencepiece_bpe, toxicity

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("mixing", mixing.stage),
    ("encoding", sentencepiece_bpe.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written as Parquet and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
