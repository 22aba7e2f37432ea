"""Ranked retrieval: groups of terms joined with postings, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _top(hits: DataFrame, k: int, first: list[str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*first, F.desc("score"), "internal_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "internal_id", "score")


def ranked_union(groups: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """One token: hits of each term in turn, best first; a document may appear under several terms."""
    hits = groups.select("query_id", F.col("rank").alias("term_rank"), "term").join(postings.select("term", "internal_id", "score"), "term")
    return _top(hits, k, ["term_rank"])


def all_groups(groups: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Documents that every group matches; a group counts with its first term that a document holds.

    groups: query_id, n_groups (how many must match, empty ones too), group_id, rank, term.
    """
    hits = groups.select("query_id", "n_groups", "group_id", "rank", "term").join(postings.select("term", "internal_id", "score"), "term")
    matched = hits.groupBy("query_id", "n_groups", "group_id", "internal_id").agg(F.min_by("score", "rank").alias("score"))
    whole = matched.groupBy("query_id", "n_groups", "internal_id").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where("n = n_groups")
    return _top(whole, k, [])


def one_term(postings: DataFrame, term: str, k: int) -> DataFrame:
    """(rank, internal_id, score) of a term taken as it is."""
    best = postings.where(F.col("term") == term).orderBy(F.desc("score"), "internal_id").limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "internal_id"))  # of k rows at most
    return best.select(rank.alias("rank"), "internal_id", "score")
