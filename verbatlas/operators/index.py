"""Postings, vocabulary, prefix, deletion and filter tables of documents.

documents: internal_id (one for each stored version, in order of arrival), external_id, batch and the fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verbatlas.config import IndexConfig
from verbatlas.functions import text


def targets(documents: DataFrame, config: IndexConfig, parts: int | None = None) -> DataFrame:
    """documents with target: the version that a row's texts count for, the last of its id in its batch."""
    last = F.max("internal_id").over(W.partitionBy("external_id", "batch"))
    out = (documents.repartition(parts, "external_id", "batch") if parts else documents).withColumn("target", last)
    return out.where("internal_id = target") if config.duplicate_policy == "last" else out


def occurrences(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """(external_id, batch, target, arrival, term, score) of every row's different tokens; arrival is its internal_id."""
    key = ("external_id", "batch", "target", F.col("internal_id").alias("arrival"))
    cut = rows.select(*key, F.sort_array(text.field_tokens(rows, config.index_fields, config.stop_words)).alias("k"))
    # equal tokens stand in a row now; their first places tell how many they are, without a shuffle
    first = F.filter(F.sequence(F.lit(0), F.size("k")), lambda i: (i < F.size("k")) & ((i == 0) | (F.get("k", i) != F.get("k", i - 1))))
    runs = cut.select("external_id", "batch", "target", "arrival", "k", first.alias("at"))
    counted = F.transform("at", lambda i, n: F.struct(F.get("k", i).alias("term"), (F.coalesce(F.get("at", n + 1), F.size("k")) - i).alias("times")))
    # explode_outer keeps the optimizer from repeating all this below the generator
    each = runs.select("external_id", "batch", "target", "arrival", text.unit_score(F.size("k")).alias("unit"), F.explode_outer(counted).alias("t")).where("t is not null")
    return each.select("external_id", "batch", "target", "arrival", "t.term", (F.col("unit") * F.col("t.times")).alias("score"))


def postings(rows: DataFrame, config: IndexConfig, whole: bool = False) -> DataFrame:
    """(term, internal_id, score, arrival): term frequency times unit score. whole: each target is one row, so that
    nothing is left to add up; otherwise rows of targets() are added up where they are."""
    found = occurrences(rows, config)
    if not whole:
        found = found.groupBy("external_id", "batch", "target", "term").agg(F.sum("score").alias("score"), F.min("arrival").alias("arrival"))
    return found.select("term", F.col("target").alias("internal_id"), "score", "arrival")


def terms(posted: DataFrame) -> DataFrame:
    """(term, first_seen, doc_freq); the order of appearance is (first_seen, term)."""
    return posted.groupBy("term").agg(F.min("arrival").alias("first_seen"), F.count("*").alias("doc_freq"))


def prefix_table(vocabulary: DataFrame, cap: int = 400) -> DataFrame:
    """(prefix, term, first_seen, rank): the first cap terms of every proper prefix in order of appearance."""
    pairs = vocabulary.select("term", "first_seen", F.explode(text.prefixes(F.col("term"))).alias("prefix"))
    rank = F.row_number().over(W.partitionBy("prefix").orderBy("first_seen", "term"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= cap).select("prefix", "term", "first_seen", "rank")


def deletion_table(vocabulary: DataFrame, shortest: int = 4) -> DataFrame:
    """(key, term, first_seen): terms (each once) of that length at least under themselves and each deletion."""
    long = vocabulary.where(F.length("term") >= shortest)
    return long.select(F.explode(F.array_distinct(text.deletion_keys(F.col("term")))).alias("key"), "term", "first_seen")


def filter_table(rows: DataFrame, config: IndexConfig, tokenless: bool = False, whole: bool = False) -> DataFrame:
    """(field, value, internal_id) of the filter fields; rows without tokens only if tokenless. whole: as in postings()."""
    spark = rows.sparkSession
    if not tokenless:
        rows = rows.where(text.worded(rows, config.index_fields, config.stop_words))
    made = []
    for name in dict.fromkeys(config.filter_fields):
        if name in rows.columns and (value := text.canonical(rows, name, config.go_float_format)) is not None:
            made.append(F.struct(F.lit(name).alias("field"), value.alias("value")))
    if not made:
        return spark.createDataFrame([], "field string, value string, internal_id bigint")
    pairs = rows.select(F.explode(F.array(*made)).alias("p"), F.col("target").alias("internal_id"))
    found = pairs.select("p.field", "p.value", "internal_id").where("value is not null")
    return found if whole else found.distinct()
