"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells of source, language and topic. The kept share of each cell starts from one rate and
is raked to the target token totals of every source, language and topic in turn, never above 1, until no
total moves. A document stays if a hash of its id and text, as a number in [0, 1), lies below the share of
its cell, so a cell keeps that share of its tokens in expectation and any subset of the input decides alike.

Targets flatten the corpus: a value with share s of all tokens aims at s ** FLATTEN over the sum of those,
times RATE of all tokens. A total that more than all of its tokens would be needed for keeps them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verbatlas.llm import common

RATE = 0.5
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS = 60
SMALL = 200_000  # cells that the driver rakes; beyond it Spark does, by the same steps

#: Topic of a text: the first of these patterns that it holds, else prose, short or long.
TOPICS = [
    ("licence", "[Ll]icensed under|[Pp]ublic [Ll]icense|MIT License|Apache License"),
    ("contact", "@[a-z0-9.]+[.][a-z]|[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"),
    ("record", "[0-9]{3}"),
    ("table", " [|] "),
    ("noise", "[!#$%&*]{2}"),
]
LONG = 3000  # characters


def topic(text: Column) -> Column:
    out = F.when(F.length(text) >= LONG, "long").otherwise("short")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words between single spaces and line ends, one at least."""
    return F.length(text) - F.length(F.translate(text, " \n", "")) + 1


def unit_hash(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from an id and a text; the first 48 bits of their md5."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), text)), F.lit(12)), 16, 10).cast("double") / float(2**48)


DIMENSIONS = ("source", "lang", "topic")


def _targets(total: np.ndarray, power: float, aim: float) -> np.ndarray:
    part = np.where(total > 0, (total / max(total.sum(), 1e-300)) ** power, 0)
    return aim * part / max(part.sum(), 1e-300)


def rake(values: list[tuple], tokens: np.ndarray, rate: float, flatten: dict[str, float], rounds: int = ROUNDS, targets: dict[str, dict] | None = None) -> np.ndarray:
    """The kept share of each cell; values: a tuple of source, lang and topic for each, all distinct.

    targets: for a dimension the wanted share of each value (of others 0), instead of flattened ones.
    """
    if not len(values):
        return np.empty(0)
    share, aim = np.full(tokens.size, rate), rate * tokens.sum()
    plans = []
    for k, name in enumerate(DIMENSIONS):
        keys, at = np.unique(np.array(["\0" if v[k] is None else "\1" + str(v[k]) for v in values]), return_inverse=True)
        if targets and name in targets:
            goal = np.array([float(targets[name].get(None if x == "\0" else x[1:], 0)) for x in keys]) * aim
        else:
            goal = _targets(np.bincount(at, tokens, keys.size), flatten[name], aim)
        plans.append((at, goal))
    for _ in range(rounds):
        for at, goal in plans:
            now = np.bincount(at, tokens * share, goal.size)
            share = np.minimum(1.0, share * np.where(now > 0, goal / np.where(now > 0, now, 1), 1)[at])
    return share


def _raked_far(cells: DataFrame, rate: float, flatten: dict[str, float], rounds: int) -> DataFrame:
    """rake() by Spark, for more cells than the driver should hold; a stored table cuts lineage each round."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("share", F.lit(rate))
    for name in DIMENSIONS:
        by = cells.groupBy(name).agg(F.pow(F.sum("tokens") / F.lit(float(max(total, 1))), F.lit(flatten[name])).alias("part"))
        parts = by.agg(F.sum("part")).first()[0] or 1.0
        by = by.select(F.col(name).alias("v"), (F.col("part") / parts * rate * total).alias(f"goal_{name}"))
        now = now.join(by, F.col(name).eqNullSafe(F.col("v")), "left").drop("v")
    now = common.stored(now, "cells")
    for _ in range(rounds):
        for name in DIMENSIONS:
            kept = F.sum(F.col("tokens") * F.col("share")).over(W.partitionBy(name))
            now = now.withColumn("share", F.least(F.lit(1.0), F.col("share") * F.when(kept > 0, F.col(f"goal_{name}") / kept).otherwise(1.0)))
        now = common.stored(now, "cells")
    return now.select(*DIMENSIONS, "tokens", "share")


def cell_shares(rows: DataFrame, rate: float = RATE, flatten: dict[str, float] = FLATTEN, rounds: int = ROUNDS, targets: dict[str, dict] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, share) of every cell of rows with those three columns and n_tokens."""
    spark = rows.sparkSession
    cells = common.stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
    if cells.count() > SMALL:
        if targets:
            raise ValueError(f"explicit targets take {SMALL} cells at most")
        return _raked_far(cells, rate, flatten, rounds)
    found = sorted(cells.collect(), key=lambda r: tuple((r[d] is not None, r[d] or "") for d in DIMENSIONS))
    shares = rake([tuple(r[d] for d in DIMENSIONS) for r in found], np.array([r.tokens for r in found], np.float64), rate, flatten, rounds, targets)
    return spark.createDataFrame([(r.source, r.lang, r.topic, r.tokens, float(s)) for r, s in zip(found, shares)], "source string, lang string, topic string, tokens double, share double")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and draw of every row; a null text is empty, null values are a value."""
    rows = common.picked(docs, doc_id="bigint", text="string", source="string", lang="string").na.fill("", ["text"])
    text, i = F.col("text"), F.col("doc_id")
    return rows.select(i, "source", "lang", topic(text).alias("topic"), n_tokens(text).cast("bigint").alias("n_tokens"), unit_hash(i, text).alias("draw"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Every row of docs described, with its share and kept (draw < share).

    Rows that repeat draw alike. Columns other than doc_id, text, source and lang are ignored; absent ones
    count as null. An empty table gives an empty result.
    """
    rows = described(docs)
    shares = cell_shares(rows.select(*DIMENSIONS, "n_tokens"), **how)
    at = shares.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "share")
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    out = rows.join(at, same[0] & same[1] & same[2], "left").drop(*(f"_{d}" for d in DIMENSIONS))
    return out.withColumn("kept", F.col("draw") < F.col("share"))


def query(spark, sf_dir: str) -> DataFrame:
    out = mixed(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("share", 5).alias("share"), "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the mixture keeps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shares = cell_shares(described(docs).select(*DIMENSIONS, "n_tokens"))
    at = shares.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "share")
    keyed = docs.select(F.struct("*").alias("row"), F.col("source").alias("s"), F.col("lang").alias("l"), topic(text).alias("t"), unit_hash(F.col("doc_id"), text).alias("draw"))
    same = F.col("s").eqNullSafe(F.col("_source")) & F.col("l").eqNullSafe(F.col("_lang")) & F.col("t").eqNullSafe(F.col("_topic"))
    return keyed.join(at, same).where("draw < share").select("row.*")


def _sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    goals = ", ".join(f"{RATE} * tot * p_{d} / (SELECT sum(p) FROM (SELECT any_value(p_{d}) AS p FROM parts GROUP BY {d})) AS goal_{d}" for d in DIMENSIONS)
    parts = ", ".join(f"power(sum(tokens) OVER (PARTITION BY {d}) / tot, {FLATTEN[d]}) AS p_{d}" for d in DIMENSIONS)
    nested = "r"
    for d in DIMENSIONS:
        nested = f"(SELECT * EXCLUDE (share), least(1.0, share * goal_{d} / sum(tokens * share) OVER (PARTITION BY {d})) AS share FROM {nested})"
    return f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, lang, CASE {cases} WHEN length(t) >= {LONG} THEN 'long' ELSE 'short' END AS topic,
    CAST(length(t) - length(replace(replace(t, ' ', ''), chr(10), '')) + 1 AS BIGINT) AS n_tokens,
    CAST(('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 12)) AS BIGINT) / 281474976710656.0 AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), cells AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL
), parts AS (
  SELECT *, {parts} FROM (SELECT *, sum(tokens) OVER () AS tot FROM cells)
), r AS (
  SELECT 0 AS round_, source, lang, topic, tokens, {goals}, CAST({RATE} AS DOUBLE) AS share FROM parts
  UNION ALL
  SELECT round_ + 1, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, share FROM {nested} WHERE round_ < {ROUNDS}
)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(r.share, 5) AS share, d.draw < r.share AS kept
FROM rows_ d JOIN r ON r.round_ = {ROUNDS} AND d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic
"""


SQL = _sql()
