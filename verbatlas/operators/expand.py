"""From query tokens to ranked groups of index terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verbatlas.config import IndexConfig
from verbatlas.functions import text

#: Up to so many query tokens are looked up by filters on the stored tables, more by joins.
FEW = 500


def query_tokens(queries: DataFrame, config: IndexConfig) -> DataFrame:
    """(query_id, n_tokens, group_id, token) of queries (query_id, text)."""
    split = queries.select("query_id", text.tokens(F.col("text"), config.stop_words).alias("k"))
    out = split.select("query_id", F.size("k").alias("n_tokens"), F.posexplode_outer("k").alias("group_id", "token"))
    return out.where("token is not null")


def completions(prefixes: DataFrame, cap: int) -> DataFrame:
    """(token, term, place): the first cap terms that go on from each prefix, in order of appearance.

    prefixes: (prefix, term, first_seen), those asked for."""
    place = F.row_number().over(W.partitionBy("prefix").orderBy("first_seen", "term"))
    return prefixes.withColumn("place", place).where(F.col("place") <= cap).select(F.col("prefix").alias("token"), "term", "place")


def neighbours(asked: DataFrame, deletions: DataFrame, cap: int) -> DataFrame:
    """(token, term, place): terms whose deletion neighbourhood meets a token's, by first key, then appearance.

    asked: (token, key_pos, key) of asked_keys(); deletions: (key, term, first_seen)."""
    met = deletions.join(asked, "key").where("term <> token").groupBy("token", "term", "first_seen").agg(F.min("key_pos").alias("key_pos"))
    place = F.row_number().over(W.partitionBy("token").orderBy("key_pos", "first_seen", "term"))
    return met.withColumn("place", place).where(F.col("place") <= cap).select("token", "term", "place")


def asked_keys(tokens: DataFrame) -> DataFrame:
    """(token, key_pos, key): each token's deletion neighbourhood in order."""
    return tokens.select("token").distinct().select("token", F.posexplode(text.deletion_keys(F.col("token"))).alias("key_pos", "key"))


def expansions(asked: DataFrame, vocabulary: DataFrame, prefixes: DataFrame, deletions: DataFrame, config: IndexConfig, few: bool = False) -> DataFrame:
    """(query_id, n_tokens, group_id, rank, term) of query tokens: exact terms, then completions or neighbours.

    One token: the term itself, its first completions, and only if there is neither, neighbours. Several: the
    term and neighbours for all but the last, the term and completions for the last. few: the tokens are of a checked
    number and sent to all tasks, so that the index's tables are not shuffled. vocabulary: (term, ...), terms once or more.
    """
    sent = F.broadcast if few else lambda df: df
    names = ["query_id", "n_tokens", "group_id", "rank", "term"]
    known = vocabulary.select(F.col("term").alias("token")).join(sent(asked.select("token").distinct()), "token", "left_semi").distinct()
    exact = asked.join(known, "token").withColumns({"rank": F.lit(0), "term": F.col("token")})
    last = F.col("group_id") == F.col("n_tokens") - 1
    most = F.when(F.col("n_tokens") == 1, config.single_prefixes).otherwise(config.multi_prefixes)
    ending = asked.where(last)
    started = prefixes.join(sent(ending.select(F.col("token").alias("prefix")).distinct()), "prefix", "left_semi")
    longer = ending.join(completions(started, max(config.single_prefixes, config.multi_prefixes)), "token").where(F.col("place") <= most).withColumn("rank", F.col("place"))
    found = exact.select("query_id", "token").unionByName(longer.select("query_id", "token")).distinct()
    alone = asked.where("n_tokens = 1").join(found, ["query_id", "token"], "left_anti")
    open_ = asked.where(~last).unionByName(alone)
    cap = F.when(F.col("n_tokens") == 1, config.single_fuzzy).otherwise(config.multi_fuzzy)
    near = open_.join(neighbours(sent(asked_keys(open_)), deletions, max(config.single_fuzzy, config.multi_fuzzy)), "token").where(F.col("place") <= cap).withColumn("rank", F.col("place"))
    return exact.select(*names).unionByName(longer.select(*names)).unionByName(near.select(*names))


def expansions_of_few(asked: list[Row], vocabulary: DataFrame, prefixes: DataFrame, deletions: DataFrame, config: IndexConfig) -> list[tuple]:
    """The rows of expansions() for FEW tokens at most: three lookups by filters that reach the stored tables."""

    def looked_up(found: DataFrame) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in sorted(found.collect(), key=lambda r: r.place):  # FEW tokens of a capped number of terms
            out.setdefault(r.token, []).append(r.term)
        return out

    def chosen(table: dict[str, list[str]], r: Row, one: int, several: int) -> list[str]:
        return table.get(r.token, [])[: one if r.n_tokens == 1 else several]

    def ends(r: Row) -> bool:
        return r.group_id == r.n_tokens - 1

    wanted = lambda rows: sorted({r.token for r in rows})
    known = {r.term for r in vocabulary.where(F.col("term").isin(wanted(asked))).select("term").collect()}
    started = prefixes.where(F.col("prefix").isin(wanted(r for r in asked if ends(r))))
    longer = looked_up(completions(started, max(config.single_prefixes, config.multi_prefixes)))
    groups = [[r, [r.token] if r.token in known else [], chosen(longer, r, config.single_prefixes, config.multi_prefixes) if ends(r) else []] for r in asked]
    open_ = {r.token for r, exact, more in groups if not ends(r) or (r.n_tokens == 1 and not exact and not more)}
    near: dict[str, list[str]] = {}
    if open_:
        keys = [(t, n, k) for t in sorted(open_) for n, k in enumerate(text.deletion_keys_of(t))]
        sent = F.broadcast(vocabulary.sparkSession.createDataFrame(keys, "token string, key_pos int, key string"))
        near = looked_up(neighbours(sent, deletions.where(F.col("key").isin(sorted({k for _, _, k in keys}))), max(config.single_fuzzy, config.multi_fuzzy)))
    out = []
    for r, exact, more in groups:
        if not ends(r) or (r.n_tokens == 1 and not exact and not more):
            more = chosen(near, r, config.single_fuzzy, config.multi_fuzzy)
        out += [(r.query_id, r.n_tokens, r.group_id, 0, t) for t in exact] + [(r.query_id, r.n_tokens, r.group_id, n, t) for n, t in enumerate(more, 1)]
    return out
