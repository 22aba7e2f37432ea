"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verbatlas import tables
from verbatlas.config import IndexConfig
from verbatlas.functions import text
from verbatlas.operators import dictionary, filters, index, stats
from verbatlas.plans.search_index import SearchIndex
from verbatlas.sources import documents as sources
from verbatlas.sources import snapshot

K = 10
TEXT = IndexConfig(("text",), ("lang", "source"), k=K)
PART = IndexConfig(("p_name", "p_type", "p_brand"), ("p_size", "p_brand"), k=K)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/verbatlas/{name}-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version for each document, its doc_id being the internal id."""
    i = F.col("doc_id")
    return _read(spark, sf_dir, "documents").select(i.alias("internal_id"), i.alias("target"), i.cast("string").alias("external_id"), F.lit(1).alias("batch"), "text", "lang", "source")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(i.alias("internal_id"), i.alias("target"), i.cast("string").alias("external_id"), F.lit(1).alias("batch"), "p_name", "p_type", "p_brand", "p_size")


_BUILT: dict[tuple[str, ...], SearchIndex] = {}


def built(spark: SparkSession, sf_dir: str, table: str = "documents") -> SearchIndex:
    """The index of documents or of part, made once for an application; queries look up in it."""
    key = (spark.sparkContext.applicationId, tables.shared_dir(spark), sf_dir, table)
    if key not in _BUILT:
        if table == "documents":
            _BUILT[key] = SearchIndex.build(_read(spark, sf_dir, table).select("doc_id", "text", "lang", "source"), TEXT, "doc_id", ["doc_id"])
        else:
            docs = _read(spark, sf_dir, table).select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_brand", "p_size")
            _BUILT[key] = SearchIndex.build(docs, PART, order=["id"])
    return _BUILT[key]


def _own_ids(made: SearchIndex, rows: DataFrame) -> DataFrame:
    """rows with the table's own id as internal_id; versions were numbered in its order."""
    ids = made.tables["ids"].table.select(F.col("external_id").cast("bigint").alias("own"), "internal_id")
    return rows.join(ids, "internal_id").drop("internal_id").withColumnRenamed("own", "internal_id")


def _turns(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """conversations as versions of conv_id: the first turns, then all others as a batch of upserts."""
    key = (spark.sparkContext.applicationId, tables.shared_dir(spark), sf_dir, "conversations")
    if key not in _BUILT:
        rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
        made = SearchIndex.build(rows.where("turn = 0"), _TURN_CONFIG, "conv_id", ["turn", "conv_id"])
        _BUILT[key] = made.add(rows.where("turn > 0"), "conv_id", ["turn", "conv_id"])
    return _BUILT[key]


# --- SQL parts ---

_SPACE = text.SPACE
_WORDS = "list_filter(list_transform(regexp_split_to_array(lower(@), '" + _SPACE + "'), lambda w: regexp_replace(w, '[^a-z0-9]+', '', 'g')), lambda w: w <> '' AND w NOT IN ('a', 'the', 'and'))"


def _words(column: str) -> str:
    return _WORDS.replace("@", column)


def _posted(source: str, tokens: str) -> str:
    """CTEs post and voc of a source with internal_id."""
    return f"""tok AS (SELECT internal_id, {tokens} AS k FROM {source}),
post AS (SELECT term, internal_id, CAST(sum(100000 // len(k)) AS BIGINT) AS score FROM (SELECT internal_id, k, unnest(k) AS term FROM tok) GROUP BY ALL),
voc AS (SELECT term, min(internal_id) AS first_seen, count(*) AS doc_freq FROM post GROUP BY term)"""


_DOCS = "src AS (SELECT doc_id AS internal_id, * FROM documents), " + _posted("src", _words("coalesce(text, '')"))
_PART_TEXT = f"list_concat(list_concat({_words('p_name')}, {_words('p_type')}), {_words('p_brand')})"
_PARTS = "src AS (SELECT p_partkey AS internal_id, * FROM part), " + _posted("src", _PART_TEXT)


def _keys(w: str) -> str:
    return f"CASE WHEN length({w}) < 2 THEN [{w}] ELSE list_concat([{w}], list_transform(range(1, length({w}) + 1), lambda i: left({w}, i - 1) || substring({w}, i + 1))) END"


def _searched(q: str, seen: str = "post", k: int = K) -> str:
    """CTEs from q (query_id, text) to found (query_id, rank, internal_id, score); seen: the postings in sight."""
    return f"""qt AS (SELECT query_id, len(k) AS n_tokens, unnest(k) AS token, unnest(range(len(k))) AS group_id FROM (SELECT query_id, {_words('text')} AS k FROM {q})),
exact_ AS (SELECT *, 0 AS rank, token AS term FROM qt WHERE token IN (SELECT term FROM voc)),
comp AS (SELECT token, term, row_number() OVER (PARTITION BY token ORDER BY first_seen, term) AS place FROM (SELECT DISTINCT token FROM qt WHERE group_id = n_tokens - 1) JOIN voc ON starts_with(term, token) AND term <> token),
longer AS (SELECT qt.*, place AS rank, term FROM qt JOIN comp USING (token) WHERE group_id = n_tokens - 1 AND place <= CASE WHEN n_tokens = 1 THEN 3 ELSE 40 END),
qk AS (SELECT token, unnest(keys) AS key, unnest(range(len(keys))) AS key_pos FROM (SELECT token, {_keys('token')} AS keys FROM (SELECT DISTINCT token FROM qt))),
vk AS (SELECT DISTINCT term, first_seen, key FROM (SELECT term, first_seen, unnest({_keys('term')}) AS key FROM voc WHERE length(term) >= 4)),
near AS (SELECT token, term, row_number() OVER (PARTITION BY token ORDER BY key_pos, first_seen, term) AS place FROM (SELECT token, term, first_seen, min(key_pos) AS key_pos FROM qk JOIN vk USING (key) WHERE token <> term GROUP BY ALL)),
fuzzy AS (SELECT qt.*, place AS rank, term FROM qt JOIN near USING (token) WHERE (group_id < n_tokens - 1 AND place <= 10) OR (n_tokens = 1 AND place <= 3 AND token NOT IN (SELECT token FROM exact_) AND token NOT IN (SELECT token FROM longer))),
g AS (SELECT query_id, n_tokens, group_id, rank, term FROM exact_ UNION ALL SELECT query_id, n_tokens, group_id, rank, term FROM longer UNION ALL SELECT query_id, n_tokens, group_id, rank, term FROM fuzzy),
one AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, score DESC, internal_id) AS rank, internal_id, score FROM g JOIN {seen} USING (term) WHERE n_tokens = 1),
hit AS (SELECT query_id, n_tokens, group_id, internal_id, arg_min(score, rank) AS score FROM g JOIN {seen} USING (term) WHERE n_tokens > 1 GROUP BY ALL),
many AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, internal_id) AS rank, internal_id, score FROM (SELECT query_id, n_tokens, internal_id, CAST(sum(score) AS BIGINT) AS score FROM hit GROUP BY ALL HAVING count(*) = n_tokens)),
found AS (SELECT * FROM one WHERE rank <= {k} UNION ALL SELECT * FROM many WHERE rank <= {k})"""


def _query_rows(asked: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(n, q.replace("'", "''")) for n, q in enumerate(asked))
    return f"q AS (SELECT * FROM (VALUES {rows}) AS t(query_id, text))"


_FOUND = "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, internal_id, score FROM found"


def _register(name: str, made: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = made
    if sql:
        ORACLE_SQL[name] = sql


# --- tokens and tables of the index ---


def _tokenized(spark, d):
    return _documents(spark, d).select(F.col("internal_id").alias("doc_id"), F.array_join(text.tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


_register("tokenize_documents", _tokenized, f"WITH {_DOCS} SELECT internal_id AS doc_id, coalesce(array_to_string(k, ' '), '') AS tokens FROM tok")


def _lengths(spark, d):
    rows = _documents(spark, d)
    return rows.select(F.col("internal_id").alias("doc_id"), F.size(text.field_tokens(rows, ("text",))).cast("bigint").alias("n_tokens"))


_register("doc_lengths", _lengths, f"WITH {_DOCS} SELECT internal_id AS doc_id, CAST(len(k) AS BIGINT) AS n_tokens FROM tok")


def _postings(spark, d):
    return index.postings(_documents(spark, d), TEXT, whole=True).drop("arrival")


def _vocabulary(spark, d):
    return index.terms(index.postings(_documents(spark, d), TEXT, whole=True))


_register("postings_build", _postings, f"WITH {_DOCS} SELECT term, internal_id, score FROM post")
_register("vocabulary", lambda s, d: _vocabulary(s, d).select("term"), f"WITH {_DOCS} SELECT term FROM voc")
_register("doc_frequency", lambda s, d: _vocabulary(s, d).select("term", "doc_freq"), f"WITH {_DOCS} SELECT term, doc_freq FROM voc")
_register("term_sequence", lambda s, d: tables.numbered(_vocabulary(s, d), ["first_seen", "term"], "term_seq").select("term", "term_seq"), f"WITH {_DOCS} SELECT term, row_number() OVER (ORDER BY first_seen, term) AS term_seq FROM voc")

_NAMES = IndexConfig(("p_name",))
_NAME_SQL = "src AS (SELECT p_partkey AS internal_id, * FROM part), " + _posted("src", _words("p_name"))
_register("prefix_index_top", lambda s, d: index.prefix_table(index.terms(index.postings(_parts(s, d), _NAMES, whole=True))).drop("first_seen"), f"WITH {_NAME_SQL}, p AS (SELECT term, first_seen, unnest(list_transform(range(1, length(term)), lambda i: left(term, i))) AS prefix FROM voc WHERE length(term) >= 2) SELECT prefix, term, CAST(rank AS INTEGER) AS rank FROM (SELECT prefix, term, row_number() OVER (PARTITION BY prefix ORDER BY first_seen, term) AS rank FROM p) WHERE rank <= 400")
_register("delete_index", lambda s, d: index.deletion_table(index.terms(index.postings(_parts(s, d), _NAMES, whole=True))).select("key", "term"), f"WITH {_NAME_SQL} SELECT DISTINCT key, term FROM (SELECT term, unnest({_keys('term')}) AS key FROM voc WHERE length(term) >= 4)")
_register("multi_field_index", lambda s, d: index.postings(_parts(s, d), PART, whole=True).drop("arrival"), f"WITH {_PARTS} SELECT term, internal_id, score FROM post")


def _lines(spark, d):
    rows = _documents(spark, d).withColumn("text", F.split("text", "\n"))
    return index.postings(rows, TEXT, whole=True).drop("arrival")


_register("array_field_index", _lines, f"WITH src AS (SELECT doc_id AS internal_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT internal_id, flatten(list({_words('line')})) AS k FROM src GROUP BY internal_id) SELECT term, internal_id, CAST(sum(100000 // len(k)) AS BIGINT) AS score FROM (SELECT internal_id, k, unnest(k) AS term FROM t) GROUP BY ALL")

# --- filters ---


def _filtered(table, wanted):
    def run(spark, d):
        made = built(spark, d, table)
        return _own_ids(made, made.apply_filter(wanted))

    return run


_register("filter_or", _filtered("documents", {"lang": ["de", "fr"]}), f"WITH {_DOCS} SELECT internal_id FROM src JOIN tok USING (internal_id) WHERE lang IN ('de', 'fr') AND len(k) > 0")
_register("filter_and", _filtered("documents", {"lang": ["en", "es"], "source": ["src1", "src2", "src3"]}), f"WITH {_DOCS} SELECT internal_id FROM src JOIN tok USING (internal_id) WHERE lang IN ('en', 'es') AND source IN ('src1', 'src2', 'src3') AND len(k) > 0")
_register("filter_unknown", _filtered("documents", {"lang": ["en"], "colour": ["red"]}), "SELECT doc_id AS internal_id FROM documents WHERE false")
_register("filter_numeric", _filtered("part", {"p_size": [7, "11", 13.0]}), "SELECT p_partkey AS internal_id FROM part WHERE p_size IN (7, 11, 13)")

_register("filter_string", _filtered("documents", text.parse_filter("lang:de,junk,lang:fr")), ORACLE_SQL["filter_or"])


def _combined(spark, d):
    """lang de or fr, and of these src0 and src1: union and intersection of filters."""
    made = built(spark, d)
    langs = filters.union(made.apply_filter({"lang": ["de"]}), made.apply_filter({"lang": ["fr"]}))
    return _own_ids(made, filters.intersection(langs, made.apply_filter({"source": ["src0", "src1"]})))


_register("filter_union_intersection", _combined, f"WITH {_DOCS} SELECT internal_id FROM src JOIN tok USING (internal_id) WHERE lang IN ('de', 'fr') AND source IN ('src0', 'src1') AND len(k) > 0")

# --- ranked retrieval ---


def _one_term(spark, d, term, wanted=None):
    made = built(spark, d)
    return _own_ids(made, tables.local(made.search_one_term(term, wanted)))  # K rows at most


def _one_term_sql(term, where="true"):
    return f"WITH {_DOCS} SELECT CAST(row_number() OVER (ORDER BY score DESC, internal_id) AS INTEGER) AS rank, internal_id, score FROM post JOIN src USING (internal_id) WHERE term = '{term}' AND {where} ORDER BY score DESC, internal_id LIMIT {K}"


_register("search_one_term", lambda s, d: _one_term(s, d, "in"), _one_term_sql("in"))
_register("search_one_term_filtered", lambda s, d: _one_term(s, d, "in", {"lang": ["en"], "source": ["src0", "src1"]}), _one_term_sql("in", "lang = 'en' AND source IN ('src0', 'src1')"))


def _search(asked: list[str], wanted: dict | None = None):
    def run(spark, d):
        made = built(spark, d)
        queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")
        return _own_ids(made, tables.local(made.search_many(queries, wanted)))  # K rows a query at most

    return run


def _search_sql(asked: list[str], where: str | None = None) -> str:
    seen = f"seen AS (SELECT post.* FROM post JOIN src USING (internal_id) WHERE {where}), " if where else ""
    return f"WITH {_DOCS}, {_query_rows(asked)}, {seen}{_searched('q', 'seen' if where else 'post')} {_FOUND}"


for _name, _asked, _wanted, _where in [
    ("single_exact", ["that"], None, None),
    ("single_prefix", ["licen"], None, None),
    ("single_fuzzy", ["lixense"], None, None),
    ("single_dup_hits", ["license"], None, None),
    ("single_filtered", ["th"], {"lang": ["en"]}, "lang = 'en'"),
    ("multi_exact", ["the license version"], None, None),
    ("multi_fuzzy_prefix", ["licensd undr apac"], None, None),
    ("multi_filtered", ["in of that"], {"lang": ["en"], "source": ["src0", "src2"]}, "lang = 'en' AND source IN ('src0', 'src2')"),
    ("multi_missing_group", ["license zzzzqqqq under"], None, None),
    ("multi_repeated", ["that that"], None, None),
    ("empty_query", ["the a and"], None, None),
]:
    _register(_name, _search(_asked, _wanted), _search_sql(_asked, _where))


def _groups(spark, d):
    made = built(spark, d)
    return _own_ids(made, made.search_groups([["license", "licensed", "that"], ["version", "under", "in"]]))


_register("groups_first_match", _groups, f"WITH {_DOCS}, g AS (SELECT * FROM (VALUES (0, 0, 'license'), (0, 1, 'licensed'), (0, 2, 'that'), (1, 0, 'version'), (1, 1, 'under'), (1, 2, 'in')) AS t(group_id, rank, term)), hit AS (SELECT group_id, internal_id, arg_min(score, rank) AS s FROM g JOIN post USING (term) GROUP BY ALL), w AS (SELECT internal_id, CAST(sum(s) AS BIGINT) AS score FROM hit GROUP BY internal_id HAVING count(*) = 2) SELECT CAST(row_number() OVER (ORDER BY score DESC, internal_id) AS INTEGER) AS rank, internal_id, score FROM w ORDER BY score DESC, internal_id LIMIT {K}")

# --- a workload of many queries: one word, then three words, from every benchmark item ---


def _many(spark, d):
    first = F.slice(F.split("text", " "), 1, 3)
    items = _read(spark, d, "benchmark").select((F.col("item_id") * 2).alias("one"), first.alias("w"))
    queries = items.select(F.col("one").alias("query_id"), F.element_at("w", 1).alias("text")).unionByName(items.select((F.col("one") + 1).alias("query_id"), F.array_join("w", " ").alias("text")))
    made = built(spark, d)
    return _own_ids(made, made.search_many(queries))


_register("search_many", _many, f"WITH {_DOCS}, q AS (SELECT item_id * 2 AS query_id, string_split(text, ' ')[1] AS text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark), {_searched('q')} {_FOUND}")

# --- versions ---

_TURNS_SQL = "src AS (SELECT CAST(conv_id AS VARCHAR) AS external_id, turn, role, text, row_number() OVER (ORDER BY turn, conv_id) AS internal_id FROM conversations), last_ AS (SELECT external_id, max(internal_id) AS internal_id, arg_max(role, internal_id) AS role FROM src GROUP BY external_id)"
_TURN_CONFIG = IndexConfig(("text",), (), k=K)

_register("upsert_latest", lambda s, d: _turns(s, d).live().select("external_id", "internal_id", "text"), f"WITH {_TURNS_SQL} SELECT external_id, internal_id, src.text FROM src JOIN last_ USING (external_id, internal_id)")


def _posted_rows(made: SearchIndex) -> DataFrame:
    return made.postings.select("term", "internal_id", "score")


def _without_users(spark, d) -> SearchIndex:
    """Conversations that end with the user are deleted."""
    made = _turns(spark, d)
    return made.delete_many(made.live().where("role = 'user'").select("external_id"))


_KEPT = f"WITH {_TURNS_SQL}, live AS (SELECT src.* FROM src JOIN last_ USING (external_id, internal_id) WHERE last_.role <> 'user'), {_posted('live', _words('text'))}"
_register("delete_tombstone", lambda s, d: _posted_rows(_without_users(s, d).vacuum()), f"{_KEPT} SELECT term, internal_id, score FROM post")
_register("vacuum_rebuild", lambda s, d: _turns(s, d).vacuum().vocabulary.select("term", "doc_freq"), f"WITH {_TURNS_SQL}, live AS (SELECT src.* FROM src JOIN last_ USING (external_id, internal_id)), {_posted('live', _words('text'))} SELECT term, doc_freq FROM voc")
# until vacuum a batch's texts all count for the last version of their id in that batch, and dead terms stay
_BATCHES = f"WITH {_TURNS_SQL}, t AS (SELECT external_id, internal_id, max(internal_id) OVER (PARTITION BY external_id, turn > 0) AS target, {_words('text')} AS k FROM src), p AS (SELECT target, term, sum(100000 // len(k)) AS score, min(internal_id) AS arrival FROM (SELECT *, unnest(k) AS term FROM t) GROUP BY ALL)"
_register("upsert_postings", lambda s, d: _turns(s, d)._visible(None), f"{_BATCHES} SELECT term, target AS internal_id, CAST(score AS BIGINT) AS score FROM p WHERE target IN (SELECT internal_id FROM last_)")
_register("upsert_vocabulary", lambda s, d: _turns(s, d).vocabulary, f"{_BATCHES} SELECT term, min(arrival) AS first_seen, count(*) AS doc_freq FROM p GROUP BY term")
_register("stored_versions", lambda s, d: s.createDataFrame([(_turns(s, d).total_docs(),)], "n bigint"), "SELECT count(*) AS n FROM conversations")


def _one_deleted(spark, d):
    """delete() of one id, and of one that was never stored."""
    made, gone = _turns(spark, d).delete("1")
    made, absent = made.delete("none")
    return made.live().select("external_id", F.lit(gone).alias("deleted"), F.lit(absent).alias("absent"))


_register("delete_one", _one_deleted, "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS external_id, true AS deleted, false AS absent FROM conversations WHERE conv_id <> 1")


def _reloaded(spark, d):
    """A snapshot with dead versions; what is added after it goes on from its next id."""
    path = _folder(spark, "index")
    snapshot.save(_without_users(spark, d), path)
    made = snapshot.load(spark, path)
    return _posted_rows(made.upsert(spark.createDataFrame([("new", "fresh words")], "id string, text string")))


_register("snapshot_dead_versions", _reloaded, f"{_KEPT} SELECT term, internal_id, score FROM post UNION ALL SELECT term, (SELECT max(internal_id) + 1 FROM src), 50000 FROM (VALUES ('fresh'), ('words')) AS t(term)")

_DEAD = ["license", "lixense", "that license"]


def _dead_terms(spark, d):
    """Every document with a term is deleted: the term still counts as known, so it has no neighbours."""
    made = built(spark, d)
    holders = _own_ids(made, made.postings.where("term = 'license'").select("internal_id")).select(F.col("internal_id").cast("string").alias("external_id"))
    found = made.delete_many(holders).search_many(spark.createDataFrame(list(enumerate(_DEAD)), "query_id bigint, text string"))
    return _own_ids(made, tables.local(found))


_register("dead_terms", _dead_terms, f"WITH {_DOCS}, {_query_rows(_DEAD)}, seen AS (SELECT * FROM post WHERE internal_id NOT IN (SELECT internal_id FROM post WHERE term = 'license')), {_searched('q', 'seen')} {_FOUND}")


def _materialized(spark, d):
    return built(spark, d).search("th", {"lang": ["en", "de"]}).select("rank", "external_id", "score", "lang", "source", "text")


_register("search_materialized", _materialized, f"WITH {_DOCS}, {_query_rows(['th'])}, seen AS (SELECT post.* FROM post JOIN src USING (internal_id) WHERE lang IN ('en', 'de')), {_searched('q', 'seen')} SELECT CAST(rank AS INTEGER) AS rank, CAST(internal_id AS VARCHAR) AS external_id, score, lang, source, src.text FROM found JOIN src USING (internal_id)")
_register("kept_prefixes", lambda s, d: built(s, d, "part").prefixes(), f"WITH {_PARTS}, p AS (SELECT term, first_seen, unnest(list_transform(range(1, length(term)), lambda i: left(term, i))) AS prefix FROM voc WHERE length(term) >= 2) SELECT prefix, term, CAST(rank AS INTEGER) AS rank FROM (SELECT prefix, term, row_number() OVER (PARTITION BY prefix ORDER BY first_seen, term) AS rank FROM p) WHERE rank <= 400")


def _streamed(spark, d):
    """Turns as a stream of upserts, the sixth as a deletion; the last operation of an id wins."""
    from verbatlas.streaming.upserts import LiveIndex

    src = _folder(spark, "stream")
    rows = _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.when(F.col("turn") == 5, "delete").otherwise("upsert").alias("op"), F.col("turn").cast("bigint").alias("op_seq"), "text")
    rows.where("turn <= 5").write.parquet(src)
    live = LiveIndex(SearchIndex.empty(spark, _TURN_CONFIG))
    live.follow(spark.readStream.schema(rows.schema).parquet(src), _folder(spark, "stream-state")).awaitTermination()
    return live.index.live().select("external_id", "text")


_register("stream_latest", _streamed, "SELECT external_id, text FROM (SELECT CAST(conv_id AS VARCHAR) AS external_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE turn <= 5) WHERE r = 1 AND turn <> 5")


def _accumulated(spark, d):
    rows = _read(spark, d, "conversations").select("conv_id", "turn", "text")
    return _posted_rows(SearchIndex.build(rows, _TURN_CONFIG, "conv_id", ["turn", "conv_id"]))


_register("batch_duplicates_accumulate", _accumulated, f"WITH {_TURNS_SQL}, t AS (SELECT external_id, {_words('text')} AS k FROM src), p AS (SELECT external_id, k, unnest(k) AS term FROM t) SELECT term, internal_id, CAST(sum(100000 // len(k)) AS BIGINT) AS score FROM p JOIN last_ USING (external_id) GROUP BY ALL")

# --- dictionaries ---

_register("trie_complete", lambda s, d: dictionary.complete(_vocabulary(s, d).select("term", "doc_freq"), "th", 50), f"WITH {_DOCS} SELECT term, doc_freq FROM voc WHERE starts_with(term, 'th') ORDER BY doc_freq DESC, term LIMIT 50")


def _trie_fuzzy_sql(word: str, most: int, limit: int) -> str:
    return f"WITH {_DOCS}, n AS (SELECT term, CASE WHEN term = '{word}' THEN 0 WHEN length(term) < {len(word)} THEN 1 WHEN length(term) = {len(word)} THEN 2 ELSE 3 END AS kind FROM voc WHERE levenshtein(term, '{word}') <= {most}) SELECT term FROM n WHERE kind = (SELECT min(kind) FROM n) ORDER BY term LIMIT {limit}"


_register("trie_fuzzy", lambda s, d: dictionary.fuzzy(_vocabulary(s, d), "licens", 2, 20), _trie_fuzzy_sql("licens", 2, 20))
_register("trie_fuzzy_exact", lambda s, d: dictionary.fuzzy(_vocabulary(s, d), "license", 2, 20), _trie_fuzzy_sql("license", 2, 20))



def _changed_words(spark, d):
    """A dictionary of the words of part names: two inserted, one removed, one renamed; saved and loaded."""
    words = _read(spark, d, "part").select(F.explode(text.tokens("p_name")).alias("term"))
    made = dictionary.Dictionary.empty(spark).insert_all(words).insert("gear", "cog", "cog").remove("anvil").update("bolt", "screw")
    path = _folder(spark, "dictionary")
    made.save(path)
    return dictionary.Dictionary.load(spark, path).words


_register("dictionary_changes", _changed_words, f"SELECT term, CAST(count(*) AS BIGINT) AS doc_freq FROM (SELECT unnest({_words('p_name')}) AS term FROM part UNION ALL SELECT unnest(['gear', 'cog', 'cog', 'screw'])) WHERE term NOT IN ('anvil', 'bolt') GROUP BY term")


def _deletion_words(spark, d):
    made = dictionary.DeletionDictionary(spark, ["black", "block", "back", "blacks", "slack", "flack"]).add("blank").delete("slack")
    return spark.createDataFrame([(q, w) for q in ("blac", "lack", "blaxk", "zzz") for w in made.fuzzy(q, 9)], "query string, term string")


_register("deletion_dictionary", _deletion_words, f"WITH w AS (SELECT unnest(['black', 'block', 'back', 'blacks', 'flack', 'blank']) AS term), q AS (SELECT unnest(['blac', 'lack', 'blaxk', 'zzz']) AS query), wk AS (SELECT term, unnest({_keys('term')}) AS key FROM w), qk AS (SELECT query, unnest({_keys('query')}) AS key FROM q) SELECT DISTINCT query, term FROM wk JOIN qk USING (key) WHERE term <> query")


def _vocabulary_file(spark, d):
    path = _folder(spark, "vocabulary")
    sources.write_vocabulary(built(spark, d).vocabulary, path)
    return sources.read_vocabulary(spark, path)


_register("vocabulary_file", _vocabulary_file, f"WITH {_DOCS} SELECT term FROM voc")

# --- statistics ---

_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _stat_sql(place: str) -> str:
    cols = ", ".join(f"max(CASE WHEN r = {place.format(s)} THEN value END) AS {n}" for n, s in _SHARES.items())
    return f"WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, CAST(max(n) AS BIGINT) AS n, round(avg(value), 4) AS average, {cols} FROM v GROUP BY event_type"


def _stats(floor_index: bool):
    return lambda s, d: stats.percentiles(_read(s, d, "events"), "event_type", "value", _SHARES, floor_index).withColumn("average", F.round("average", 4))


_register("latency_percentiles", _stats(False), _stat_sql("greatest(1, CAST(ceil({} * n) AS BIGINT))"))
_register("latency_percentiles_floor", _stats(True), _stat_sql("CAST(floor({} * (n - 1)) AS BIGINT) + 1"))

# --- sources and sinks: each writes and reads back ---


def _csv(spark, d):
    path = _folder(spark, "csv")
    _read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size").write.csv(path, header=True, quote='"', escape='"')
    return sources.read_csv(spark, path).select("id", "p_name", "p_brand", "p_size")


_register("csv_ingest", _csv, "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")


def _json(spark, d):
    path = _folder(spark, "json")
    rows = _read(spark, d, "benchmark").select(F.pmod(F.xxhash64("item_id"), F.lit(8)).alias("file"), F.to_json(F.struct(F.col("item_id").alias("id"), "text")).alias("j"))
    rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.partitionBy("file").text(path)  # eight files, each an array
    found = sources.read_json_array(spark, path)
    return found.select(text.canonical(found, "id").alias("id"), F.try_variant_get("text", "$", "string").alias("text"))


_register("json_ingest", _json, "SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark")


def _round_trip(spark, d):
    docs = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_brand", "p_size")
    made = SearchIndex.build(docs, PART, order=["id"])
    path = _folder(spark, "index")
    snapshot.save(made, path)
    return snapshot.load(spark, path).postings.select("term", "internal_id", "score")


_register("save_load_roundtrip", _round_trip, f"WITH src AS (SELECT row_number() OVER (ORDER BY p_partkey) AS internal_id, * FROM part), {_posted('src', _PART_TEXT)} SELECT term, internal_id, score FROM post")


def _service(spark, d):
    """Create, upload, upsert, delete and search by requests, over nation (25 rows at any scale)."""
    from verbatlas.service import SearchService

    service = SearchService(spark, _folder(spark, "service"))
    docs = [{"id": r.n_nationkey, "name": r.n_name, "region": r.n_regionkey} for r in _read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    steps = [
        ("POST", "/create-index", {}, json.dumps({"indexName": "nations", "indexFields": ["name"], "filters": ["region"], "resultCount": 50}).encode(), None),
        ("POST", "/add-to-index", {"indexName": "nations"}, b"", json.dumps(docs).encode()),
        ("POST", "/document", {"indexName": "nations"}, json.dumps({"document": {"id": 3, "name": "moved elsewhere", "region": 1}}).encode(), None),
        ("DELETE", "/document", {"indexName": "nations", "id": "4"}, b"", None),
        ("POST", "/save-controller", {}, json.dumps({"indexName": "nations"}).encode(), None),
        ("POST", "/load-controller", {}, json.dumps({"indexName": "nations"}).encode(), None),
    ]
    answers = [service.handle(*step) for step in steps]
    found = service.handle("GET", "/search", {"index": "nations", "q": "nation", "filter": "region:1,region:2"})[1]["response"]["Docs"]
    rows = [("status", str(n), str(a[0])) for n, a in enumerate(answers)] + [("hit", str(h["ID"]), h["Data"]["name"]) for h in found]
    return spark.createDataFrame(rows, "kind string, id string, shown string")


# "NATION_7" is the one token nation7, so that completions of "nation" answer: the first three in order of appearance
_register("service_requests", _service, "WITH n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation WHERE n_nationkey NOT IN (3, 4)) SELECT 'status' AS kind, CAST(i AS VARCHAR) AS id, CASE WHEN i = 0 THEN '201' ELSE '200' END AS shown FROM range(6) AS t(i) UNION ALL SELECT 'hit', CAST(n_nationkey AS VARCHAR), n_name FROM n JOIN nation USING (n_nationkey, n_name) WHERE r <= 3 AND n_regionkey IN (1, 2)")
