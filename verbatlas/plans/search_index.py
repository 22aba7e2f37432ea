"""A search index as immutable generations of tables; every change gives a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verbatlas.config import IndexConfig
from verbatlas.functions import text
from verbatlas.operators import expand, filters, index, search
from verbatlas.tables import Segments, among, file_bytes, local, numbered, stored, tasks

#: Schema and sort key of each table. terms, prefixes and deletions are looked up by their first column.
TABLES = {
    "documents": ("internal_id bigint, external_id string, batch int", ("internal_id",)),
    "ids": ("external_id string, internal_id bigint", ("external_id", "internal_id")),
    "tombstones": ("internal_id bigint", ("internal_id",)),
    "postings": ("term string, internal_id bigint, score bigint, arrival bigint", ("term", "internal_id")),
    "terms": ("term string, first_seen bigint, doc_freq bigint", ("term",)),
    "prefixes": ("prefix string, term string, first_seen bigint", ("prefix", "first_seen")),
    "deletions": ("key string, term string, first_seen bigint", ("key", "term")),
    "filters": ("field string, value string, internal_id bigint", ("field", "value", "internal_id")),
}
#: Prefixes or deletions of a term, about; for the number of tasks.
KEYS_OF_TERM = 8
#: Batches up to so many rows find their older versions and known terms by filters on the stored tables.
FEW_ROWS = 200
#: Groups of query terms up to so many rows are sent to all tasks; beyond that the join shuffles.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class SearchIndex:
    """tables: the parts of every table in TABLES. Until vacuum() dead versions keep their terms in the vocabulary."""

    config: IndexConfig
    tables: dict[str, Segments]
    next_id: int = 1
    batches: int = 0

    @property
    def documents(self) -> DataFrame:
        """Every stored version."""
        return self.tables["documents"].table

    @property
    def tombstones(self) -> DataFrame:
        """(internal_id) of dead versions."""
        return self.tables["tombstones"].table.distinct()

    @property
    def postings(self) -> DataFrame:
        return self.tables["postings"].table

    @property
    def vocabulary(self) -> DataFrame:
        """(term, first_seen, doc_freq); a version counts in one batch only, so batches add up."""
        return self.tables["terms"].table.groupBy("term").agg(F.min("first_seen").alias("first_seen"), F.sum("doc_freq").alias("doc_freq"))

    @property
    def filter_values(self) -> DataFrame:
        return self.tables["filters"].table

    # --- making and changing ---

    @staticmethod
    def empty(spark: SparkSession, config: IndexConfig) -> SearchIndex:
        return SearchIndex(config, {n: Segments(n, by, spark.createDataFrame([], schema)) for n, (schema, by) in TABLES.items()})

    @staticmethod
    def build(docs: DataFrame, config: IndexConfig, id_column: str = "id", order: list | None = None) -> SearchIndex:
        return SearchIndex.empty(docs.sparkSession, config).add(docs, id_column, order)

    @staticmethod
    def restored(config: IndexConfig, documents: DataFrame, tombstones: DataFrame, next_id: int, batches: int) -> SearchIndex:
        """An index of stored versions and tombstones, rebuilt from the live ones."""
        bare = SearchIndex.empty(documents.sparkSession, config)._appended(documents=documents, ids=documents.select("external_id", "internal_id"), tombstones=tombstones)
        return replace(bare, next_id=next_id, batches=batches).vacuum()

    def add(self, docs: DataFrame, id_column: str = "id", order: list | None = None, tokenless: bool = False) -> SearchIndex:
        """A batch. Rows without an id (null, empty or "<nil>") are left out. order: of arrival, else the id's.

        What is written grows with the batch: each table gets a part, and parts of like size are merged.
        """
        if id_column not in docs.columns:
            return self
        external = text.canonical(docs, id_column, self.config.go_float_format)
        if external is None:
            raise ValueError(f"{id_column} can't be an id")
        rows = docs.withColumn("external_id", external).where("external_id is not null and external_id not in ('', '<nil>')")
        rows = numbered(rows, order or ["external_id"], "internal_id").withColumn("internal_id", F.col("internal_id") + (self.next_id - 1)).withColumn("batch", F.lit(self.batches + 1))
        rows = stored(rows, "documents", ("internal_id",), ordered=True)
        count, parts = rows.count(), tasks(rows.sparkSession, size=file_bytes(rows))
        whole = rows.agg(F.count_distinct("external_id")).first()[0] == count
        targets = rows.withColumn("target", F.col("internal_id")) if whole else index.targets(rows, self.config, parts)
        older = among(self.tables["ids"].table, "external_id", rows.select("external_id"), count <= FEW_ROWS).select("external_id", "internal_id")
        versions = rows.select("external_id", "internal_id").unionByName(older)
        last = F.max("internal_id").over(W.partitionBy("external_id"))
        dead = versions.withColumn("last", last).where("internal_id <> last").select("internal_id")
        found = self._joined(documents=rows)._appended(ids=rows.select("external_id", "internal_id"), tombstones=dead, filters=index.filter_table(targets, self.config, tokenless, whole))
        return replace(found, next_id=self.next_id + count, batches=self.batches + 1)._posted(index.postings(targets, self.config, whole), parts)

    def _posted(self, posted: DataFrame, parts: int | None = None) -> SearchIndex:
        """With the postings of a batch; prefixes and deletions only of terms not seen before."""
        posted = stored(posted, "postings", TABLES["postings"][1], parts)
        terms = stored(index.terms(posted), "terms", TABLES["terms"][1])
        count = terms.count()
        new = terms
        if self.tables["terms"].rows:
            known = among(self.tables["terms"].table.select("term"), "term", terms.select("term"), count <= FEW_ROWS)
            new = terms.join(known if count <= FEW_ROWS else known.hint("merge"), "term", "left_anti")
        prefixes = index.prefix_table(new, self.config.prefix_cap).drop("rank")
        found, parts = self._joined(postings=posted, terms=terms), tasks(terms.sparkSession, KEYS_OF_TERM * count)
        return found._appended(parts, prefixes=prefixes, deletions=index.deletion_table(new, self.config.fuzzy_length))

    def _appended(self, parts: int | None = None, **rows: DataFrame) -> SearchIndex:
        return replace(self, tables={**self.tables, **{n: self.tables[n].appended(df, parts) for n, df in rows.items()}})

    def _joined(self, **parts: DataFrame) -> SearchIndex:
        return replace(self, tables={**self.tables, **{n: self.tables[n].joined(df) for n, df in parts.items()}})

    def upsert(self, doc: DataFrame, id_column: str = "id") -> SearchIndex:
        """One document; an id that is missing or empty is an error here."""
        if id_column not in doc.columns or not doc.where(F.col(id_column).isNotNull() & ~F.col(id_column).cast("string").isin("", "<nil>")).take(1):
            raise ValueError("document has no id")
        return self.add(doc, id_column, tokenless=True)

    def delete(self, external_id: str) -> tuple[SearchIndex, bool]:
        """Marks the last version of an id dead; False if the id was never stored."""
        last = self.tables["ids"].table.where(F.col("external_id") == str(external_id)).agg(F.max("internal_id")).first()[0] if external_id else None
        if last is None:
            return self, False
        return self._appended(tombstones=self.documents.sparkSession.createDataFrame([(last,)], "internal_id bigint")), True

    def delete_many(self, external_ids: DataFrame) -> SearchIndex:
        """Marks the last versions of all ids (external_id) dead; unknown ids are passed over."""
        last = among(self.tables["ids"].table, "external_id", external_ids.select("external_id"), False).groupBy("external_id").agg(F.max("internal_id").alias("internal_id"))
        return self._appended(tombstones=last.select("internal_id"))

    def live(self) -> DataFrame:
        return self._alive(self.documents)

    def vacuum(self) -> SearchIndex:
        """Postings, vocabulary and filters of live versions alone, from their own texts; versions stay stored."""
        rows = self.live().withColumn("target", F.col("internal_id"))
        bare = {n: replace(self.tables[n], parts=()) for n in ("postings", "terms", "prefixes", "deletions", "filters")}
        found = replace(self, tables={**self.tables, **bare}, batches=self.batches + 1)
        parts = tasks(rows.sparkSession, size=file_bytes(self.documents))
        return found._appended(filters=index.filter_table(rows, self.config, whole=True))._posted(index.postings(rows, self.config, whole=True), parts)

    def total_docs(self) -> int:
        """Stored versions, dead ones too."""
        return self.tables["documents"].rows

    # --- asking ---

    def prefixes(self) -> DataFrame:
        """(prefix, term, rank)"""
        rank = F.row_number().over(W.partitionBy("prefix").orderBy("first_seen", "term"))
        return self.tables["prefixes"].table.withColumn("rank", rank).where(F.col("rank") <= self.config.prefix_cap).select("prefix", "term", "rank")

    def deletions(self) -> DataFrame:
        return self.tables["deletions"].table

    def apply_filter(self, wanted: dict[str, list]) -> DataFrame | None:
        return filters.allowed(self.filter_values, wanted) if wanted else None

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows without those of dead versions. Up to a checked number these are sent to all tasks, so that rows stay
        where they are; more are never sent, however small their files."""
        dead = self.tables["tombstones"]
        if not dead.rows:
            return rows
        return rows.join(F.broadcast(dead.table) if dead.rows <= MOST_SENT else dead.table.hint("merge"), "internal_id", "left_anti")

    def _visible(self, wanted: dict[str, list] | None, terms: list[str] | DataFrame | None = None) -> DataFrame:
        """Postings in sight; terms, if given, are all that will be asked for: a list reaches the scan, a table (term)
        comes before all other joins."""
        out = self.postings.select("term", "internal_id", "score")
        if isinstance(terms, list):
            out = out.where(F.col("term").isin(terms))
        elif terms is not None:
            out = out.join(terms, "term", "left_semi")
        out = self._alive(out)
        passed = self.apply_filter(wanted or {})
        return out if passed is None else out.join(passed, "internal_id", "left_semi")

    def search_many(self, queries: DataFrame, wanted: dict[str, list] | None = None, k: int | None = None) -> DataFrame:
        """(query_id, rank, internal_id, score) of queries (query_id, text), all in one job."""
        k = self.config.k if k is None else k
        if k < 0:
            raise ValueError("k is negative")
        lookup = (self.vocabulary, self.tables["prefixes"].table, self.tables["deletions"].table, self.config)
        asked = expand.query_tokens(queries, self.config)
        first = asked.limit(expand.FEW + 1).collect()
        if len(first) > expand.FEW:
            asked = stored(asked, "asked")
            vocabulary, few = self.tables["terms"].table.select("term"), asked.count() <= MOST_SENT // 10
            groups = stored(expand.expansions(F.broadcast(asked) if few else asked, vocabulary, *lookup[1:], few), "groups")
            sent = F.broadcast if groups.count() <= MOST_SENT else lambda df: df
            return self._ranked(sent(groups), self._visible(wanted, sent(groups.select("term").distinct())), k)
        found = expand.expansions_of_few(first, *lookup)
        kinds = ", ".join([f"query_id {dict(asked.dtypes)['query_id']}", "n_tokens int, group_id int, rank int, term string"])
        groups = F.broadcast(queries.sparkSession.createDataFrame(found, kinds))
        return self._ranked(groups, self._visible(wanted, sorted({r[4] for r in found})), k, {r[1] == 1 for r in found})

    def _ranked(self, groups: DataFrame, visible: DataFrame, k: int, kinds: set[bool] = frozenset()) -> DataFrame:
        """kinds: whether there are groups of queries of one token (True), of more (False); both if not told."""
        one = search.ranked_union(groups.where("n_tokens = 1"), visible, k)
        many = search.all_groups(groups.where("n_tokens > 1").withColumnRenamed("n_tokens", "n_groups"), visible, k)
        return one.unionByName(many) if len(kinds) != 1 else one if kinds == {True} else many

    def search(self, query: str, wanted: dict[str, list] | None = None) -> DataFrame | None:
        """(rank, id, score, internal_id and the document's columns) by rank; None if the query has no tokens."""
        if not text.tokenize(query, self.config.stop_words):
            return None
        queries = self.documents.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
        return self.materialized(local(self.search_many(queries, wanted)), self.config.k <= FEW_ROWS).drop("query_id").orderBy("rank")

    def search_one_term(self, term: str, wanted: dict[str, list] | None = None) -> DataFrame:
        return search.one_term(self._visible(wanted, [term]), term, self.config.k)

    def search_groups(self, groups: list[list[str]], wanted: dict[str, list] | None = None) -> DataFrame:
        """(rank, internal_id, score) for explicit groups of terms; an empty group matches nothing."""
        spark = self.documents.sparkSession
        rows = [(0, len(groups), g, r, t) for g, ts in enumerate(groups) for r, t in enumerate(ts)]
        asked = F.broadcast(spark.createDataFrame(rows, "query_id int, n_groups int, group_id int, rank int, term string"))
        return search.all_groups(asked, self._visible(wanted, sorted({r[4] for r in rows})), self.config.k).drop("query_id")

    def materialized(self, hits: DataFrame, few: bool = False) -> DataFrame:
        """hits with the documents' columns, looked up for the k best of each query only; few: as in among()."""
        docs = self.documents.drop("batch")
        return hits.join(among(docs, "internal_id", hits.select("internal_id"), True) if few else docs, "internal_id")
