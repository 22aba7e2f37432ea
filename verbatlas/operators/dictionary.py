"""A dictionary of words with insert counts: completion, edit-distance lookup, insert, remove, update."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.tables import stored


def complete(words: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Words that start with prefix, itself included, by count, then alphabet; words: term, doc_freq."""
    return words.where(F.col("term").startswith(prefix)).orderBy(F.desc("doc_freq"), "term").limit(limit)


def fuzzy(words: DataFrame, query: str, most: int, limit: int) -> DataFrame:
    """(term): the query itself if it is a word; else, within the distance, the first length class that has
    any word (shorter, as long, longer), by alphabet."""
    near = words.select("term", F.levenshtein(F.col("term"), F.lit(query), most).alias("distance")).where("distance >= 0")
    kind = F.when(F.col("distance") == 0, 0).when(F.length("term") < len(query), 1).when(F.length("term") == len(query), 2).otherwise(3)
    classed = near.withColumn("kind", kind)
    first = classed.agg(F.min("kind").alias("kind"))
    return classed.join(F.broadcast(first), "kind").orderBy("term").limit(limit).select("term")  # first is one row


class Dictionary:
    """Immutable: each change gives a new one."""

    def __init__(self, words: DataFrame):
        self.words = words

    @staticmethod
    def empty(spark: SparkSession) -> Dictionary:
        return Dictionary(spark.createDataFrame([], "term string, doc_freq bigint"))

    def _changed(self, words: DataFrame) -> Dictionary:
        return Dictionary(stored(words.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq")), "dictionary"))

    def insert(self, *new: str) -> Dictionary:
        rows = self.words.sparkSession.createDataFrame([(w, 1) for w in new], "term string, doc_freq bigint")
        return self._changed(self.words.unionByName(rows))

    def insert_all(self, terms: DataFrame) -> Dictionary:
        return self._changed(self.words.unionByName(terms.select("term", F.lit(1).cast("bigint").alias("doc_freq"))))

    def _known(self, word: str) -> None:
        if not self.words.where(F.col("term") == word).take(1):
            raise KeyError(word)

    def remove(self, word: str) -> Dictionary:
        self._known(word)
        return self._changed(self.words.where(F.col("term") != word))

    def update(self, old: str, new: str) -> Dictionary:
        self._known(old)
        return self.remove(old).insert(new)

    def complete(self, prefix: str, limit: int) -> list[str]:
        return [r.term for r in complete(self.words, prefix, limit).collect()]

    def fuzzy(self, query: str, most: int, limit: int) -> list[str]:
        return [r.term for r in fuzzy(self.words, query, most, limit).collect()]

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionary:
        """What was saved; an empty dictionary if nothing was."""
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return Dictionary.empty(spark)
        return Dictionary(spark.read.parquet(path))


class DeletionDictionary:
    """Words under their deletions, in order of insertion; a lookup finds words whose deletions meet its own."""

    def __init__(self, spark: SparkSession, words: Iterable[str] = ()):
        self.spark = spark
        self.words = list(dict.fromkeys(words))

    def add(self, word: str) -> DeletionDictionary:
        return DeletionDictionary(self.spark, [*self.words, word])

    def delete(self, word: str) -> DeletionDictionary:
        return DeletionDictionary(self.spark, [w for w in self.words if w != word])

    def fuzzy(self, query: str, most: int) -> list[str]:
        from verbatlas.operators.expand import asked_keys, neighbours
        from verbatlas.operators.index import deletion_table

        vocabulary = self.spark.createDataFrame([(w, k) for k, w in enumerate(self.words)], "term string, first_seen bigint")
        asked = self.spark.createDataFrame([(query,)], "token string")
        return [r.term for r in neighbours(asked_keys(asked), deletion_table(vocabulary, shortest=0), most).orderBy("place").collect()]
