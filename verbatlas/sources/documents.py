"""Document batches from JSON arrays, CSV files, rows and vocabulary files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of objects; each field a variant, so that every document keeps its kinds.

    null and [] are no documents; null elements have null fields, so they drop out for want of an id.
    """
    whole = spark.read.text(path, wholetext=True)
    element = whole.select(F.posexplode(F.parse_json("value").cast("array<variant>")).alias("position", "doc"))
    names = [r.name for r in element.select(F.explode(F.map_keys(F.try_variant_get("doc", "$", "map<string,variant>"))).alias("name")).distinct().orderBy("name").collect()]
    fields = [F.try_variant_get("doc", f"$['{n}']" if "'" not in n else f'$["{n}"]', "variant").alias(n) for n in names]
    return element.select("position", *fields)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and text columns; ragged rows are errors, empty cells empty strings, no data row an error."""
    out = spark.read.csv(path, header=True, mode="FAILFAST", quote='"', escape='"', multiLine=True).na.fill("")
    if not out.take(1):
        raise ValueError("a CSV file needs a header and a row")
    return out


def from_json_text(spark: SparkSession, text: str) -> list[dict]:
    """The elements of an upload that is a JSON array; ValueError for anything else. null is an empty document: it
    counts as sent and has no id."""
    found = json.loads(text)
    if found is None:
        return []
    if not isinstance(found, list) or not all(d is None or isinstance(d, dict) for d in found):
        raise ValueError("not an array of objects")
    return [d or {} for d in found]


def from_rows(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Documents as variants by field, in order of position."""
    lines = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "position bigint, value string")
    names = sorted({n for d in docs for n in d})
    doc = F.parse_json("value")
    fields = [F.try_variant_get(doc, "$[\"" + n + "\"]", "variant").alias(n) for n in names]
    return lines.select("position", *fields)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a file of one word a line; blanks are skipped, no word at all is an error."""
    out = spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''")
    if not out.take(1):
        raise ValueError("empty vocabulary")
    return out


def write_vocabulary(words: DataFrame, path: str) -> None:
    words.select(F.col("term").alias("value")).write.mode("overwrite").text(path)
