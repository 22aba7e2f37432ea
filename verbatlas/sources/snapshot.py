"""Snapshots of an index: its stored versions and tombstones as Parquet, and its settings."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.config import IndexConfig
from verbatlas.plans.search_index import SearchIndex


def save(index: SearchIndex, path: str) -> None:
    spark = index.documents.sparkSession
    index.documents.write.mode("overwrite").parquet(f"{path}/versions")
    index.tombstones.write.mode("overwrite").parquet(f"{path}/tombstones")
    meta = json.dumps({"config": asdict(index.config), "next_id": index.next_id, "batches": index.batches})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def next_id(documents: DataFrame) -> int:
    """For snapshots that don't tell: one more than the largest id."""
    return (documents.agg(F.max("internal_id")).first()[0] or 0) + 1


def load(spark: SparkSession, path: str) -> SearchIndex:
    """The saved index, rebuilt from its live versions alone."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    documents, tombstones = spark.read.parquet(f"{path}/versions"), spark.read.parquet(f"{path}/tombstones")
    return SearchIndex.restored(IndexConfig(**meta["config"]), documents, tombstones, meta.get("next_id") or next_id(documents), meta.get("batches", 1))
