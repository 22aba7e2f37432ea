"""Filter resolution: OR among the values of a field, AND across fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed(filter_values: DataFrame, filters: dict[str, list]) -> DataFrame:
    """(internal_id) that pass; unknown fields, unseen values and empty lists let nothing pass."""
    wanted = [(F.col("field") == name) & F.col("value").isin(*[_text(v) for v in values]) if values else F.lit(False) for name, values in filters.items()]
    hits = filter_values.where(reduce(lambda a, b: a | b, wanted))
    return hits.groupBy("internal_id").agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(filters)).select("internal_id")


def _text(value) -> str:
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "internal_id", "left_semi").distinct()
