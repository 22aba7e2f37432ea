"""Latency statistics by group: nearest-rank and floor-index percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.tables import running


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], floor_index: bool = False) -> DataFrame:
    """One row for each group: n, average, and the value at each share's rank (the ceiling of share * n, at
    least 1; by floor index one more than the floor of share * (n - 1))."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("times"))
    upto = running(counted, [group, value], "times", "upto")  # over all groups, in ranges: a large group is many tasks
    whole = upto.groupBy(F.col(group).alias("_group")).agg(F.sum("times").alias("n"), F.min(F.col("upto") - F.col("times")).alias("before"), (F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("average"))
    ranked = upto.join(whole, F.col(group).eqNullSafe(F.col("_group"))).withColumn("upto", F.col("upto") - F.col("before"))

    def place(share: float) -> Column:
        n = F.col("n")
        return F.floor(F.lit(share) * (n - 1)) + 1 if floor_index else F.greatest(F.lit(1), F.ceil(F.lit(share) * n))

    found = [F.min(F.when(F.col("upto") >= place(s), F.col(value))).alias(name) for name, s in shares.items()]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), F.max("average").alias("average"), *found)
