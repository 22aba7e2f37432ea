"""Each document beside the one that follows it, without one global sort in a single task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common

ROWS = 1000  # aimed at in a bucket
MOST = 20_000  # buckets; beyond it they grow, and they are only streamed through


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, borrowed, doc_id, text), dealt out by bucket and sorted in descending doc_id.

    A bucket is a range of ids; behind its rows comes, borrowed, the first row of the next bucket that has
    rows (behind the last that of the first). Equal ids are in one bucket, by text; null ids come last.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("order", F.coalesce("doc_id", F.lit(-(2**63))))
    total = docs.count()
    n = max(1, min(MOST, -(-total // ROWS)))
    cuts = docs.select("order").approxQuantile("order", [i / n for i in range(1, n)], min(0.01, 0.2 / n)) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, order.to_numpy(), "right").astype("int32"))

    dealt = docs.withColumn("bucket", bucket("order"))
    heads = sorted((r.bucket, r.first) for r in dealt.groupBy("bucket").agg(F.max("order").alias("first")).collect())  # MOST rows at most
    lent = [(first, heads[(k + 1) % len(heads)][0]) for k, (_, first) in enumerate(heads)]  # to the bucket above; the highest to the lowest
    lent_to = F.broadcast(spark.createDataFrame(lent or [(0, -1)], "order bigint, lent int"))
    own = dealt.join(lent_to, "order", "left").select("doc_id", "order", "text", F.explode(F.array(F.struct(F.col("bucket"), F.lit(False).alias("borrowed")), F.struct(F.col("lent").alias("bucket"), F.lit(True).alias("borrowed")))).alias("to"))
    rows = own.where("to.bucket is not null").select("to.bucket", "to.borrowed", "doc_id", "order", "text")
    return rows.repartition(common.n_partitions(spark), "bucket").sortWithinPartitions("bucket", "borrowed", F.desc("order"), "text").drop("order")
