"""Applies a stream of documents and deletions to an index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from verbatlas.plans.search_index import SearchIndex
from verbatlas.tables import stored


class LiveIndex:
    """Holds the newest generation; readers keep the one they took."""

    def __init__(self, index: SearchIndex):
        self.index, self.done = index, -1

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """batch: id, op ("upsert" or "delete"), op_seq and fields. The last op of an id wins; epochs apply once."""
        if epoch <= self.done:
            return
        last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("op_seq")))
        ops = stored(batch.withColumn("_n", last).where("_n = 1").drop("_n"), "ops")
        index = self.index
        upserts = ops.where("op = 'upsert'").drop("op")
        if upserts.take(1):
            index = index.add(upserts, order=["op_seq"])
        gone = ops.where("op = 'delete'").select(F.col("id").cast("string").alias("external_id"))
        self.index, self.done = index.delete_many(gone), epoch

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
