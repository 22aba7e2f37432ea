"""Tables in the folder that all machines share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Of sorted tables: small row groups, so that a filter on the sort key skips nearly all of them.
ROW_GROUP = 8 << 20
#: Narrow rows, and bytes of stored texts, that one task sorts at most: far below its memory, so that nothing is spilled.
TASK_ROWS, TASK_BYTES = 2_000_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. One machine alone may make its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="verbatlas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_bytes(df: DataFrame) -> int:
    """Of the files that df reads; 0 if it reads none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(n) for n in range(leaves.size())]
    return sum(int(p.stats().sizeInBytes()) for p in found if p.getClass().getSimpleName() == "LogicalRelation")


def tasks(spark: SparkSession, rows: int = 0, size: int = 0) -> int | None:
    """Partitions for so many narrow rows or bytes of texts; None if Spark's usual number of them is enough."""
    wanted = max(-(-rows // TASK_ROWS), -(-size // TASK_BYTES))
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def by_ranges(df: DataFrame, by: Iterable, parts: int | None = None) -> DataFrame:
    """df sorted, by ranges of these columns."""
    by = list(by)
    return (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def stored(df: DataFrame, name: str, by: Iterable[str] = (), parts: int | None = None, ordered: bool = False) -> DataFrame:
    """df as a table; by: its files are ranges of these columns, sorted, for filters on the first of them; parts: of
    tasks(); ordered: df comes in that order from files that are such ranges."""
    path, writer = f"{shared_dir(df.sparkSession)}/verbatlas/{name}-{uuid.uuid4().hex}", df.write
    if by:
        writer = (df if ordered else by_ranges(df, by, parts)).write.option("parquet.block.size", ROW_GROUP)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(table: DataFrame, column: str, keys: DataFrame, few: bool) -> DataFrame:
    """table's rows whose column is in keys' first column; few: keys are of a checked number and go into the scan;
    others are never sent to the driver or to all tasks, however small their files."""
    if few:
        return table.where(F.col(column).isin([r[0] for r in keys.collect()]))
    return table.join(keys.toDF(column).distinct().hint("merge"), column, "left_semi")


def local(df: DataFrame) -> DataFrame:
    """df, of a checked size, computed once and sent to all tasks."""
    return F.broadcast(df.sparkSession.createDataFrame(df.collect(), df.schema))


@dataclass(frozen=True)
class Segments:
    """A table as stored parts, oldest first, each over twice the size of all after it; so there are few of them and
    a row is rewritten a logarithmic number of times."""

    name: str
    by: tuple[str, ...]
    empty: DataFrame
    parts: tuple[tuple[int, DataFrame], ...] = ()

    @property
    def table(self) -> DataFrame:
        return _union([p for _, p in self.parts]) if self.parts else self.empty

    @property
    def rows(self) -> int:
        return sum(n for n, _ in self.parts)

    def appended(self, rows: DataFrame, parts: int | None = None) -> Segments:
        return self.joined(stored(rows, self.name, self.by, parts))

    def joined(self, part: DataFrame) -> Segments:
        """With a part that is stored already."""
        total = part.count()
        if not total:
            return self
        at = len(self.parts)
        while at and self.parts[at - 1][0] <= 2 * total:
            at -= 1
            total += self.parts[at][0]
        if at < len(self.parts):
            part = _union([*(p for _, p in self.parts[at:]), part])
            part = stored(part, self.name, self.by, tasks(part.sparkSession, total, file_bytes(part)))
        return Segments(self.name, self.by, self.empty, (*self.parts[:at], (total, part)))

    def replaced(self, rows: DataFrame) -> Segments:
        return Segments(self.name, self.by, self.empty).appended(rows)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with name, 1, 2, ... in an order, by ranges of it rather than in one task."""
    spark = df.sparkSession
    kept = stored(by_ranges(df, order, tasks(spark, size=file_bytes(df))).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    base, total = [], 0
    for p, n in counts:
        base.append((p, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(base, "part bigint, base bigint"))
    return kept.withColumn("part", part).join(bases, "part").withColumn(name, F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "base", "_at")


def running(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """df with name, the sum of amount up to each row in an order, by ranges of it rather than in one task."""
    kept = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "running")
    base, total = [], 0
    for p, n in sorted((r._part, r.n) for r in kept.groupBy("_part").agg(F.sum(amount).alias("n")).collect()):  # a row for each partition
        base.append((p, total))
        total += n
    bases = F.broadcast(df.sparkSession.createDataFrame(base, "_part int, _base bigint"))
    within = F.sum(amount).over(W.partitionBy("_part").orderBy(*order))
    return kept.withColumn(name, within).join(bases, "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")
