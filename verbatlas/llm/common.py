"""What the operators of this package share: input columns, shared tables, code on the executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def picked(df: DataFrame, **kinds: str) -> DataFrame:
    """Those columns alone, cast to the types given, null where the table has none.

    They are found by place, so other columns of the same name in another case can't clash.
    """
    apart = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    out: list[Column] = []
    for name, kind in kinds.items():
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
        out.append((F.col(f"_{at[0]}") if at else F.lit(None)).cast(kind).alias(name))
    return apart.select(*out)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only; a null text is empty."""
    return picked(docs, doc_id="bigint", text="string").na.fill("", ["text"])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Where none is set (tests), one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="verbatlas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/verbatlas/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", level: int = 3, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder (or at path): it cuts lineage, and a lost executor costs no rework of it.

    level is that of zstd.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(table: DataFrame, weight: Column | None = None, most: int = 4_000_000) -> DataFrame:
    """A stored table, to be sent to all tasks if its rows (or their weights) sum up to most at most; else as it is,
    for a join by shuffle. Weights are values of 8 bytes."""
    total = table.agg(F.coalesce(F.sum(weight if weight is not None else F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= most else table


def drop_stored(spark: SparkSession) -> None:
    """Deletes every table that stored() has left in the shared folder."""
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/verbatlas"
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="verbatlas-code-")  # Spark serves the file until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "verbatlas_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "verbatlas").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_kept: dict[tuple, object] = {}


def kept(operator: str, name: str, make: Callable[[], object]):
    """What make() gives, kept by a worker from task to task, of one operator at a time.

    Workers are used again by the stages that follow; whoever comes next lets go of what others have kept.
    """
    if any(k[0] != operator for k in _kept):
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    if (operator, name) not in _kept:
        _kept[operator, name] = make()
    return _kept[operator, name]


class WordCache(dict):
    """From a raw word to look(word). It only spares work: it starts anew beyond MOST words, and words of more than
    LONGEST characters aren't kept, so its bytes are bounded."""

    MOST, LONGEST = 400_000, 40

    def __missing__(self, raw: str):
        value = self.look(raw)
        if len(raw) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[raw] = value
        return value


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], sized: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of one column stay near a number of bytes (one row at least)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(sized))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            total += int(sizes[i])
            if total >= limit:
                yield batch.slice(at, i + 1 - at)
                at, total = i + 1, 0
        if at < n:
            yield batch.slice(at)
