"""Where the corpus operators keep the tables they cut lineage with, and small helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bound_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where that is unset, as in tests, one of our own is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="sparktok-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_MADE: list[str] = []


class Scratch:
    """Tables written to the shared folder: they survive the loss of executors, and cut lineage. Results are read from them, so they stay until clean()."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        _MADE.append(self.at)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def bucketed(self, df: DataFrame, name: str, by: str, buckets: int, parted: str) -> DataFrame:
        """A table laid out by the hash of a column, so that joins on it don't move its rows. Row groups are small: rows may be large."""
        table = f"sparktok_{uuid.uuid4().hex}"
        out = df.write.option("path", f"{self.at}/{name}").option("compression", "zstd").option("parquet.block.size", 16 << 20)
        out.partitionBy(parted).bucketBy(buckets, by).saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Frees what no later step reads."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
        _delete(self.spark, [f"{self.at}/{name}" for name in names])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this driver's operators have written so far; results not yet stored elsewhere go with them."""
    _delete(spark, _MADE)
    _MADE.clear()


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives memory back when its partition ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


#: Rows of one number each, about 16 MB as a hash table, up to which a set of ids goes to all executors.
BROADCAST_IDS = 1_000_000


def marked_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is small enough; else Spark joins by shuffling both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under names of its own: other columns can't clash. The text is lowered by Spark."""
    bound_batches(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.lower(F.col(text_col)).alias("text"),
        *(F.col(c).alias(f"c{k}") for k, c in enumerate(more)),
    )
