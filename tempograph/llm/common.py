"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Intermediate tables in the folder that the cluster shares.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset and all runs on one machine is a temporary folder made and set.  Every
    table is written by Spark's committer and read again, so its lineage ends
    there and a lost executor costs nothing but the tasks it was running.

    A result may read its tables for as long as it is used, so they stay until
    ``sweep`` is called or the driver ends.
    """

    held: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tempograph-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        Scratch.held.append(self)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that nothing will read again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Free all tables, those in the catalog too."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        self.drop("")

    @classmethod
    def sweep(cls, since: int = 0) -> None:
        """Close what was opened after the first ``since`` ones; nothing may read their tables any more."""
        for scratch in cls.held[since:]:
            scratch.close()
        del cls.held[since:]


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone before
        Scratch.sweep()


atexit.register(_at_exit)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text, an empty string for null."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written in decimal; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(0))


def ascii_lower(column: Column) -> Column:
    """Lower-case A to Z alone."""
    return F.translate(column, LOWER_FROM, LOWER_TO)


def words_of(column: Column) -> Column:
    r"""The runs of ``[^\x20\x09-\x0D]+`` as an array, empty for a blank text."""
    return F.filter(F.split(column, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``most`` bytes of a text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for the next task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def running(df: DataFrame, keys: list[str], order: list[Column], spread: list[Column], out: str, weight: Column | None = None, buckets: int = 16) -> DataFrame:
    """Sum of the weights (1 each: the row's number from 0) of the rows before each row of its key.

    The order begins with a bucket, the hash of ``spread``: weights are summed
    by (key, bucket), that small table is summed up in order, and each row adds
    its place inside its own bucket.  No task holds a whole key.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")).withColumn("_w", w)
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before", "_w")
    )


def save_bucketed(scratch: Scratch, df: DataFrame, name: str, key: str, codec: str = "zstd") -> DataFrame:
    """A table in the shared folder, bucketed by a key so that joins on it do not move its rows."""
    label = f"{name}_{uuid.uuid4().hex}"
    buckets = parallelism(scratch.spark)
    scratch.tables.append(label)
    df.write.bucketBy(buckets, key).option("path", f"{scratch.root}/{name}").option("compression", codec).saveAsTable(label)
    return scratch.spark.table(label)
