"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        made = tempfile.mkdtemp(prefix="girder-")
        atexit.register(shutil.rmtree, made, True)
        _local = f"file://{made}"
    return _local


_local: str | None = None


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files as soon as the query has ended, not when its plan is garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is sorted and merged, never sent through the driver.

    Spark guesses a side's size from the bytes of its files. Parsing makes many records of one row, and Parquet keeps like
    records in few bytes, so the guess may be hundreds of times too small.
    """
    return df.hint("merge")


BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 100_000  # Spark's own limit


class Scratch:
    """Named Parquet tables that cut lineage and outlive lost executors.

    Every table goes when :meth:`drop` names it or, at the latest, when Python exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back by its known schema; its shuffle files go with the write."""
        with short_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.load(name, df.schema)

    def save_bucketed(self, df: DataFrame, name: str, column: str, size: int) -> DataFrame:
        """Write ``df`` in buckets of ``column`` and read it back as a table whose joins by that column do not move it again.

        There is a bucket for BUCKET_BYTES of ``size``, one for each shuffle partition at least, and MOST_BUCKETS at most.
        """
        buckets = min(MOST_BUCKETS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
        table = f"girder_{uuid.uuid4().hex}"
        with short_shuffles(self.spark):
            df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, column).saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
