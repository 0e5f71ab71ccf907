"""Durable cut points in a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evalspark.session import checkpoint_dir

_WRITTEN: list[str] = []


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Used where two branches of a plan must see the very same rows in the very same
    partitions, and after non-deterministic work that a retry must not repeat.
    Survives executor loss because the files live outside the executors. Spark deletes them with
    the last plan that reads them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same through a Parquet table, whose size the planner knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes and deletes as soon as its own result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, fresh_path(spark, name), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """No frame of these tables may be read any more."""
        _WRITTEN.remove(self.path)
        _delete(self.spark, self.path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the checkpoint folder for a written table."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete every table written below ``fresh_path`` by this process, once its results are no
    longer read. Returns how many there were."""
    count = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return count


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
