"""Pages of a long list without sorting it for each of them.

The list is stored once in its order, in ranges of about ``rows`` rows, with a directory of the
ranges: how many rows each holds and how many come before it. A page opens the ranges it lies in,
the last page no more than the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEWEST = ("created_at", "id")
ROWS = 100_000


class Pages:
    """``store`` writes the list and its directory below a path, ``Pages(spark, path)`` reads them.
    ``order`` names the columns it is sorted by, all falling, nulls last; together they are unique."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = NEWEST):
        self.spark, self.path, self.order = spark, path, list(order)
        self.directory = spark.read.parquet(f"{path}/directory")
        self.schema = spark.read.parquet(f"{path}/empty").schema

    @classmethod
    def store(cls, df: DataFrame, path: str, order: Sequence[str] = NEWEST, rows: int = ROWS) -> Pages:
        falling = [F.desc(c) for c in order]
        ranges = max(1, -(-df.count() // rows))
        ranged = df.repartitionByRange(ranges, *falling).withColumn("_range", F.spark_partition_id())
        ranged.sortWithinPartitions(*falling).write.partitionBy("_range").parquet(f"{path}/rows")
        stored = df.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
        counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
        before = F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
        counts.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).write.parquet(f"{path}/directory")
        df.limit(0).write.parquet(f"{path}/empty")  # for its schema
        return cls(df.sparkSession, path, order)

    def total(self) -> DataFrame:
        return self.directory.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("total"))

    def page(self, number: int, size: int = 10) -> DataFrame:
        """The rows of a 1-based page, in order."""
        start = (number - 1) * size
        overlap: Column = (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
        met = self.directory.where(overlap).orderBy("_range").collect()  # a page's ranges: at most its rows, and one
        if not met:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/_range={r['_range']}" for r in met])
        return rows.orderBy(*[F.desc(c) for c in self.order]).offset(start - met[0]["before"]).limit(size)
