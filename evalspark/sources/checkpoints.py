"""Result checkpoints on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "json")


def append_checkpoint(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append result rows. Spark commits whole tasks, so no partial tail is ever visible."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    rows.write.mode("append").format(fmt).save(path)


def append_as_tasks_end(rows: DataFrame, path: str) -> None:
    """Append rows as Parquet so that each task's rows stay once that task has ended, whatever
    becomes of the job.

    Spark's file writer does this with the second commit algorithm: a task's file is renamed into
    ``path`` when the task commits, and the driver lets one attempt per task commit. A failed job
    leaves the files of the tasks that had ended, and none of the others.
    """
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Rows written so far; a path that does not exist yet is an empty checkpoint."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
