"""JSONL samples and dataset blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.jsons import json_valid
from evalspark.functions.text import strip
from evalspark.plans.generators import explode_computed
from evalspark.schemas import SAMPLE
from evalspark.sources.positions import number_lines, with_positions


def parse_sample(raw: Column) -> Column:
    return F.from_json(raw, SAMPLE)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of one or more JSONL files: ``original_index, meta, turns, raw``.

    Blank lines are skipped; one line that is not valid JSON fails the job. Files are
    split at block boundaries like any text source.
    """
    scan = spark.read.text(path).select(strip(F.col("value")).alias("raw"), "_metadata").where(F.col("raw") != "")
    numbered = number_lines(with_positions(scan).drop("_metadata"))
    return _with_fields(numbered.withColumn("raw", _checked(F.col("raw"))))


def _checked(raw: Column) -> Column:
    return F.when(json_valid(raw), raw).otherwise(F.raise_error(F.concat(F.lit("not valid JSON: "), F.substring(raw, 1, 200))))


def _with_fields(df: DataFrame) -> DataFrame:
    parsed = df.withColumn("_p", parse_sample(F.col("raw")))
    others = [c for c in df.columns if c not in ("original_index", "raw")]
    return parsed.select(*others, "original_index", "_p.meta", "_p.turns", "raw")


def dataset_lines(datasets: DataFrame) -> DataFrame:
    """One row per line of every blob: ``id, pos, line`` (trimmed, blanks kept)."""
    lines = explode_computed(datasets, F.split("file_content", "\n", -1), "pos", "line", "id")
    return lines.withColumn("line", strip(F.col("line")))


def explode_dataset(datasets: DataFrame) -> DataFrame:
    """Samples of each dataset blob, numbered densely inside the dataset.

    A blob is one row, so blanks are dropped and lines numbered inside the row. A line
    that is not valid JSON fails the job; see :func:`explode_readable`.
    """
    exploded = explode_computed(datasets, _items(), "original_index", "raw", "id")
    return _with_fields(exploded.withColumns({"original_index": F.col("original_index").cast("long"), "raw": _checked(F.col("raw"))}))


def explode_readable(datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples of the readable blobs, rejected blobs with their first bad line).

    A blob is rejected as a whole if one non-blank line is not valid JSON; ``line_number``
    counts from 1 and ``line`` is that line.
    """
    lines = F.transform(F.split("file_content", "\n", -1), strip)
    judged = datasets.withColumn("_lines", lines).withColumn(
        "_bad", F.array_position(F.transform("_lines", lambda line: (line != "") & ~json_valid(line)), True)
    )
    rejected = judged.where("_bad > 0").select("id", F.col("_bad").alias("line_number"), F.element_at("_lines", F.col("_bad").cast("int")).alias("line"))
    return explode_dataset(judged.where("coalesce(_bad, 0) = 0").drop("_lines", "_bad")), rejected


def _items() -> Column:
    return F.filter(F.transform(F.split("file_content", "\n", -1), strip), lambda line: line != "")


def preview_dataset(datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items before the first bad line, one row ``id, total_count, error`` per dataset)."""
    lines = F.transform(F.split("file_content", "\n", -1), strip)
    staged = datasets.select("id", lines.alias("_lines")).withColumn(
        "_bad", F.array_position(F.transform("_lines", lambda line: (line != "") & ~json_valid(line)), True)
    )
    head = F.when(F.col("_bad") > 0, F.slice("_lines", F.lit(1), (F.col("_bad") - 1).cast("int"))).otherwise(F.col("_lines"))
    items = F.filter(head, lambda line: line != "")
    shown = explode_computed(staged, items, "pos", "raw", "id")
    counts = staged.select(
        "id",
        F.when(F.col("_bad") > 0, F.size("_lines")).otherwise(F.size(items)).cast("long").alias("total_count"),
        F.when(F.col("_bad") > 0, F.element_at("_lines", F.col("_bad").cast("int"))).alias("bad_line"),
    )
    return shown, counts


def validate_jsonl(lines: DataFrame, by: str = "id") -> DataFrame:
    """Per dataset: is every non-blank line valid, and how many are not."""
    bad = (F.col("line") != "") & ~json_valid(F.col("line"))
    return lines.groupBy(by).agg(
        (F.count_if(bad) == 0).alias("valid"),
        F.count_if(bad).alias("bad_lines"),
        F.count_if(F.col("line") != "").alias("items"),
    )


def dataset_catalog(datasets: DataFrame, user_id: int | None = None) -> DataFrame:
    """List without content, newest first; the blob column is read only if no size is stored."""
    size = F.col("file_size") if "file_size" in datasets.columns else F.octet_length("file_content").cast("long")
    mine = datasets if user_id is None else datasets.where(F.col("user_id") == user_id)
    return mine.select("id", "user_id", "filename", "description", size.alias("file_size"), "created_at").orderBy(
        F.desc("created_at"), F.desc("id")
    )
