"""CSV samples: header row, then marker, description and (Human, Assistant) column pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.text import strip
from evalspark.plans.numbering import shift_ranges
from evalspark.sources.positions import BLOCK, number_lines, with_positions
from evalspark.sources.records import first_records, positioned_cells, with_cells

# Marker a valid row starts with, and the roles written to samples.
MARKER = "meta"
ROLES = ("Human", "Assistant")


def read_csv_rows(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Data rows as ``row_index, cells``; a row of another width than the header fails the job.

    Files are split. Line breaks inside quotes need ``multiline``, which splits files too, at the
    price of a second pass (``records``); without it such a row has the wrong width and fails the job.
    """
    if multiline:
        return _numbered(spark, path, lambda cells: F.lit(True), "row_index")
    return number_lines(with_positions(_cells(spark, path)).drop("_metadata"), "row_index")


def _scan(spark: SparkSession, multiline: bool = False):
    return (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("inferSchema", False)
    )


def _cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    scan = _scan(spark).csv(path)
    cells = F.array(*[F.coalesce(F.col(f"`{c.replace('`', '``')}`"), F.lit("")) for c in scan.columns])
    return scan.select(cells.alias("cells"), "_metadata")


def _numbered(spark: SparkSession, path: str | list[str], usable: Callable[[Column], Column], out: str) -> DataFrame:
    width = len(_scan(spark, True).csv(path).columns)  # reads the first record of one file
    rows = positioned_cells(spark, path, width, usable)
    return shift_ranges(rows, BLOCK, "_at", out, order=[F.length("_file"), *BLOCK])


def csv_turns(cells: Column) -> Column:
    """Turns of complete pairs; an odd last column is ignored."""
    pairs = F.floor((F.size(cells) - 2) / 2).cast("int")
    starts = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: i * 2 + 2)).otherwise(
        F.array().cast("array<int>")
    )
    asked, said = (lambda i: F.get(cells, i)), (lambda i: F.get(cells, i + 1))

    def turn(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"))

    complete = F.filter(starts, lambda i: (asked(i) != "") & (said(i) != ""))
    return F.flatten(F.transform(complete, lambda i: F.array(turn(ROLES[0], asked(i)), turn(ROLES[1], said(i)))))


def _as_sample(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "meta": F.struct(F.get("cells", F.lit(1)).alias("meta_description")),
        "turns": csv_turns(F.col("cells")),
    }).withColumn("raw", F.to_json(F.struct("meta", "turns")))


def _usable(cells: Column) -> Column:
    return (F.size(cells) >= 2) & (strip(F.get(cells, F.lit(0))) != "")


def csv_to_samples(rows: DataFrame) -> DataFrame:
    """Samples of already numbered ``row_index, cells``; numbers keep the gaps of unusable rows."""
    return _as_sample(rows.where(_usable(F.col("cells")))).select(F.col("row_index").alias("original_index"), "meta", "turns", "raw")


def read_samples_csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Samples of a CSV file, numbered densely: rows with two columns or more and a non-blank
    first one. Unusable rows go before the numbering, so nothing is numbered twice."""
    if multiline:
        numbered = _numbered(spark, path, _usable, "original_index")
    else:
        numbered = number_lines(with_positions(_cells(spark, path).where(_usable(F.col("cells")))).drop("_metadata"))
    return _as_sample(numbered).select("original_index", "meta", "turns", "raw")


def classify_rows(rows: DataFrame) -> DataFrame:
    """Add ``status`` (valid, empty, invalid) and the 1-based file ``row`` number."""
    first = F.get("cells", F.lit(0))
    empty = (F.size("cells") == 0) | ((F.size("cells") == 1) & (strip(first) == ""))
    valid = (F.size("cells") >= 2) & (first == MARKER)
    status = F.when(empty, "empty").when(valid, "valid").otherwise("invalid")
    return rows.withColumns({"status": status, "row": F.col("row_index") + 2})


def validate_csv(rows: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(counters, invalid rows with their file row number and reason)."""
    by = by or []
    marked = classify_rows(rows)
    report = marked.groupBy(*by).agg(
        (F.count(F.lit(1)) + 1).alias("total_rows"),
        F.count_if(F.col("status") == "valid").alias("valid_rows"),
        F.count_if(F.col("status") == "empty").alias("empty_rows"),
        F.count_if(F.col("status") == "invalid").alias("invalid_rows"),
    ).withColumn("error", F.when(F.col("total_rows") < 2, "a header row and one data row are required"))
    invalid = marked.where(F.col("status") == "invalid").select(
        *by, "row", "cells", F.lit("First column must be 'meta'").alias("error")
    )
    return report, invalid


def preview_csv(rows: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` valid rows as samples."""
    valid = classify_rows(rows).where(F.col("status") == "valid").orderBy("row").limit(n)
    return _as_sample(valid).select("row", "meta", "turns", "raw")


def preview_csv_file(spark: SparkSession, path: str | list[str], n: int = 5, lines: int = 256) -> DataFrame:
    """``preview_csv`` of files, quoted line breaks included, that reads as many lines as it needs:
    the first ``lines`` of the first file, four times as many as long as ``n`` valid rows are not
    among them, then the next file."""
    files = sorted(spark.read.text(path).inputFiles(), key=lambda f: (len(f), f))
    width = len(_scan(spark, True).csv(path).columns)
    found, before, at = None, 0, 0
    want = lines
    while at < len(files):
        records, done = first_records(spark, files[at], want)
        rows = with_cells(records.where("_record > 1 and text != ''"), width).select((F.row_number().over(Window.orderBy("_record")) - 1 + before).alias("row_index"), "cells")
        enough = found if found is not None else rows.limit(0)
        here = enough.unionByName(rows)
        if here.where(F.get("cells", F.lit(0)) == MARKER).count() >= n or done and at == len(files) - 1:
            return preview_csv(here, n)
        if done:
            found, before, at, want = here, before + rows.count(), at + 1, lines
        else:
            want *= 4
    raise ValueError("no file to preview")
