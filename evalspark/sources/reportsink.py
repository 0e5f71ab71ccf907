"""Report writer, report reader and result export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.display import first_user_message, score_text
from evalspark.functions.jsons import json_kind
from evalspark.operators.reports import safe_config
from evalspark.operators.summary import badcases, run_summary
from evalspark.plans.durable import fresh_path, stored
from evalspark.plans.generators import explode_computed
from evalspark.schemas import REPORT

# Accepted report formats and the stamp inside a report.
FORMATS = ("json", "txt", "badcases")
STAMP = "yyyyMMdd_HHmmss"
EXPORT_HEADER = ("得分", "用户输入", "模型输出", "参考答案")
BOM = "\ufeff"


def report_records(results: DataFrame, config: DataFrame, stamp: Column, by: str = "run_id") -> DataFrame:
    """One small record per run: stamp, safe configuration and summary as JSON.

    Results stay rows of a partitioned table and are never packed into the record.
    """
    summary = run_summary(results, by)
    record = F.struct(
        F.date_format(stamp, STAMP).alias("timestamp"),
        safe_config(F.col("config")).alias("config"),
        F.struct(*[c for c in summary.columns if c != by]).alias("summary"),
    )
    return summary.join(config.select(by, "config"), by, "left").select(by, F.to_json(record).alias("record"))


def write_report(results: DataFrame, config: DataFrame, path: str, stamp: Column, formats: Sequence[str] = FORMATS,
                 by: str = "run_id") -> None:
    """Write the chosen parts below ``path``: results and bad cases partitioned by run, records as JSON or text."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown report formats {sorted(unknown)}")
    # Scored once: everything else is read from the written rows.
    spark, scored = results.sparkSession, fresh_path(results.sparkSession, "scored")
    results.write.parquet(scored)
    results = spark.read.schema(results.schema).parquet(scored)
    if "json" in formats or "txt" in formats:
        records = stored(report_records(results, config, stamp, by), "records")
        if "json" in formats:
            results.write.mode("append").partitionBy(by).parquet(f"{path}/results")
            records.write.mode("append").json(f"{path}/records")
        if "txt" in formats:
            lines = F.concat_ws("\t", F.col(by).cast("string"), F.col("record"))
            records.select(lines.alias("value")).write.mode("append").text(f"{path}/text")
    if "badcases" in formats:
        badcases(results).write.mode("append").partitionBy(by).parquet(f"{path}/badcases")


def parse_reports(reports: DataFrame) -> DataFrame:
    """Add ``doc``, the parsed document; null when ``report_content`` is not a JSON object."""
    staged = reports.withColumn("_kind", json_kind(F.col("report_content")))
    return staged.withColumn("doc", F.when(F.col("_kind") == "object", F.from_json("report_content", REPORT))).drop("_kind")


def explode_report(reports: DataFrame) -> DataFrame:
    """Result rows of stored documents."""
    return explode_computed(parse_reports(reports), F.col("doc.results"), "pos", "r", "id").select("id", "pos", "r.*")


def report_summaries(reports: DataFrame) -> DataFrame:
    """One row per document: stamp, configuration and summary, or the raw text if unreadable."""
    parsed = parse_reports(reports)
    raw = F.when(F.col("doc").isNull(), F.col("report_content"))
    return parsed.select("id", "doc.timestamp", "doc.config", "doc.summary.*", raw.alias("raw"))


def export_rows(results: DataFrame) -> DataFrame:
    """The four text columns of an export; blanks show ``-``."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return results.select(
        score_text(F.col("score")).alias("score"),
        F.coalesce(first_user_message(F.col("user_input")), F.lit("-")).alias("user_input"),
        shown("model_output").alias("model_output"),
        shown("reference_output").alias("reference_output"),
    )


def export_results_csv(results: DataFrame, path: str) -> None:
    """CSV part files with every field quoted; each file starts with the BOM, then the header.

    Written as text lines, because a CSV writer would put the BOM inside the first quotes.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = export_rows(results)
    header = BOM + ",".join(f'"{name}"' for name in EXPORT_HEADER)
    line = F.concat_ws(",", *[quoted(F.col(c)) for c in rows.columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its part file
    lines = rows.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    if rows.isEmpty():
        lines = rows.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    lines.write.mode("overwrite").text(path)
