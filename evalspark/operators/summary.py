"""Run summaries over scored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUGE_KEYS = ("rouge1", "rouge2", "rougeL")


def accuracy() -> Column:
    """Share of good rows; rows that failed count in the denominator."""
    return F.count_if(F.col("is_badcase") == 0) / F.count(F.lit(1))


def avg_score() -> Column:
    return F.coalesce(F.avg("score"), F.lit(0.0))


def avg_latency() -> Column:
    return F.coalesce(F.avg("inference_time"), F.lit(0.0))


def rouge_means(details: str = "details") -> Column:
    """Map of mean F-measures; a measure no row carries is absent."""
    means = F.create_map(*[x for k in ROUGE_KEYS for x in (F.lit(k), F.avg(f"{details}.{k}"))])
    return F.map_filter(means, lambda _, v: v.isNotNull())


def carries_rouge(results: DataFrame) -> bool:
    if "details" not in results.columns:
        return False
    kind = results.schema["details"].dataType
    return isinstance(kind, T.StructType) and set(ROUGE_KEYS) <= set(kind.fieldNames())


def run_summary(results: DataFrame, by: str | list[str] | None = "run_id") -> DataFrame:
    """One row per run. Single pass, partial aggregation before the shuffle."""
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    no_rouge = F.create_map().cast("map<string,double>")
    summary = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("is_badcase") == 0).alias("correct_count"),
        accuracy().alias("accuracy"),
        avg_score().alias("average_score"),
        (avg_latency() if "inference_time" in results.columns else F.lit(0.0)).alias("average_inference_time"),
        (rouge_means() if carries_rouge(results) else F.first(no_rouge)).alias("rouge_scores"),
        F.count_if(F.col("is_badcase") == 1).alias("badcase_count"),
    )
    return summary if keys else summary.where(F.col("total_count") > 0)


def badcases(results: DataFrame) -> DataFrame:
    """All bad rows, whether scored now or loaded from a checkpoint, by ``index`` where there is one."""
    bad = results.where(F.col("is_badcase") == 1)
    return bad.orderBy("index") if "index" in results.columns else bad


def run_results(results: DataFrame) -> DataFrame:
    return results.orderBy("index")
