"""Report, run and dashboard queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Configuration members that never leave the process. Besides local
# paths these are the credentials, which must not be stored with a report.
UNSAFE_CONFIG = ("report_dir", "checkpoint_path", "scoring_module", "database_service_url", "api_key", "auth_token")


def safe_config(config: Column) -> Column:
    """Configuration map without paths and credentials."""
    return F.map_filter(config, lambda k, _: ~k.isin(*UNSAFE_CONFIG))


def filter_reports(reports: DataFrame, text: str | None = None, dataset: str | None = None, model: str | None = None) -> DataFrame:
    if text:
        needle = F.lower(F.lit(text))
        reports = reports.where(
            F.contains(F.lower("dataset"), needle) | F.contains(F.lower("model"), needle)
        )
    if dataset:
        reports = reports.where(F.col("dataset") == dataset)
    if model:
        reports = reports.where(F.col("model") == model)
    return reports


def filter_runs(runs: DataFrame, status: str | None = None) -> DataFrame:
    return runs.where(F.col("status") == status) if status else runs


def active_configs(configs: DataFrame, include_inactive: bool = False) -> DataFrame:
    shown = configs if include_inactive else configs.where("is_active")
    return newest_first(shown)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def recent(df: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` rows (top-k, no full sort)."""
    return newest_first(df).limit(n)


NUMERIC_SORTS = ("accuracy", "average_score", "total_count")


def sort_reports(reports: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by a report column; a missing number sorts as 0, ties by id."""
    key = F.coalesce(F.col(column), F.lit(0)) if column in NUMERIC_SORTS else F.col(column)
    return reports.orderBy(key.desc() if descending else key.asc(), F.col("id"))


def page(df: DataFrame, number: int, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows of the 1-based page, one-row total), newest first."""
    rows = newest_first(df).offset((number - 1) * size).limit(size)
    return rows, df.agg(F.count(F.lit(1)).alias("total"))


def latest_report(reports: DataFrame, keys: Sequence[str] = ("user_id", "dataset", "model")) -> DataFrame:
    """Newest report per key, ties by id. Each task keeps one row per key before the shuffle."""
    return newest_by(reports, keys, F.desc("created_at"), F.desc("id"))


def newest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in ``order``. The rank limit is applied in every task before the
    shuffle, so a hot key sends one wide row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def task_state(updates: DataFrame, key: str = "task_id", order: Sequence[str] = ("ts", "event_id"),
               fields: Sequence[str] = ("status", "current", "message")) -> DataFrame:
    """Newest value of every field; an update changes only the fields it carries."""
    at = F.struct(*order)
    newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return updates.groupBy(key).agg(*newest, F.max(order[0]).alias("updated_at"))


def dashboard_stats(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts for the landing page as one row."""
    running = runs.agg(F.count_if(F.col("status") == "running").alias("running_runs"))
    return reports.agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.count_distinct("dataset").alias("total_datasets"),
        F.count_distinct("model").alias("total_models"),
    ).withColumn("running_runs", running.scalar())


def avg_accuracy(reports: DataFrame) -> DataFrame:
    """Mean accuracy; a report without one counts as 0."""
    mean = F.avg(F.coalesce("accuracy", F.lit(0.0)))
    return reports.agg(F.coalesce(mean, F.lit(0.0)).alias("avg_accuracy"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) != "").select(column).distinct().orderBy(column)


def compare_models(reports: DataFrame, models: Sequence[str]) -> DataFrame:
    """Newest accuracy per data set, one column per model."""
    newest = latest_report(reports.select("dataset", "model", "accuracy", "created_at", "id"), ["dataset", "model"])
    return newest.groupBy("dataset").pivot("model", list(models)).agg(F.max("accuracy"))


def compare_models_long(reports: DataFrame) -> DataFrame:
    """The same comparison for an unknown number of models: one row per (data set, model)."""
    narrow = reports.select("dataset", "model", "accuracy", "created_at", "id")
    return latest_report(narrow, ["dataset", "model"]).select("dataset", "model", "accuracy")


def accuracy_trend(reports: DataFrame, every: str = "1 day") -> DataFrame:
    """Mean accuracy and report count per model and time bucket."""
    return (
        reports.groupBy("model", F.window("created_at", every).alias("_w"))
        .agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("reports"))
        .select("model", F.col("_w.start").alias("bucket"), "accuracy", "reports")
    )
