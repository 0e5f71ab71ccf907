"""Reports, runs and dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import display
from evalspark.operators import reports as ops
from evalspark.operators.paging import Pages
from evalspark.operators.partials import RunningSummary, report_measures, trend_of
from evalspark.plans.durable import fresh_path
from evalspark.workload.curation_queries import CONFIGS
from evalspark.workload.fixtures import REPORTS, RUNS, UPDATES

MODELS = ["org/m0", "org/m1", "org/m2", "org/m3"]
TIME = "yyyy-MM-dd HH:mm:ss"


def _reports(spark, sf):
    return REPORTS.frame(spark, sf)


def _at(column):
    return F.date_format(column, TIME).alias(column)


def report_filter(spark, sf):
    return ops.filter_reports(_reports(spark, sf), "SET", "set3.jsonl", "org/m1").select("id", "dataset", "model")


def report_search(spark, sf):
    return ops.filter_reports(_reports(spark, sf), "M2").select("id", "dataset", "model")


def run_filter(spark, sf):
    return ops.filter_runs(RUNS.frame(spark, sf), "running").select("id", "user_id", "status")


def active_configs(spark, sf):
    return ops.active_configs(CONFIGS.frame(spark, sf)).select("id", "model_name", "created_at")


def progress_pct(spark, sf):
    pct = display.progress_pct(F.col("phase"), F.col("current"), F.col("total"))
    return UPDATES.frame(spark, sf).select("event_id", F.round(pct, 6).alias("pct"))


def score_tier(spark, sf):
    return _reports(spark, sf).select(
        "id", display.tier(F.col("accuracy")).alias("tier"), display.percent_text(F.col("average_score")).alias("percent"),
        display.score_text(F.col("average_score")).alias("shown"))


def model_short_name(spark, sf):
    return _reports(spark, sf).select("id", display.short_name(F.col("model")).alias("short_name"))


def dashboard_stats(spark, sf):
    return ops.dashboard_stats(_reports(spark, sf), RUNS.frame(spark, sf))


def report_avg_accuracy(spark, sf):
    return ops.avg_accuracy(_reports(spark, sf)).select(F.round("avg_accuracy", 6).alias("avg_accuracy"))


def distinct_models(spark, sf):
    return ops.distinct_values(_reports(spark, sf), "model")


def model_compare(spark, sf):
    wide = ops.compare_models(_reports(spark, sf), MODELS)
    return wide.select("dataset", *[F.col(f"`{m}`").alias(m.split("/")[1]) for m in MODELS])


def model_compare_long(spark, sf):
    return ops.compare_models_long(_reports(spark, sf))


def accuracy_trend(spark, sf):
    trend = ops.accuracy_trend(_reports(spark, sf), "1 day")
    return trend.select("model", _at("bucket"), F.round("accuracy", 6).alias("accuracy"), "reports")


def accuracy_trend_appended(spark, sf):
    """The trend of reports that come in parts, from stored counts and sums per model and day."""
    reports = _reports(spark, sf).withColumn("bucket", F.date_trunc("day", "created_at"))
    store = RunningSummary(spark, fresh_path(spark, "trend"), reports, ["model", "bucket"], report_measures)
    for batch, part in enumerate(("user_id < 10", "user_id >= 10")):
        store.append(reports.where(part), batch)
    return trend_of(store.partials()).select("model", _at("bucket"), F.round("accuracy", 6).alias("accuracy"), "reports")


def latest_report(spark, sf):
    return ops.latest_report(_reports(spark, sf)).select("user_id", "dataset", "model", "id", "accuracy", _at("created_at"))


def task_state(spark, sf):
    return ops.task_state(UPDATES.frame(spark, sf)).select("task_id", "status", "current", "message", _at("updated_at"))


def newest_first(spark, sf):
    return ops.newest_first(_reports(spark, sf)).select("id", "dataset", _at("created_at"))


def recent_reports(spark, sf):
    return ops.recent(_reports(spark, sf)).select("id", "dataset", "model", _at("created_at"))


def report_sort(spark, sf):
    return ops.sort_reports(_reports(spark, sf), "accuracy", descending=True).select("id", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def report_page(spark, sf):
    rows, total = ops.page(_reports(spark, sf), 3, 15)
    return rows.withColumn("total", total.scalar()).select("id", _at("created_at"), "total")


def report_page_seek(spark, sf):
    """A page near the front and the last one, each from the ranges it lies in."""
    pages = Pages.store(_reports(spark, sf), fresh_path(spark, "pages"), rows=2_000)
    total = pages.total().first()["total"]
    last = -(-total // 15)
    found = [pages.page(number, 15).select(F.lit(name).alias("page"), "id", "created_at") for name, number in (("third", 3), ("last", last))]
    return found[0].union(found[1]).select("page", "id", _at("created_at"), F.lit(total).cast("long").alias("total"))


QUERIES = {f.__name__: f for f in (
    report_filter, report_search, run_filter, active_configs, progress_pct, score_tier, model_short_name, dashboard_stats, report_avg_accuracy,
    distinct_models, model_compare, model_compare_long, accuracy_trend, accuracy_trend_appended, latest_report, task_state, newest_first, recent_reports, report_sort, report_page, report_page_seek,
)}

_FX = f"WITH fx AS ({REPORTS.sql()})"
_SHOWN = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"

ORACLES = {
    "report_filter": f"{_FX} SELECT id, dataset, model FROM fx WHERE (contains(lower(dataset), 'set') OR contains(lower(model), 'set')) AND dataset = 'set3.jsonl' AND model = 'org/m1'",
    "report_search": f"{_FX} SELECT id, dataset, model FROM fx WHERE contains(lower(dataset), 'm2') OR contains(lower(model), 'm2')",
    "run_filter": f"WITH fx AS ({RUNS.sql()}) SELECT id, user_id, status FROM fx WHERE status = 'running'",
    "active_configs": f"WITH fx AS ({CONFIGS.sql()}) SELECT id, model_name, created_at FROM fx WHERE is_active ORDER BY created_at DESC, id DESC",
    "progress_pct": f"""WITH fx AS ({UPDATES.sql()}), d AS (SELECT event_id, phase, CASE WHEN total > 0 THEN current / total ELSE 0.0 END AS done FROM fx)
        SELECT event_id, round(CASE phase WHEN 'generate' THEN done * 60 WHEN 'score' THEN 60 + done * 10 WHEN 'report' THEN 80 + done * 10 ELSE done * 100 END, 6) AS pct FROM d""",
    "score_tier": f"""{_FX} SELECT id, CASE WHEN accuracy IS NULL THEN '-' WHEN accuracy >= 0.8 THEN 'high' WHEN accuracy >= 0.5 THEN 'medium' ELSE 'low' END AS tier,
        CASE WHEN average_score IS NULL THEN '-' ELSE printf('%.2f', round(average_score * 100, 2)) || '%' END AS percent, CASE WHEN average_score IS NULL THEN '-' ELSE printf('%.4f', round(average_score, 4)) END AS shown FROM fx""",
    "model_short_name": f"{_FX} SELECT id, string_split(model, '/')[-1] AS short_name FROM fx",
    "dashboard_stats": f"{_FX}, r AS ({RUNS.sql()}) SELECT count(*) AS total_reports, count(DISTINCT dataset) AS total_datasets, count(DISTINCT model) AS total_models, (SELECT count(*) FROM r WHERE status = 'running') AS running_runs FROM fx",
    "report_avg_accuracy": f"{_FX} SELECT round(avg(coalesce(accuracy, 0)), 6) AS avg_accuracy FROM fx",
    "distinct_models": f"{_FX} SELECT DISTINCT model FROM fx WHERE model <> '' ORDER BY model",
    "model_compare": f"""{_FX}, l AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY created_at DESC, id DESC) AS rn FROM fx) SELECT dataset, """
        + ", ".join(f"max(accuracy) FILTER (rn = 1 AND model = '{m}') AS {m.split('/')[1]}" for m in MODELS) + " FROM l GROUP BY dataset",
    "model_compare_long": f"{_FX} SELECT dataset, model, accuracy FROM fx QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY created_at DESC, id DESC) = 1",
    "accuracy_trend": f"{_FX} SELECT model, strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS bucket, round(avg(accuracy), 6) AS accuracy, count(*) AS reports FROM fx GROUP BY ALL",
    "latest_report": f"{_FX} SELECT user_id, dataset, model, id, accuracy, {_SHOWN} FROM fx QUALIFY row_number() OVER (PARTITION BY user_id, dataset, model ORDER BY fx.created_at DESC, id DESC) = 1",
    "task_state": f"""WITH fx AS ({UPDATES.sql()}), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM fx)
        SELECT task_id, arg_max(status, rn) AS status, arg_max(current, rn) AS current, arg_max(message, rn) FILTER (message IS NOT NULL) AS message, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM n GROUP BY task_id""",
    "newest_first": f"{_FX} SELECT id, dataset, {_SHOWN} FROM fx ORDER BY fx.created_at DESC, id DESC",
    "recent_reports": f"{_FX} SELECT id, dataset, model, {_SHOWN} FROM fx ORDER BY fx.created_at DESC, id DESC LIMIT 5",
    "report_sort": f"{_FX} SELECT id, coalesce(accuracy, 0.0) AS accuracy FROM fx ORDER BY 2 DESC, id",
    "report_page": f"{_FX} SELECT id, {_SHOWN}, (SELECT count(*) FROM fx) AS total FROM fx ORDER BY fx.created_at DESC, id DESC LIMIT 15 OFFSET 30",
}
ORACLES["accuracy_trend_appended"] = ORACLES["accuracy_trend"]
ORACLES["report_page_seek"] = f"""{_FX}, r AS (SELECT id, {_SHOWN}, row_number() OVER (ORDER BY fx.created_at DESC, id DESC) - 1 AS rn, count(*) OVER () AS total FROM fx)
    SELECT 'third' AS page, id, created_at, total FROM r WHERE rn BETWEEN 30 AND 44 UNION ALL SELECT 'last', id, created_at, total FROM r WHERE rn >= (total - 1) // 15 * 15"""
