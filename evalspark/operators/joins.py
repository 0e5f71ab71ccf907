"""Lookups expressed as joins.

No side is force-broadcast: Spark broadcasts a side only when its measured size is
under ``autoBroadcastJoinThreshold`` and otherwise sort-merges, splitting hot keys with
the AQE skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request defaults and the values that mean "not set".
DEFAULT_WORKERS = 4
DEFAULT_THRESHOLD = 1.0
DEFAULT_TIMEOUT = 600
DEFAULT_MAX_TOKENS = 16384
PLACEHOLDER_KEY = "sk-xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"


def attach_outputs(cases: DataFrame, outputs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join outputs by case key; a case without output becomes an error row."""
    keys = keys or ["index"]
    given = outputs.select(*keys, "model_output", "inference_time", "error")
    joined = cases.join(given, keys, "left")
    error = F.coalesce(F.col("error"), F.when(F.col("model_output").isNull(), "no model output"))
    return joined.withColumn("error", error).withColumns({
        "model_output": F.when(F.col("error").isNull(), F.col("model_output")),
        "inference_time": F.when(F.col("error").isNull(), F.col("inference_time")),
    })


def _unset(value: Column, *blanks) -> Column:
    return F.when(value.isNotNull() & ~value.isin(*blanks), value)


def resolve_config(requests: DataFrame, model_configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill run requests from the model table; returns (resolved, rejected).

    Requests naming an unknown model, or lacking model, data file or scorer, are rejected.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    complete = filled("model") & filled("data_file") & filled("scoring")
    config = model_configs.select(
        F.col("model_name").alias("model"),
        *[F.col(c).alias(f"_{c}") for c in ("api_urls", "api_key", "timeout", "max_tokens", "temperature", "top_p", "is_vllm")],
        F.lit(True).alias("_known"),
    )
    joined = requests.join(config, "model", "left").withColumn("_complete", complete)
    ok = F.col("_complete") & F.col("_known").isNotNull()
    own_urls = F.when(F.size("api_urls") > 0, F.col("api_urls"))
    own_key = _unset(F.col("api_key"), "", PLACEHOLDER_KEY)
    resolved = joined.where(ok).withColumns({
        "api_urls": F.coalesce(own_urls, F.when(F.size("_api_urls") > 0, F.col("_api_urls")), F.col("api_urls")),
        "api_key": F.coalesce(own_key, F.nullif(F.col("_api_key"), F.lit("")), F.lit(PLACEHOLDER_KEY)),
        "max_workers": F.coalesce(_unset(F.col("max_workers"), 0), F.lit(DEFAULT_WORKERS)),
        "badcase_threshold": F.coalesce(_unset(F.col("badcase_threshold"), 0.0), F.lit(DEFAULT_THRESHOLD)),
        "timeout": F.coalesce(_unset(F.col("timeout"), 0, DEFAULT_TIMEOUT), F.col("_timeout")),
        "max_tokens": F.coalesce(_unset(F.col("max_tokens"), 0, DEFAULT_MAX_TOKENS), F.col("_max_tokens")),
        "temperature": F.coalesce(_unset(F.col("temperature"), 0.0), F.col("_temperature")),
        "top_p": F.coalesce(_unset(F.col("top_p"), 0.0), F.col("_top_p")),
        "is_vllm": F.col("_is_vllm"),
    })
    helper = [c for c in joined.columns if c.startswith("_")]
    reason = F.when(~F.col("_complete"), "model, data_file and scoring are required").otherwise("unknown model")
    rejected = joined.where(~ok).select(*requests.columns, reason.alias("reason"))
    return resolved.drop(*helper), rejected


def with_owner(df: DataFrame, users: DataFrame) -> DataFrame:
    """Add the owner's ``username``."""
    names = users.select(F.col("id").alias("user_id"), "username")
    return df.join(names, "user_id", "left")


def owned(df: DataFrame, user_id: int, ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Rows of one owner, optionally restricted to a frame of ids."""
    mine = df.where(F.col("user_id") == user_id)
    return mine if ids is None else mine.join(ids.select(id_col), id_col, "left_semi")


def cascade_delete(
    tables: dict[str, DataFrame], user_ids: DataFrame | None = None, task_ids: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Delete users (with their data sets, runs and reports) and runs (with their reports).

    ``tables`` may hold ``users, datasets, runs, reports``; the survivors are returned.
    """
    left = dict(tables)
    gone_tasks = task_ids.select("task_id") if task_ids is not None else None
    if user_ids is not None:
        gone_users = user_ids.select("user_id").distinct()
        if "runs" in left:
            of_users = left["runs"].join(gone_users, "user_id", "left_semi").select("task_id")
            gone_tasks = of_users if gone_tasks is None else gone_tasks.unionByName(of_users)
        if "users" in left:
            left["users"] = left["users"].join(gone_users.withColumnRenamed("user_id", "id"), "id", "left_anti")
        for name in ("datasets", "runs", "reports"):
            if name in left:
                left[name] = left[name].join(gone_users, "user_id", "left_anti")
    if gone_tasks is not None:
        gone_tasks = gone_tasks.distinct()
        for name in ("runs", "reports"):
            if name in left:
                left[name] = left[name].join(gone_tasks, "task_id", "left_anti")
    return left
