"""Presentation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(value: Column) -> Column:
    """high from 0.8, medium from 0.5, else low; a missing value shows ``-``."""
    return F.when(value.isNull(), "-").when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.format_string("%.2f", value * 100), F.lit("%")))


def score_text(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string("%.4f", value))


def short_name(model: Column) -> Column:
    """Last path segment of a model name."""
    return F.element_at(F.split(model, "/", -1), -1)


def render_messages(messages: Column) -> Column:
    """``[role]: content`` blocks separated by a blank line."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["content"])), "\n\n"
    )


def first_user_message(messages: Column) -> Column:
    """Content of the first user message, else the whole array as JSON."""
    user = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return F.coalesce(F.nullif(user, F.lit("")), F.to_json(messages))


# The shares of total progress each phase covers.
PHASES = {
    "generate": (0.0, 60.0), "获取模型输出": (0.0, 60.0),
    "score": (60.0, 10.0), "评分处理": (60.0, 10.0),
    "report": (80.0, 10.0), "保存报告": (80.0, 10.0),
}


def progress_pct(phase: Column, current: Column, total: Column) -> Column:
    """Overall percentage of a phase-local counter; an empty phase shows its start."""
    done = F.coalesce(current / F.when(total > 0, total), F.lit(0.0))
    pct = done * 100.0
    for name, (base, span) in PHASES.items():
        pct = F.when(phase == name, F.lit(base) + done * span).otherwise(pct)
    return pct


def export_name(dataset: Column, model: Column) -> Column:
    """File name of an export: data set without its extension, ``+``, model."""
    return F.concat(F.regexp_replace(dataset, r"\.[^/.]+$", ""), F.lit("+"), model, F.lit(".csv"))
