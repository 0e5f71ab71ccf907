"""Answer extraction patterns. The patterns and tags are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.jsons import json_kind, json_map, json_member_raw, json_string
from evalspark.functions.staged import Stages
from evalspark.functions.text import D, S, W, strip

BOXED_INT = rf"\\boxed\{{({D}+)\}}"
BOXED_DECIMAL = rf"\\boxed\{{({D}+(?:\.{D})?)\}}"

ANSWER_FIELD = rf"(?iu)(?:Final{S}+)?Answer:{S}*((?:{W}|#)+)"
ACTION_FIELD = rf"(?iu)Action:{S}*((?:{W}|#)+)"
VALUE_FIELD = rf"(?ius)Value:{S}*(.+)"

THOUGHT_PART = "(?iu)Thought:"
ACTION_PART = rf"(?iu)Action{S}*:"
ACTION_INPUT_PART = rf"(?iu)Action Input{S}*:"
TOOL_NAME = rf"(?iu)Action{S}*:{S}*({W}+)"
TOOL_PARAMS = rf"Action Input{S}*:{S}*(\{{[^{{}}]*\}})"
FINISH_CALL = rf"(?iu)Action{S}*:{S}*Finish"
FINAL_ANSWER = rf"""(?iu)final_answer{S}*:{S}*["']([^"']*)["']"""

SOLUTION_TAG = rf"(?s)<solution>{S}*(.*?){S}*</solution>"
ANSWER_TAG = rf"(?s)\[答案\]{S}*(.*?)(?:\[/答案\]|$)"


def boxed_int(text: Column) -> Column:
    """Digits of the first boxed integer as text, else empty."""
    return F.regexp_extract(text, BOXED_INT, 1)


def boxed_decimal(text: Column) -> Column:
    """Digits of the first boxed number with at most one decimal, else empty."""
    return F.regexp_extract(text, BOXED_DECIMAL, 1)


def agent_fields(text: Column) -> Column:
    return F.struct(
        F.regexp_extract(text, ANSWER_FIELD, 1).alias("answer"),
        F.regexp_extract(text, ACTION_FIELD, 1).alias("action"),
        strip(F.regexp_extract(text, VALUE_FIELD, 1)).alias("value"),
    )


def tool_parts(text: Column) -> Column:
    return F.struct(
        text.rlike(THOUGHT_PART).alias("has_thought"),
        text.rlike(ACTION_PART).alias("has_action"),
        text.rlike(ACTION_INPUT_PART).alias("has_action_input"),
        F.regexp_extract(text, TOOL_NAME, 1).alias("tool"),
        F.nullif(F.regexp_extract(text, TOOL_PARAMS, 1), F.lit("")).alias("params"),
        text.rlike(FINISH_CALL).alias("finish"),
        F.when(text.rlike(FINAL_ANSWER), F.regexp_extract(text, FINAL_ANSWER, 1)).alias("final_answer"),
    )


def solution_answer(text: Column, let: Stages) -> Column:
    """Answer inside already unwrapped output; null when a JSON ``answer`` is not text.

    Order: solution tag, answer tag, ``answer`` member or JSON string, whole text. Empty
    and falsy values fall through to the next form.
    """
    tagged = let(strip(F.regexp_extract(text, SOLUTION_TAG, 1)))
    bracketed = let(strip(F.regexp_extract(text, ANSWER_TAG, 1)))
    trimmed = let(strip(text))
    # Only texts that open like an object or a string can hold a JSON answer.
    kind = let(F.when(trimmed.startswith("{") | trimmed.startswith('"'), json_kind(trimmed)))
    raw = let(F.when(kind == "object", json_member_raw(trimmed, "answer")))
    truthy = raw.isNotNull() & ~raw.isin("null", "false", "0", "-0", '""', "[]", "{}")
    quoted = let(F.when(kind == "string", F.nullif(json_string(trimmed), F.lit(""))))
    return let(
        F.when(tagged != "", tagged)
        .when(bracketed != "", bracketed)
        .when(truthy & raw.startswith('"'), F.try_element_at(json_map(trimmed), F.lit("answer")))
        .when(truthy, F.lit(None).cast("string"))
        .otherwise(F.coalesce(quoted, trimmed))
    )
