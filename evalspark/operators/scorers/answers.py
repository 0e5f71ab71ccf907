"""Scorers that compare short answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.extract import agent_fields, boxed_int
from evalspark.functions.text import strip
from evalspark.operators.scoring import Case, bad_unless, outcome, register_scorer

def no_details() -> Column:
    return F.lit(None).cast("string")


def _boxes(case: Case) -> tuple[Column, Column, Column]:
    got, want = case.let(boxed_int(case.model_output)), case.let(boxed_int(case.reference_output))
    return got, want, (got == want) & (got != "")


@register_scorer("exact_match", "Boxed integers are equal; a mismatch is a bad case")
def exact_match(case: Case) -> Column:
    got, want, same = _boxes(case)
    details = F.struct(got.alias("model_value"), want.alias("reference_value"))
    return outcome(F.when(same, 1.0).otherwise(0.0), bad_unless(same), details)


@register_scorer("box", "Boxed integers are equal; only the threshold marks bad cases")
def box(case: Case) -> Column:
    _, _, same = _boxes(case)
    return outcome(F.when(same, 1.0).otherwise(0.0), F.lit(0), no_details())


@register_scorer("equal_check", "Whole text equal after trimming and dropping a final full stop")
def equal_check(case: Case) -> Column:
    text = case.model_output
    trimmed = case.let(strip(text))
    # The dropped character is the last one of the untrimmed output.
    shortened = F.when(trimmed.endswith("."), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    same = strip(shortened) == strip(case.reference_output)
    blank = F.when(trimmed == "", "blank model output")
    return outcome(F.when(same, 1.0).otherwise(0.0), F.lit(0), no_details(), blank)


@register_scorer("str_check", "Deprecated: never yields a score, every row is an error")
def str_check(case: Case) -> Column:
    return outcome(F.lit(None), F.lit(1), no_details(), F.lit("scorer returned no result"))


@register_scorer("agent_instruct_score", "Answer and action fields, with a bonus for the value field")
def agent_instruct(case: Case) -> Column:
    got, want = case.let(agent_fields(case.model_output)), case.let(agent_fields(case.reference_output))
    answer, action = got["answer"] == want["answer"], got["action"] == want["action"]
    value = (want["value"] != "") & F.contains(F.lower(got["value"]), F.lower(want["value"]))
    base = case.let(F.when(answer & action, 1.0).when(answer | action, 0.5).otherwise(0.0))
    total = case.let(F.when(value & (base > 0), F.least(F.lit(1.0), base + 0.2)).otherwise(base))
    details = F.struct(
        got["answer"].alias("model_answer"), want["answer"].alias("reference_answer"),
        got["action"].alias("model_action"), want["action"].alias("reference_action"),
        got["value"].alias("model_value"), want["value"].alias("reference_value"),
        (answer & action).alias("exact_match"), (answer | action).alias("partial_match"), value.alias("value_match"),
        F.lit("agent_instruct_score").alias("metric"),
    )
    return outcome(total, bad_unless(total >= 0.5), details)
