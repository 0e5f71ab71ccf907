"""Tool-call scorer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.extract import tool_parts
from evalspark.functions.jsons import STRICT, fold_booleans, json_valid, last_wins
from evalspark.functions.text import S, strip
from evalspark.operators.scoring import Case, bad_unless, outcome, register_scorer

# Weights, cut-offs and tags of the rubric.
FORMAT_WEIGHT, PARAM_WEIGHT = 0.3, 0.3
TOOL_RIGHT, TOOL_OTHER = 0.4, 0.1
FINISH_DONE, FINISH_PARTLY, FINISH_ONLY = 0.2, 0.05, 0.1
BAD_BELOW = 0.6
TIERS = ((0.9, "excellent"), (0.7, "good"), (0.5, "fair"))


def _typed_params(text: Column) -> Column:
    """Members as JSON text that keeps types; 1, 1.0 and true compare equal at any depth."""
    members = last_wins(F.from_json(text, "map<string,variant>", STRICT))

    def fold(_, member: Column) -> Column:
        return fold_booleans(F.coalesce(F.to_json(member), F.lit("null")))

    return F.transform_values(members, fold)


def _keywords(answer: Column) -> Column:
    return F.array_distinct(F.filter(F.split(strip(F.lower(answer)), f"{S}+"), lambda w: w != ""))


@register_scorer("toolbench_evaluation", "Format, tool choice, parameters and finish bonus of a tool call")
def tool_call(case: Case) -> Column:
    let = case.let
    got, want = let(tool_parts(case.model_output)), let(tool_parts(case.reference_output))

    asked = [(want[f"has_{p}"], got[f"has_{p}"], p) for p in ("thought", "action", "action_input")]
    expected = sum((w.cast("int") for w, _, _ in asked), F.lit(0))
    matched = sum(((w & g).cast("int") for w, g, _ in asked), F.lit(0))
    format_score = let(F.coalesce((matched / F.nullif(expected, F.lit(0))) * FORMAT_WEIGHT, F.lit(0.0)))
    format_tags = [F.when(w, F.when(g, f"{p}_format_correct").otherwise(f"{p}_format_missing")) for w, g, p in asked]

    same_tool = (want["tool"] != "") & (got["tool"] == want["tool"])
    both_tools = (want["tool"] != "") & (got["tool"] != "")
    tool_score = let(F.when(same_tool, TOOL_RIGHT).when(both_tools, TOOL_OTHER).otherwise(0.0))
    tool_tag = F.when(same_tool, "tool_selection_correct").when(both_tools, "tool_selection_incorrect").otherwise("tool_selection_missing")

    both_params = want["params"].isNotNull() & got["params"].isNotNull()
    readable = let(both_params & json_valid(got["params"]) & json_valid(want["params"]))
    got_params = let(F.when(readable, _typed_params(got["params"])))
    want_params = let(F.when(readable, _typed_params(want["params"])))
    keys = F.size(want_params)
    hits = let(F.size(F.map_filter(want_params, lambda k, v: F.coalesce(F.try_element_at(got_params, k) == v, F.lit(False)))))
    param_score = let(F.coalesce((hits / F.nullif(keys, F.lit(0))) * PARAM_WEIGHT, F.lit(0.0)))
    param_tag = (
        F.when(keys > 0, F.when(hits == keys, "params_completely_correct").when(hits > 0, "params_partially_correct").otherwise("params_incorrect"))
        .when(both_params & ~readable, "params_format_error")
        .when(want["params"].isNotNull() & got["params"].isNull(), "params_missing")
    )

    finished = want["finish"] & got["finish"]
    answered = want["final_answer"].isNotNull() & got["final_answer"].isNotNull()
    want_words, got_words = let(_keywords(want["final_answer"])), let(_keywords(got["final_answer"]))
    enough = let((F.size(want_words) > 0) & (F.size(F.array_intersect(want_words, got_words)) >= 0.5 * F.size(want_words)))
    bonus = let(F.when(finished, F.when(answered & enough, FINISH_DONE).when(answered, FINISH_PARTLY).otherwise(FINISH_ONLY)).otherwise(0.0))
    bonus_tag = F.when(
        finished,
        F.when(answered & enough, "task_successfully_completed").when(answered, "task_partially_completed").otherwise("finish_called"),
    )

    total = let(F.least(format_score + tool_score + param_score + bonus, F.lit(1.0)))
    tier = F.lit("poor")
    for floor, label in reversed(TIERS):
        tier = F.when(total >= floor, label).otherwise(tier)
    details = F.struct(
        tier.alias("overall_assessment"),
        format_score.alias("format_score"),
        tool_score.alias("tool_selection_score"),
        param_score.alias("parameter_score"),
        bonus.alias("completion_bonus"),
        F.array_compact(F.array(*format_tags, tool_tag, param_tag, bonus_tag)).alias("assessment_parts"),
        got["tool"].alias("model_tool_used"),
        want["tool"].alias("reference_tool_expected"),
    )
    return outcome(total, bad_unless(total >= BAD_BELOW), details)
