"""Scorers for JSON objects and answer lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.extract import solution_answer
from evalspark.functions.jsons import (
    canonical_json,
    dumped_json,
    extract_json_text,
    json_kind,
    json_map,
    json_member_raw,
    json_string,
)
from evalspark.functions.text import S, strip
from evalspark.operators.scoring import Case, bad_unless, outcome, register_scorer


def _shown(member: Column) -> Column:
    """Member text for comparison; a JSON null reads ``none``."""
    return F.lower(F.coalesce(member, F.lit("none")))


@register_scorer("json_check", "Share of reference keys with an equal value in the output object")
def json_check(case: Case) -> Column:
    let = case.let
    got_text, want_text = extract_json_text(case.model_output, let), extract_json_text(case.reference_output, let)
    got_kind, want_kind = let(json_kind(got_text)), let(json_kind(want_text))
    got, want = let(json_map(got_text)), let(json_map(want_text))
    equal = F.map_filter(
        want, lambda k, v: F.map_contains_key(got, k) & (_shown(F.try_element_at(got, k)) == _shown(v))
    )
    hits, keys = let(F.size(equal)), let(F.size(want))
    objects = (got_kind == "object") & (want_kind == "object")
    share = F.when(objects & (keys > 0), hits / F.nullif(keys, F.lit(0))).otherwise(0.0)
    problem = let(
        F.when(got_kind.isNull() | want_kind.isNull(), "not valid JSON")
        .when(~objects, "both sides must be JSON objects")
        .when(keys == 0, "empty reference object")
    )
    details = F.struct(problem.alias("error"), F.when(problem.isNull() & (hits < keys), got_text).alias("json_content"))
    return outcome(share, bad_unless(problem.isNull() & (hits == keys)), details)


@register_scorer("list_check", "Comma lists agree item by item, or JSON lists and objects are equal")
def list_check(case: Case) -> Column:
    let = case.let
    text = solution_answer(extract_json_text(case.model_output, let), let)
    model_json = let(text.rlike(rf"^{S}*[\[{{]") & json_kind(text).isNotNull())

    ref_text = extract_json_text(case.reference_output, let)
    ref_kind = let(json_kind(ref_text))
    members = let(F.when(ref_kind == "object", json_map(ref_text)))
    has_answer = let(F.coalesce(F.map_contains_key(members, F.lit("answer")), F.lit(False)))
    member = let(F.when(has_answer, F.try_element_at(members, F.lit("answer"))))
    raw_member = let(F.when(has_answer, json_member_raw(ref_text, "answer")))
    # A reference `answer` of JSON null falls back to the whole reference text.
    member_null = has_answer & F.coalesce(raw_member == "null", F.lit(True))
    member_nested = has_answer & (raw_member.startswith("{") | raw_member.startswith("["))
    ref_nested = let(member_nested | (~has_answer & F.coalesce(ref_kind.isin("array", "object"), F.lit(False))))
    ref_value = let(
        F.when(member_null, ref_text)
        .when(member_nested, dumped_json(member))
        .when(has_answer, member)
        .when(ref_kind == "string", json_string(ref_text))
        .when(ref_nested, dumped_json(ref_text))
        .otherwise(ref_text)
    )
    want = let(_items(F.lower(ref_value)))
    got = let(_items(text))
    problem = let(
        F.when(text.isNull(), "answer member is not text")
        .when(strip(text) == "", "no answer found")
        .when(ref_kind == "scalar", "reference is a bare number, boolean or null")
        .when(model_json & ref_nested, F.when(canonical_json(text) != canonical_json(ref_value), "JSON content differs"))
        .when(F.size(got) != F.size(want), "list lengths differ")
        .when(~F.forall(got, lambda item: F.array_contains(want, strip(F.lower(item)))), "an item is not in the reference")
    )
    ok = problem.isNull()
    return outcome(F.when(ok, 1.0).otherwise(0.0), bad_unless(ok), F.struct(text.alias("model_answer"), problem.alias("error")))


def _items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda item: item != "")
