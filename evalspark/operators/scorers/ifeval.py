"""Instruction-following checks.

Every instruction of a case is checked inside the row (one ``transform`` over the
instruction array), so scoring needs no shuffle and each instruction evaluates only its
own rule. ``ifeval_checks`` gives the same verdicts as a long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.jsons import json_kind, json_map, json_valid
from evalspark.functions.staged import bind
from evalspark.functions.text import (
    D,
    S,
    W,
    collapse_ws,
    count_low,
    count_substr,
    first_word,
    lines,
    paragraphs,
    relation_cmp,
    sentences,
    strip,
    word_count,
)
from evalspark.operators.scoring import Case, bad_unless, outcome, register_scorer
from evalspark.plans.generators import explode_computed
from evalspark.schemas import IFEVAL_SPEC

# Fixed patterns of the structural checks.
BULLET = rf"^([-*]|{D}+\.){S}+"
HIGHLIGHT = r"\*[^*]+\*|\*\*[^*]+\*\*"
SECTION = rf"(?md)^{S}*#+{S}+.+"
PLACEHOLDER = r"(?d)\[.*?\]|<.*?>"
_UPPER = r"[\p{L}&&[^\p{Ll}]]"
NO_LOWER_WORD = rf"({_UPPER}(?<!{W}{_UPPER}){_UPPER}*)(?!{W})"
RESPONSE_MARKERS = ("response 1", "response 2", "part 1", "part 2")
MAX_TITLE = 150
MIN_LANGUAGE_CHARS = 5


class _Args:
    """Arguments of one instruction; a missing required one fails the check."""

    def __init__(self, kwarg: Column):
        self._kwarg = kwarg
        self.needed: list[Column] = []

    def get(self, name: str) -> Column:
        self.needed.append(F.map_contains_key(self._kwarg, F.lit(name)))
        return F.try_element_at(self._kwarg, F.lit(name))

    def words(self, name: str) -> Column:
        return F.from_json(self.get(name), "array<string>")


def _holds(low: Column, keyword: Column) -> Column:
    return F.contains(low, F.lower(keyword))


def _found(passed: Column, measured: Column | None = None) -> Column:
    """A verdict with the number it rests on, where it rests on one."""
    measured = F.lit(None) if measured is None else measured
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), measured.cast("double").alias("measured"))


def _letter_share(text: Column, a: _Args) -> Column:
    letter, target, relation = a.get("letter"), a.get("let_frequency"), a.get("let_relation")
    share = bind(F.regexp_replace(text, "[^a-zA-Z]+", ""), lambda letters: count_substr(letters, letter) / F.nullif(F.length(letters), F.lit(0)) * 100.0)
    return bind(share, lambda s: _found(s.isNotNull() & relation_cmp(s, target, relation), s))


def _capital_words(text: Column, a: _Args) -> Column:
    candidates = F.regexp_extract_all(text, F.lit(NO_LOWER_WORD), F.lit(1))
    shouted = F.filter(candidates, lambda w: (w == F.upper(w)) & (w != F.lower(w)))
    wanted, relation = a.get("capital_frequency"), a.get("relation")
    return bind(F.size(shouted), lambda n: _found((first_word(text) != "") & relation_cmp(n, wanted, relation), n))


def _nth_first_word(text: Column, a: _Args) -> Column:
    nth = a.get("nth_paragraph").try_cast("double").try_cast("int")
    paragraph = F.get(paragraphs(text), nth - 1)
    opening = F.lower(first_word(paragraph))
    return (nth >= 1) & (opening != "") & (opening == F.lower(strip(a.get("first_word"))))


def _edge_keyword(low: Column, a: _Args) -> Column:
    keyword, position = F.lower(a.get("keyword")), a.get("position")
    return F.when(position == "start", low.startswith(keyword)).when(position == "end", low.endswith(keyword))


def _repeats_prompt(low: Column, a: _Args) -> Column:
    prompt = a.get("prompt_to_repeat")
    return (prompt != "") & _holds(collapse_ws(low), collapse_ws(prompt))


def _ends_with(low: Column, a: _Args) -> Column:
    phrase = a.get("end_phrase")
    return (phrase != "") & low.endswith(F.lower(strip(phrase)))


def _counted(count: Column, a: _Args, target: str) -> Column:
    wanted, relation = a.get(target), a.get("relation")
    return bind(count, lambda n: _found(relation_cmp(n, wanted, relation), n))


def _frequency(low: Column, a: _Args) -> Column:
    keyword, wanted, relation = a.get("keyword"), a.get("frequency"), a.get("relation")
    return bind(count_low(low, F.lower(keyword)), lambda n: _found(keyword.isNotNull() & relation_cmp(n, wanted, relation), n))


def _language(text: Column, a: _Args, detected: Column) -> Column:
    wanted = F.get(F.split(F.lower(a.get("language")), "-", -1), F.lit(0))
    return (F.length(text) >= MIN_LANGUAGE_CHARS) & (F.lower(detected) == wanted)


def _rules(text: Column, low: Column, detected: Column) -> dict:
    """``low`` is ``text`` in lower case; rules of ``COUNTING`` give ``_found``, the others a verdict. Check id (``:`` written ``_``) -> rule. Ids, argument names and limits are fixed values."""
    return {
        "detectable_format_title": lambda a: F.length(text).between(1, MAX_TITLE) & ~text.rlike(r"[\n\r]"),
        "keywords_existence": lambda a: F.forall(a.words("keywords"), lambda k: _holds(low, k)),
        "combination_repeat_prompt": lambda a: _repeats_prompt(low, a),
        "keywords_letter_frequency": lambda a: _letter_share(text, a),
        "keywords_frequency": lambda a: _frequency(low, a),
        "keywords_forbidden_words": lambda a: ~F.exists(a.words("forbidden_words"), lambda k: _holds(low, k)),
        "length_constraints_number_words": lambda a: _counted(word_count(text), a, "num_words"),
        "length_constraints_number_sentences": lambda a: _counted(F.size(sentences(text)), a, "num_sentences"),
        "length_constraints_number_paragraphs": lambda a: _counted(F.size(paragraphs(text)), a, "num_paragraphs"),
        "length_constraints_nth_paragraph_first_word": lambda a: _nth_first_word(text, a),
        "detectable_format_number_bullet_lists": lambda a: _counted(
            F.size(F.filter(lines(text), lambda line: line.rlike(BULLET))), a, "num_bullets"
        ),
        "detectable_format_constrained_response": lambda a: F.length(text) > 0,
        "detectable_format_number_highlighted_sections": lambda a: _counted(
            F.regexp_count(text, F.lit(HIGHLIGHT)), a, "num_highlights"
        ),
        "detectable_format_multiple_sections": lambda a: _counted(F.regexp_count(text, F.lit(SECTION)), a, "num_sections"),
        "detectable_format_json_format": lambda a: json_valid(F.regexp_extract(text, r"(?s)\{.*\}", 0)),
        "detectable_content_number_placeholders": lambda a: _counted(
            F.regexp_count(text, F.lit(PLACEHOLDER)), a, "num_placeholders"
        ),
        "detectable_content_postscript": lambda a: F.contains(low, F.lit("p.s.")),
        "start_end_constraints_forbidden_start_words": lambda a: ~F.array_contains(
            F.transform(a.words("forbidden_words"), F.lower), F.lower(first_word(text))
        ),
        "start_end_constraints_keywords": lambda a: _edge_keyword(low, a),
        "startend_end_checker": lambda a: _ends_with(low, a),
        "startend_quotation": lambda a: (F.length(text) >= 2) & text.startswith('"') & text.endswith('"'),
        "change_case_capital_word_frequency": lambda a: _capital_words(text, a),
        "change_case_english_lowercase": lambda a: text == low,
        "change_case_english_capital": lambda a: text == F.upper(text),
        "language_response_language": lambda a: _language(text, a, detected),
        "punctuation_no_comma": lambda a: ~F.contains(text, F.lit(",")),
        "combination_two_responses": lambda a: sum(
            (F.contains(low, F.lit(m)).cast("int") for m in RESPONSE_MARKERS), F.lit(0)
        ) >= 2,
    }


COUNTING = frozenset((
    "keywords_letter_frequency", "keywords_frequency", "length_constraints_number_words", "length_constraints_number_sentences",
    "length_constraints_number_paragraphs", "detectable_format_number_bullet_lists", "detectable_format_number_highlighted_sections",
    "detectable_format_multiple_sections", "detectable_content_number_placeholders", "change_case_capital_word_frequency",
))
UNKNOWN, INCOMPLETE = "not implemented", "missing argument"


def check(instruction_id: Column, kwarg: Column, raw: Column, text: Column, low: Column, detected: Column | None = None) -> Column:
    """(passed, measured, note): whether ``raw`` (``text`` when trimmed, ``low`` in lower case too) follows
    one instruction, and the count or share that was compared. Unknown ids and missing arguments
    fail, and ``note`` says so."""
    detected = F.lit(None).cast("string") if detected is None else detected
    return bind(F.replace(instruction_id, F.lit(":"), F.lit("_")), lambda name: _judged(name, kwarg, text, low, detected))


def _judged(name: Column, kwarg: Column, text: Column, low: Column, detected: Column) -> Column:
    """One choice of the rule: its verdict and whether its arguments are there come out together."""
    found = None
    for rule_id, rule in _rules(text, low, detected).items():
        args = _Args(kwarg)
        verdict = rule(args) if rule_id in COUNTING else _found(rule(args))
        present = F.lit(True)
        for given in args.needed:
            present = present & given
        verdict = F.struct(present.alias("complete"), (F.when(present, verdict) if args.needed else verdict).alias("verdict"))
        found = F.when(name == rule_id, verdict) if found is None else found.when(name == rule_id, verdict)

    def told(f: Column) -> Column:
        note = F.when(f["complete"].isNull(), UNKNOWN).when(~f["complete"], INCOMPLETE)
        return F.struct(F.coalesce(f["verdict"]["passed"], F.lit(False)).alias("passed"), f["verdict"]["measured"].alias("measured"), note.alias("note"))

    return bind(found, told)


def _has_kwargs(kwarg: Column) -> Column:
    return F.coalesce(F.size(kwarg) > 0, F.lit(False))


def parse_spec(reference: Column) -> Column:
    return F.from_json(reference, IFEVAL_SPEC)


@register_scorer("ifeval_full_scorer", "Share of followed instructions; bad unless all are followed")
def ifeval(case: Case) -> Column:
    let = case.let
    spec = let(parse_spec(case.reference_output))
    text = let(strip(case.model_output))
    low = let(F.lower(text))
    ids, kwargs = spec["instruction_id_list"], spec["kwargs"]
    pairs = F.arrays_zip(ids.alias("id"), kwargs.alias("kwarg"))
    total, given = let(F.coalesce(F.size(ids), F.lit(-1))), F.coalesce(F.size(kwargs), F.lit(-1))
    members = json_map(case.reference_output)
    # A missing argument list is a mismatch, an explicit null one cannot be read at all.
    unreadable = F.when(
        (total > 0) & (given < 0) & F.map_contains_key(members, F.lit("kwargs")) & F.try_element_at(members, F.lit("kwargs")).isNull(),
        "kwargs is null",
    )
    problem = let(
        F.when(F.coalesce(json_kind(case.reference_output) != "object", F.lit(True)), "Reference format error")
        .when(total <= 0, F.lit(None).cast("string"))
        .when(total != given, "Metadata mismatch")
    )
    breakdown = F.transform(
        # Instructions without arguments are left out here but stay in the total.
        F.filter(pairs, lambda p: _has_kwargs(p["kwarg"])),
        lambda p: bind(check(p["id"], p["kwarg"], case.model_output, text, low, case.detected_lang), lambda r: F.struct(
            p["id"].alias("instruction_id"), r["passed"].alias("passed"), r["measured"].alias("measured"), r["note"].alias("note"), p["kwarg"].alias("kwargs"),
        )),
    )
    usable = problem.isNull() & (total > 0)
    results = let(F.when(usable, breakdown))
    passed = let(F.size(F.filter(results, lambda r: r["passed"])))
    score = (
        F.when(problem.isNotNull(), 0.0).when(total <= 0, 1.0).otherwise(passed / F.nullif(total, F.lit(0)))
    )
    bad = F.when(problem.isNotNull(), 1).when(total <= 0, 0).otherwise(bad_unless(passed == total))
    details = F.struct(
        F.coalesce(problem, F.when(total <= 0, "No instructions found")).alias("note"),
        F.when(usable, total).alias("total_instructions"),
        F.when(usable, passed).alias("passed_count"),
        results.alias("instruction_breakdown"),
    )
    return outcome(score, bad, details, unreadable)


def ifeval_checks(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long table: one row per instruction that carries arguments, with what was measured."""
    keys = keys or ["index"]
    spec = parse_spec(F.col("reference_output"))
    detected = F.col("detected_lang") if "detected_lang" in df.columns else None
    given = ["detected_lang"] if detected is not None else []
    staged = df.select(*keys, "model_output", *given, strip(F.col("model_output")).alias("_text"), spec.alias("_spec")).withColumn("_low", F.lower("_text"))
    pairs = F.arrays_zip(F.col("_spec.instruction_id_list").alias("id"), F.col("_spec.kwargs").alias("kwarg"))
    # Judged inside the row: only names and verdicts are exploded, never the texts.
    verdicts = F.transform(pairs, lambda p: F.struct(
        p["id"].alias("id"), _has_kwargs(p["kwarg"]).alias("given"),
        F.when(_has_kwargs(p["kwarg"]), check(p["id"], p["kwarg"], F.col("model_output"), F.col("_text"), F.col("_low"), detected)).alias("found"),
    ))
    checks = explode_computed(staged, verdicts, "pos", "_v", *keys)
    return checks.where("_v.given").select(*keys, "pos", F.col("_v.id").alias("instruction_id"), "_v.found.passed", "_v.found.measured", "_v.found.note")


def ifeval_rollup(checks: DataFrame, totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per case: passed and total over the long table; ``totals`` holds (keys, total)."""
    keys = keys or ["index"]
    passed = checks.groupBy(*keys).agg(F.count_if("passed").alias("passed_count"))
    return totals.join(passed, keys, "left").withColumn("passed_count", F.coalesce("passed_count", F.lit(0)))
