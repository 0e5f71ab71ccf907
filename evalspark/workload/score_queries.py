"""Scorers, thresholds and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import summary
from evalspark.operators.partials import RunningSummary, summary_of
from evalspark.operators.scorers import ifeval, judged, rouge
from evalspark.operators.scoring import apply_threshold as threshold_rule
from evalspark.operators.scoring import outcome, register_python_scorer, register_scorer, score
from evalspark.plans.durable import fresh_path
from evalspark.workload.fixtures import AGENT, BOXED, JSON, LIST, LIST_JSON, REFUSAL, TEXT, TOOL, Fixture, json_text, table
from evalspark.workload.text_queries import BOXED_SQL, SENTENCES, STRIPPED, WORD, WS, agent_sql, extract_json_sql, nonblank_parts, solution_sql

TURN = ["conv_id", "turn"]
ORDER = ["o_orderkey"]


def _scored(fixture, name, keys, threshold=1.0, details=(), **renamed):
    def query(spark, sf):
        rows = fixture.frame(spark, sf)
        for new, old in renamed.items():
            rows = rows.withColumn(new, F.col(old))
        out = score(rows, name, threshold)
        return out.select(*keys, F.round("score", 9).alias("score"), "is_badcase", *[F.col(f"details.{d}") for d in details])

    return query


def score_rouge_n(spark, sf):
    return rouge.with_rouge(TEXT.frame(spark, sf)).select(*TURN, *[F.round(c, 9).alias(c) for c in ("rouge1", "rouge2")])


def score_rouge_l(spark, sf):
    return rouge.with_rouge(TEXT.frame(spark, sf)).select(*TURN, F.round("rougeL", 9).alias("rougeL"))


def score_rouge(spark, sf):
    out = score(TEXT.frame(spark, sf), "rouge", 0.5)
    return out.select(*TURN, F.round("score", 9).alias("score"), "is_badcase",
                      *[F.round(f"details.{k}", 9).alias(k) for k in ("rouge1", "rouge2", "rougeL")])


def score_str_check(spark, sf):
    return score(BOXED.frame(spark, sf), "str_check").select(*TURN, "score", "is_badcase", "error")


def score_equal(spark, sf):
    # Blank outputs must become error rows.
    rows = TEXT.frame(spark, sf).withColumn("model_output", F.expr("CASE WHEN conv_id % 10 = 9 THEN ' ' ELSE model_output END"))
    return score(rows, "equal_check").select(*TURN, "score", "is_badcase", F.col("error").isNotNull().alias("failed"))


THRESHOLD = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "raw_score": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS DOUBLE) / 10 END",
    "raw_bad": "CASE WHEN o_orderkey % 13 = 0 THEN 1 WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END",
    "raw_error": "CASE WHEN o_custkey % 17 = 0 THEN 'boom' END",
    "model_output": "CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE 'x' END",
    "reference_output": "'x'",
})


def apply_threshold(spark, sf):
    rows = THRESHOLD.frame(spark, sf)
    built = outcome(F.col("raw_score"), F.col("raw_bad"), F.lit(None).cast("string"), F.col("raw_error"))
    return threshold_rule(rows.withColumn("_outcome", built), 0.5).select("o_orderkey", "score", "is_badcase", "error")


def run_summary(spark, sf):
    out = summary.run_summary(score(BOXED.frame(spark, sf), "exact_match"))
    return out.select("run_id", "total_count", "correct_count", *[F.round(c, 6).alias(c) for c in ("accuracy", "average_score", "average_inference_time")], "badcase_count")


def run_summary_rouge(spark, sf):
    out = summary.run_summary(score(TEXT.frame(spark, sf), "rouge", 0.5))
    return out.select("run_id", "total_count", "correct_count", F.round("average_score", 6).alias("average_score"),
                      *[F.round(F.try_element_at("rouge_scores", F.lit(k)), 6).alias(k) for k in summary.ROUGE_KEYS], "badcase_count")


def _appended(spark, results, by, parts):
    """A running summary of results that come in parts, each scored and added once."""
    store = RunningSummary(spark, fresh_path(spark, "summary"), results, by, every=2)
    for batch, part in enumerate(parts):
        store.append(results.where(part), batch)
    return store


def run_summary_appended(spark, sf):
    store = _appended(spark, score(BOXED.frame(spark, sf), "exact_match"), ["run_id", "turn"], ["turn < 2", "turn >= 2 AND turn < 4", "turn >= 4"])
    out = summary_of(store.partials(["run_id"]))
    return out.select("run_id", "total_count", "correct_count", *[F.round(c, 6).alias(c) for c in ("accuracy", "average_score", "average_inference_time")], "badcase_count")


def run_summary_rouge_appended(spark, sf):
    store = _appended(spark, score(TEXT.frame(spark, sf), "rouge", 0.5), ["run_id"], ["turn < 3", "turn >= 3"])
    return summary_of(store.partials()).select("run_id", "total_count", "correct_count", F.round("average_score", 6).alias("average_score"),
                                               *[F.round(F.try_element_at("rouge_scores", F.lit(k)), 6).alias(k) for k in summary.ROUGE_KEYS], "badcase_count")


def badcases(spark, sf):
    return summary.badcases(score(BOXED.frame(spark, sf), "exact_match")).select(*TURN, "score", "model_output")


def run_results(spark, sf):
    scored = score(BOXED.frame(spark, sf), "exact_match").withColumn("index", F.col("conv_id") * 1000 + F.col("turn"))
    return summary.run_results(scored).select("index", "run_id", "score", "is_badcase")


def custom_scorer(spark, sf):
    @register_scorer("length_ratio", "Shorter length over longer length")
    def length_ratio(case):
        a, b = F.length(case.model_output), F.length(case.reference_output)
        return outcome(F.least(a, b) / F.greatest(a, b, F.lit(1)), F.lit(0), F.lit(None).cast("string"))

    return score(TEXT.frame(spark, sf), "length_ratio", 0.9).select(*TURN, F.round("score", 9).alias("score"), "is_badcase")


def custom_python_scorer(spark, sf):
    """A plain Python scorer over all replies; the rows on which it fails do so alone."""

    def overlap(messages, output, reference):
        if len(output) % 7 == 0:
            raise ValueError("unlucky length")
        if len(output) % 7 == 1:
            return {}
        same = sum(a == b for a, b in zip(output, reference))
        return {"score": same / max(len(output), len(reference), 1), "is_badcase": int(len(output) % 7 == 2), "details": {"same": same}}

    register_python_scorer("same_characters", overlap)
    out = score(TEXT.frame(spark, sf), "same_characters", 0.5)
    return out.select(*TURN, F.round("score", 9).alias("score"), "is_badcase", F.get_json_object("details", "$.same").cast("long").alias("same"), "error")


def attach_verdicts(spark, sf):
    """Judge requests become a verdict table, which comes back to the results and is scored."""
    rows = BOXED.frame(spark, sf)
    asked = judged.judge_requests(rows.withColumn("user_input", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))))
    # A stand-in judge: it answers two requests in three, by the length of what it was sent.
    sent = F.length(F.element_at("judge_messages", 2)["content"])
    verdicts = asked.where("conv_id % 3 <> 2").select(*TURN, F.concat(F.lit("so \\boxed{"), (sent % 3).cast("string"), F.lit("}")).alias("verdict"))
    scored = score(judged.attach_verdicts(rows.drop("verdict"), verdicts, TURN), "verdict_with_answer")
    return scored.select(*TURN, "score", "is_badcase", "verdict")


# --- instruction checks: one document, every rule -------------------------------------

# (id, arguments, DuckDB rule on trimmed text ``t`` with target ``g``)
RULES = (
    ("detectable_format:title", '{"x": 1}', "length(t) BETWEEN 1 AND 150 AND NOT contains(t, chr(10)) AND NOT contains(t, chr(13))"),
    ("keywords:existence", '{"keywords": ["la", "DE"]}', "contains(lower(t), 'la') AND contains(lower(t), 'de')"),
    ("combination:repeat_prompt", '{"prompt_to_repeat": " the  and "}', r"contains(lower(regexp_replace(t, '\s+', ' ', 'g')), 'the and')"),
    ("keywords:letter_frequency", '{"letter": "E", "let_frequency": #, "let_relation": "at least"}',
     "CASE WHEN length(a) > 0 THEN (length(a) - length(replace(a, 'e', ''))) / length(a) * 100.0 >= g ELSE false END"),
    ("keywords:frequency", '{"keyword": "the", "frequency": #, "relation": "less than"}', "(length(l) - length(replace(l, 'the', ''))) / 3 < g"),
    ("keywords:forbidden_words", '{"forbidden_words": ["nicht", "Que"]}', "NOT (contains(l, 'nicht') OR contains(l, 'que'))"),
    ("length_constraints:number_words", '{"num_words": #, "relation": "at least"}', f"len(regexp_extract_all(t, '{WORD}+')) >= g"),
    ("length_constraints:number_paragraphs", '{"num_paragraphs": 1, "relation": ""}', nonblank_parts("chr(10) || chr(10)") + " = 1"),
    ("length_constraints:nth_paragraph_first_word", '{"nth_paragraph": 1, "first_word": "Die"}',
     f"lower(regexp_extract(t, '{WORD}+')) = 'die'"),
    ("detectable_format:number_bullet_lists", '{"num_bullets": #, "relation": "at most"}',
     f"len(list_filter(string_split(t, chr(10)), lambda p: regexp_matches(trim(p, {WS}), '^([-*]|[0-9]+\\.)\\s+'))) <= g"),
    ("detectable_format:constrained_response", '{"x": 1}', "length(t) > 0"),
    ("detectable_format:number_highlighted_sections", '{"num_highlights": 2, "relation": "at least"}', r"len(regexp_extract_all(t, '\*[^*]+\*|\*\*[^*]+\*\*')) >= 2"),
    ("detectable_format:multiple_sections", '{"num_sections": 0, "relation": "greater than"}', r"len(regexp_extract_all(t, '(?m)^\s*#+\s+.+')) > 0"),
    ("detectable_format:json_format", '{"x": 1}', r"coalesce(json_valid(nullif(regexp_extract(t, '(?s)\{.*\}'), '')), false)"),
    ("detectable_content:number_placeholders", '{"num_placeholders": 1, "relation": "less than"}', r"len(regexp_extract_all(t, '\[.*?\]|<.*?>')) < 1"),
    ("detectable_content:postscript", '{"x": 1}', "contains(l, 'p.s.')"),
    ("start_end_constraints:forbidden_start_words", '{"forbidden_words": ["The", "la", "die"]}', f"lower(regexp_extract(t, '{WORD}+')) NOT IN ('the', 'la', 'die')"),
    ("start_end_constraints:keywords", '{"keyword": "Le", "position": "start"}', "starts_with(l, 'le')"),
    ("startend:end_checker", '{"end_phrase": " EN. "}', "suffix(l, 'en.')"),
    ("startend:quotation", '{"x": 1}', "length(t) >= 2 AND starts_with(t, chr(34)) AND suffix(t, chr(34))"),
    ("change_case:capital_word_frequency", '{"capital_frequency": 1, "relation": "at least"}',
     rf"len(list_filter(regexp_extract_all(t, '{WORD}+'), lambda w: regexp_matches(w, '^\p{{L}}+$') AND w = upper(w) AND w <> lower(w))) >= 1"),
    ("change_case:english_lowercase", '{"x": 1}', "t = l"),
    ("punctuation:no_comma", '{"x": 1}', "NOT contains(t, ',')"),
    ("combination:two_responses", '{"x": 1}',
     "CAST(contains(l, 'response 1') AS INT) + CAST(contains(l, 'response 2') AS INT) + CAST(contains(l, 'part 1') AS INT) + CAST(contains(l, 'part 2') AS INT) >= 2"),
    ("length_constraints:number_sentences", '{"num_sentences": #, "relation": "at least"}', f"{SENTENCES} >= g"),
    ("change_case:english_capital", '{"x": 1}', "t = upper(t)"),
    ("language:response_language", '{"language": "fr-FR"}', "length(t) >= 5 AND lang = 'fr'"),
    ("unknown:rule", '{"x": 1}', "false"),
    ("keywords:frequency", '{"keyword": "missing arguments"}', "false"),
)


def _spec(rules) -> str:
    """Spec text per document as an expression; ``#`` becomes a number from the key."""
    ids = ", ".join(f'"{r[0]}"' for r in rules)
    kwargs = ", ".join(r[1] for r in rules)
    doc = f'{{"instruction_id_list": [{ids}], "kwargs": [{kwargs}]}}'
    return f"replace('{doc}', '#', CAST(doc_id % 50 AS STRING))"


# Whole documents, most of them changed so that no check has one verdict throughout, and short
# replies on top of them.
REPLY_TEXT = f"""CASE doc_id % 9 WHEN 1 THEN concat(chr(34), text, chr(34)) WHEN 2 THEN concat(text, chr(10), 'P.S. one more')
    WHEN 3 THEN concat('{{"a": [1, 2], "t": ', {json_text('text')}, '}}') WHEN 4 THEN lower(text)
    WHEN 5 THEN concat('# Part 1', chr(10), text, chr(10), chr(10), '# Part 2', chr(10), text)
    WHEN 6 THEN concat(repeat(concat('- item', chr(10)), 60), '[name] *a* and *b*', chr(10), text) WHEN 7 THEN concat('   ', text, chr(9), chr(10), ' ')
    WHEN 8 THEN translate(replace(text, 'ß', 'SS'), 'abcdefghijklmnopqrstuvwxyzäöüéèêçñóíáú', 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚ') ELSE text END"""
SHORT = {
    "doc_id": "-1 - doc_id", "lang": "lang",
    "text": "CASE doc_id % 5 WHEN 0 THEN '   ' WHEN 1 THEN 'ALL CAPS HERE' WHEN 2 THEN concat('{\"n\": ', CAST(doc_id AS STRING), '}') WHEN 3 THEN '' ELSE 'Le' END",
}
CHECKS = Fixture("documents", {"doc_id": "doc_id", "model_output": REPLY_TEXT, "detected_lang": "lang", "reference_output": _spec(RULES)}, more=SHORT)

# Three rules per document; some documents carry an empty argument object, a wrong length, or no object.
PICKS = tuple((RULES[i], RULES[i + 6], RULES[i + 12]) for i in range(6))
_NO_ARGS = 12
IFEVAL = Fixture("documents", {
    "doc_id": "doc_id",
    "model_output": REPLY_TEXT,
    "reference_output": "CASE WHEN doc_id % 20 = 19 THEN 'free text' WHEN doc_id % 20 = 18 THEN '{\"instruction_id_list\": [\"a\"], \"kwargs\": []}' WHEN doc_id % 20 = 17 THEN '{\"instruction_id_list\": []}' "
    + "WHEN doc_id % 12 = 2 THEN '{\"instruction_id_list\": [\"punctuation:no_comma\"], \"kwargs\": [{}]}' ELSE CASE doc_id % 6 "
    + " ".join(f"WHEN {i} THEN {_spec(p)}" for i, p in enumerate(PICKS)) + " END END",
})


def ifeval_checks(spark, sf):
    return ifeval.ifeval_checks(CHECKS.frame(spark, sf), ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "instruction_id", "passed")


def ifeval_measured(spark, sf):
    """The number behind every counting check, and why a check could not be made."""
    found = ifeval.ifeval_checks(CHECKS.frame(spark, sf), ["doc_id"])
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("measured", 6).alias("measured"), "note")


def ifeval_rollup(spark, sf):
    """Passed checks per document over the long table."""
    totals = CHECKS.frame(spark, sf).select("doc_id", F.lit(len(RULES)).alias("total"))
    rolled = ifeval.ifeval_rollup(ifeval.ifeval_checks(CHECKS.frame(spark, sf), ["doc_id"]), totals, ["doc_id"])
    return rolled.select("doc_id", "total", "passed_count")


def score_ifeval(spark, sf):
    out = score(IFEVAL.frame(spark, sf), "ifeval_full_scorer")
    return out.select("doc_id", F.round("score", 9).alias("score"), "is_badcase")


QUERIES = {
    "score_exact_match": _scored(BOXED, "exact_match", TURN, details=("model_value", "reference_value")),
    "score_box": _scored(BOXED, "box", TURN, 0.5),
    "score_equal": score_equal,
    "score_json_check": _scored(JSON, "json_check", ORDER),
    "score_list_check": _scored(LIST, "list_check", ORDER),
    "score_list_json": _scored(LIST_JSON, "list_check", ORDER),
    "score_tool_call": _scored(TOOL, "toolbench_evaluation", ORDER, 0.5, ("overall_assessment", "model_tool_used", "reference_tool_expected")),
    "score_tool_tags": lambda spark, sf: score(TOOL.frame(spark, sf), "toolbench_evaluation").select(
        "o_orderkey", F.array_join("details.assessment_parts", ",").alias("tags")),
    "score_agent": _scored(AGENT, "agent_instruct_score", TURN, 0.5),
    "score_reference_verdict": _scored(BOXED, "verdict_with_answer", TURN),
    "score_refusal": _scored(REFUSAL, "reject", ORDER, 0.5),
    **{f.__name__: f for f in (
        score_rouge, score_rouge_n, score_rouge_l, score_str_check, apply_threshold, run_summary, run_summary_rouge, run_summary_appended, run_summary_rouge_appended, badcases,
        run_results, custom_scorer, custom_python_scorer, attach_verdicts, ifeval_checks, ifeval_measured, ifeval_rollup, score_ifeval,
    )},
}

# --- SQL counterparts -------------------------------------------------------------------


def _bad(score_expr: str, bad: str, threshold: float) -> str:
    return f"CAST(CASE WHEN {bad} OR {score_expr} < {threshold} THEN 1 ELSE 0 END AS INTEGER)"


_BOX_PAIR = f"p AS (SELECT *, {BOXED_SQL.format('model_output')} AS got, {BOXED_SQL.format('reference_output')} AS want FROM fx), s AS (SELECT *, CASE WHEN got = want AND got <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p)"
_JSON = f"""p AS (SELECT o_orderkey, {extract_json_sql('model_output')} AS got, {extract_json_sql('reference_output')} AS want FROM fx),
    o AS (SELECT *, json_valid(got) AND json_valid(want) AND coalesce(json_type(CASE WHEN json_valid(got) THEN got END) = 'OBJECT', false) AS usable FROM p),
    j AS (SELECT o_orderkey, usable, CASE WHEN usable THEN got ELSE '{{}}' END AS got, want FROM o),
    s AS (SELECT o_orderkey, CASE WHEN usable THEN (SELECT count(*) FILTER (lower(json_extract_string(got, '$.' || k)) = lower(json_extract_string(want, '$.' || k))) / count(*) FROM unnest(json_keys(want)) AS u(k)) ELSE 0.0 END AS score FROM j)"""

_TOKENS = "tok AS (SELECT conv_id, turn, run_id, regexp_extract_all(lower(reference_output), '[a-z0-9]+') AS a, regexp_extract_all(lower(model_output), '[a-z0-9]+') AS b FROM fx)"


def _overlap(n: int) -> str:
    gram = "list_transform(range(1, len({0}) + 1), lambda i: {0}[i])" if n == 1 else "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    side = lambda c: f"SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest({gram.format(c)}) AS gram FROM tok) GROUP BY ALL"
    return f"ov{n} AS (SELECT x.conv_id, x.turn, sum(least(x.n, y.n)) AS ov FROM ({side('a')}) x JOIN ({side('b')}) y USING (conv_id, turn, gram) GROUP BY ALL)"


def _f(overlap: str, predicted: str, target: str) -> str:
    p, r = f"(coalesce({overlap}, 0) / greatest({predicted}, 1))", f"(coalesce({overlap}, 0) / greatest({target}, 1))"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


# Longest common subsequence: k[l] is the shortest prefix of b that shares l tokens with the
# reference tokens read so far; each further token lowers entries to its next occurrence in b.
_LCS = """lcs AS (SELECT conv_id, turn, len(list_reduce(
        list_transform(a, lambda t: list_filter(range(1, len(b) + 1), lambda j: b[j] = t)),
        lambda k, occ: list_filter(list_transform(range(1, len(k) + 2), lambda l: least(k[l], list_min(list_filter(occ, lambda j: j > CASE WHEN l = 1 THEN 0 ELSE k[l - 1] END)))), lambda x: x IS NOT NULL),
        CAST([] AS BIGINT[]))) AS n FROM tok)"""

_ROUGE = f"""WITH fx AS ({TEXT.sql()}), {_TOKENS}, {_overlap(1)}, {_overlap(2)}, {_LCS},
    r AS (SELECT tok.conv_id, tok.turn, tok.run_id, {_f('ov1.ov', 'len(b)', 'len(a)')} AS rouge1, {_f('ov2.ov', 'len(b) - 1', 'len(a) - 1')} AS rouge2, {_f('lcs.n', 'len(b)', 'len(a)')} AS rougeL
    FROM tok LEFT JOIN ov1 USING (conv_id, turn) LEFT JOIN ov2 USING (conv_id, turn) LEFT JOIN lcs USING (conv_id, turn))"""

_AGENT = f"""p AS (SELECT *, {", ".join(f"{agent_sql(c, f)} AS {p}_{f}" for p, c in (("g", "model_output"), ("w", "reference_output")) for f in ("answer", "action", "value"))} FROM fx),
    q AS (SELECT conv_id, turn, CASE WHEN g_answer = w_answer AND g_action = w_action THEN 1.0::DOUBLE WHEN g_answer = w_answer OR g_action = w_action THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS base,
        w_value <> '' AND contains(lower(g_value), lower(w_value)) AS hit FROM p),
    s AS (SELECT conv_id, turn, CASE WHEN hit AND base > 0 THEN least(1.0, base + 0.2) ELSE base END AS score FROM q)"""


def _tool_sql() -> str:
    def part(c, p):
        return rf"""regexp_matches({c}, '(?i)thought:') AS {p}th, regexp_matches({c}, '(?i)action\s*:') AS {p}ac, regexp_matches({c}, '(?i)action input\s*:') AS {p}ai,
        regexp_extract({c}, '(?i)action\s*:\s*(\w+)', 1) AS {p}tool, nullif(regexp_extract({c}, 'Action Input\s*:\s*(\{{[^{{}}]*\}})', 1), '') AS {p}par,
        regexp_matches({c}, '(?i)action\s*:\s*finish') AS {p}fin, nullif(regexp_extract({c}, '(?i)final_answer\s*:\s*"([^"]*)"', 1), '') AS {p}ans"""
    return f"""p AS (SELECT o_orderkey, {part('model_output', 'g')}, {part('reference_output', 'w')} FROM fx),
    q AS (SELECT *, (wth AND gth)::INT + (wac AND gac)::INT + (wai AND gai)::INT AS fm, wth::INT + wac::INT + wai::INT AS fe,
        (SELECT count(*) FILTER (json_extract(gpar, '$.' || k) = json_extract(wpar, '$.' || k)) FROM unnest(json_keys(wpar)) AS u(k)) AS hits, len(json_keys(wpar)) AS keys,
        list_distinct(string_split(lower(wans), ' ')) AS ww, list_distinct(string_split(lower(gans), ' ')) AS gw FROM p),
    t AS (SELECT *, CASE WHEN fe > 0 THEN (fm / fe) * 0.3::DOUBLE ELSE 0.0 END AS fs, CASE WHEN wtool <> '' AND gtool = wtool THEN 0.4::DOUBLE WHEN wtool <> '' AND gtool <> '' THEN 0.1 ELSE 0.0 END AS ts,
        CASE WHEN gpar IS NOT NULL AND keys > 0 THEN (hits / keys) * 0.3::DOUBLE ELSE 0.0 END AS ps,
        CASE WHEN wfin AND gfin THEN CASE WHEN wans IS NOT NULL AND gans IS NOT NULL THEN CASE WHEN len(list_intersect(ww, gw)) >= 0.5 * len(ww) THEN 0.2::DOUBLE ELSE 0.05 END ELSE 0.1 END ELSE 0.0 END AS bs FROM q),
    s AS (SELECT *, least(fs + ts + ps + bs, 1.0) AS score FROM t)"""


_REFUSAL = r"""p AS (SELECT o_orderkey, regexp_matches(model_output, '(?s)```json\s*(.*?)\s*```') AS has, regexp_extract(model_output, '(?s)```json\s*(.*?)\s*```', 1) AS block,
        TRY_CAST(nullif(regexp_extract(verdict, '\\boxed\{(\d+(?:\.\d)?)\}', 1), '') AS DOUBLE) AS pts FROM fx),
    q AS (SELECT *, has AND json_valid(block) AND coalesce(json_type(CASE WHEN json_valid(block) THEN block END) = 'OBJECT', false) AS usable FROM p),
    g AS (SELECT *, usable AND contains(block, '"拒识类型"') AND contains(block, '"拒识话术"') AS graded FROM q),
    s AS (SELECT *, CASE WHEN graded THEN 0.4::DOUBLE + coalesce(pts, 0.0) ELSE 0.0::DOUBLE END AS score, NOT usable OR (graded AND pts IS NULL) AS bad FROM g)"""

_LIST = f"""p AS (SELECT o_orderkey, {solution_sql('model_output')} AS got, CASE WHEN json_valid(reference_output) THEN json_extract_string(reference_output, '$.answer') ELSE reference_output END AS want FROM fx),
    q AS (SELECT o_orderkey, got, list_filter(list_transform(string_split(got, ','), lambda x: trim(lower(x))), lambda x: x <> '') AS g,
        list_filter(list_transform(string_split(want, ','), lambda x: trim(lower(x))), lambda x: x <> '') AS w FROM p),
    s AS (SELECT o_orderkey, CASE WHEN got <> '' AND len(g) = len(w) AND len(list_filter(g, lambda x: NOT list_contains(w, x))) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM q)"""

def _doc(source: str) -> str:
    return f"""d AS (SELECT doc_id, lang, doc_id % 50 AS g, t, lower(t) AS l, lower(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS a FROM (SELECT doc_id, lang, {STRIPPED} AS t
    FROM (SELECT doc_id, lang, {REPLY_TEXT} AS text FROM {source})))"""


_DOC, _DOC_ALL = _doc("documents"), _doc(CHECKS.source_sql())
_SUM = "CAST(count(*) AS BIGINT) AS total_count, CAST(count(*) FILTER (bad = 0) AS BIGINT) AS correct_count"

ORACLES = {
    "score_exact_match": f"WITH fx AS ({BOXED.sql()}), {_BOX_PAIR} SELECT conv_id, turn, score, {_bad('score', 'score = 0', 1.0)} AS is_badcase, got AS model_value, want AS reference_value FROM s",
    "score_box": f"WITH fx AS ({BOXED.sql()}), {_BOX_PAIR} SELECT conv_id, turn, score, {_bad('score', 'false', 0.5)} AS is_badcase FROM s",
    "score_equal": f"""WITH fx AS ({TEXT.sql()}), m AS (SELECT conv_id, turn, reference_output AS r, CASE WHEN conv_id % 10 = 9 THEN ' ' ELSE model_output END AS o FROM fx),
        s AS (SELECT conv_id, turn, trim(o, {WS}) = '' AS failed, CASE WHEN trim(CASE WHEN suffix(trim(o, {WS}), '.') THEN left(o, length(o) - 1) ELSE o END, {WS}) = trim(r, {WS}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM m)
        SELECT conv_id, turn, CASE WHEN NOT failed THEN score END AS score, CAST(CASE WHEN failed OR score < 1 THEN 1 ELSE 0 END AS INTEGER) AS is_badcase, failed FROM s""",
    "score_json_check": f"WITH fx AS ({JSON.sql()}), {_JSON} SELECT o_orderkey, round(score, 9) AS score, {_bad('score', 'false', 1.0)} AS is_badcase FROM s",
    "score_list_check": f"WITH fx AS ({LIST.sql()}), {_LIST} SELECT o_orderkey, score, {_bad('score', 'false', 1.0)} AS is_badcase FROM s",
    "score_list_json": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
        CAST(CASE WHEN o_orderkey % 4 IN (0, 3) THEN 0 ELSE 1 END AS INTEGER) AS is_badcase FROM orders""",
    "score_tool_call": f"""WITH fx AS ({TOOL.sql()}), {_tool_sql()} SELECT o_orderkey, round(score, 9) AS score, {_bad('score', 'score < 0.6', 0.5)} AS is_badcase,
        CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS overall_assessment, gtool AS model_tool_used, wtool AS reference_tool_expected FROM s""",
    "score_tool_tags": f"""WITH fx AS ({TOOL.sql()}), {_tool_sql()} SELECT o_orderkey, concat_ws(',',
        CASE WHEN wth THEN CASE WHEN gth THEN 'thought_format_correct' ELSE 'thought_format_missing' END END, CASE WHEN wac THEN CASE WHEN gac THEN 'action_format_correct' ELSE 'action_format_missing' END END,
        CASE WHEN wai THEN CASE WHEN gai THEN 'action_input_format_correct' ELSE 'action_input_format_missing' END END,
        CASE ts WHEN 0.4 THEN 'tool_selection_correct' WHEN 0.1 THEN 'tool_selection_incorrect' ELSE 'tool_selection_missing' END,
        CASE WHEN wpar IS NOT NULL AND gpar IS NULL THEN 'params_missing' WHEN hits = keys THEN 'params_completely_correct' WHEN hits > 0 THEN 'params_partially_correct' ELSE 'params_incorrect' END,
        CASE bs WHEN 0.2 THEN 'task_successfully_completed' WHEN 0.05 THEN 'task_partially_completed' WHEN 0.1 THEN 'finish_called' END) AS tags FROM s""",
    "score_agent": f"WITH fx AS ({AGENT.sql()}), {_AGENT} SELECT conv_id, turn, round(score, 9) AS score, {_bad('score', 'false', 0.5)} AS is_badcase FROM s",
    "score_reference_verdict": f"""WITH fx AS ({BOXED.sql()}), s AS (SELECT conv_id, turn, TRY_CAST(nullif({BOXED_SQL.format('verdict')}, '') AS DOUBLE) AS score FROM fx)
        SELECT conv_id, turn, score, {_bad('score', 'score IS NULL', 1.0)} AS is_badcase FROM s""",
    "score_refusal": f"WITH fx AS ({REFUSAL.sql()}), {_REFUSAL} SELECT o_orderkey, round(score, 9) AS score, {_bad('score', 'bad', 0.5)} AS is_badcase FROM s",
    "score_str_check": f"WITH fx AS ({BOXED.sql()}) SELECT conv_id, turn, CAST(NULL AS DOUBLE) AS score, CAST(1 AS INTEGER) AS is_badcase, 'scorer returned no result' AS error FROM fx",
    "score_rouge_n": f"""WITH fx AS ({TEXT.sql()}), {_TOKENS}, {_overlap(1)}, {_overlap(2)} SELECT tok.conv_id, tok.turn, round({_f('ov1.ov', 'len(b)', 'len(a)')}, 9) AS rouge1,
        round({_f('ov2.ov', 'len(b) - 1', 'len(a) - 1')}, 9) AS rouge2 FROM tok LEFT JOIN ov1 USING (conv_id, turn) LEFT JOIN ov2 USING (conv_id, turn)""",
    "score_rouge_l": f"{_ROUGE} SELECT conv_id, turn, round(rougeL, 9) AS rougeL FROM r",
    "score_rouge": f"{_ROUGE} SELECT conv_id, turn, round(rougeL, 9) AS score, {_bad('rougeL', 'false', 0.5)} AS is_badcase, round(rouge1, 9) AS rouge1, round(rouge2, 9) AS rouge2, round(rougeL, 9) AS rougeL FROM r",
    "apply_threshold": f"""WITH fx AS ({THRESHOLD.sql()}), s AS (SELECT *, CASE WHEN model_output IS NULL THEN 'missing model_output' ELSE raw_error END AS e FROM fx)
        SELECT o_orderkey, CASE WHEN e IS NULL THEN raw_score END AS score, {_bad('raw_score', 'e IS NOT NULL OR raw_bad = 1', 0.5)} AS is_badcase, e AS error FROM s""",
    "run_summary": f"""WITH fx AS ({BOXED.sql()}), {_BOX_PAIR}, z AS (SELECT *, {_bad('score', 'false', 1.0)} AS bad FROM s)
        SELECT run_id, {_SUM}, round(count(*) FILTER (bad = 0) / count(*), 6) AS accuracy, round(avg(score), 6) AS average_score, round(avg(inference_time), 6) AS average_inference_time,
        CAST(count(*) FILTER (bad = 1) AS BIGINT) AS badcase_count FROM z GROUP BY run_id""",
    "run_summary_rouge": f"""{_ROUGE}, z AS (SELECT *, {_bad('rougeL', 'false', 0.5)} AS bad FROM r)
        SELECT run_id, {_SUM}, round(avg(rougeL), 6) AS average_score, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2, round(avg(rougeL), 6) AS rougeL,
        CAST(count(*) FILTER (bad = 1) AS BIGINT) AS badcase_count FROM z GROUP BY run_id""",
    "badcases": f"WITH fx AS ({BOXED.sql()}), {_BOX_PAIR} SELECT conv_id, turn, score, model_output FROM s WHERE score < 1",
    "run_results": f"WITH fx AS ({BOXED.sql()}), {_BOX_PAIR} SELECT conv_id * 1000 + turn AS index, run_id, score, {_bad('score', 'false', 1.0)} AS is_badcase FROM s ORDER BY index",
    "custom_scorer": f"""WITH fx AS ({TEXT.sql()}), s AS (SELECT conv_id, turn, least(length(model_output), length(reference_output)) / greatest(length(model_output), length(reference_output), 1) AS score FROM fx)
        SELECT conv_id, turn, round(score, 9) AS score, {_bad('score', 'false', 0.9)} AS is_badcase FROM s""",
    "custom_python_scorer": f"""WITH fx AS ({TEXT.sql()}), m AS (SELECT *, length(model_output) % 7 AS k,
        len(list_filter(range(1, least(length(model_output), length(reference_output)) + 1), lambda i: substr(model_output, i, 1) = substr(reference_output, i, 1))) AS hits FROM fx),
        v AS (SELECT *, round(hits / greatest(length(model_output), length(reference_output), 1), 9) AS ratio FROM m)
        SELECT conv_id, turn, CASE WHEN k > 1 THEN ratio END AS score, CAST(CASE WHEN k <= 2 OR ratio < 0.5 THEN 1 ELSE 0 END AS INTEGER) AS is_badcase,
        CASE WHEN k > 1 THEN hits END AS same, CASE k WHEN 0 THEN 'unlucky length' WHEN 1 THEN 'scorer returned no result' END AS error FROM v""",
    "attach_verdicts": f"""WITH fx AS ({BOXED.sql()}), q AS (SELECT *, length('Conversation:' || chr(10) || '[user]: ' || text || chr(10) || chr(10) || 'Reference answer:' || chr(10) || reference_output || chr(10) || chr(10) || 'Model answer:' || chr(10) || model_output) % 3 AS k FROM fx)
        SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 2 THEN CAST(k AS DOUBLE) END AS score, CAST(CASE WHEN conv_id % 3 <> 2 AND k >= 1 THEN 0 ELSE 1 END AS INTEGER) AS is_badcase,
        CASE WHEN conv_id % 3 <> 2 THEN 'so ' || chr(92) || 'boxed{{' || k || '}}' END AS verdict FROM q""",
    "ifeval_checks": f"WITH {_DOC_ALL} " + " UNION ALL ".join(
        f"SELECT doc_id, CAST({i} AS BIGINT) AS pos, '{rid}' AS instruction_id, coalesce({rule}, false) AS passed FROM d" for i, (rid, _, rule) in enumerate(RULES)),
    "ifeval_rollup": f"WITH {_DOC_ALL} SELECT doc_id, CAST({len(RULES)} AS INTEGER) AS total, " + " + ".join(f"CAST(coalesce({rule}, false) AS BIGINT)" for _, _, rule in RULES) + " AS passed_count FROM d",
    "score_ifeval": f"WITH {_DOC}, s AS (SELECT doc_id, CASE WHEN doc_id % 20 >= 18 THEN 0.0 WHEN doc_id % 20 = 17 THEN 1.0 WHEN doc_id % {_NO_ARGS} = 2 THEN 0.0 ELSE CASE doc_id % 6 "
        + " ".join("WHEN {} THEN ({}) / 3.0::DOUBLE".format(i, " + ".join(f"CAST(coalesce({r[2]}, false) AS INT)" for r in p)) for i, p in enumerate(PICKS))
        + f" END END AS score FROM d) SELECT doc_id, round(score, 9) AS score, {_bad('score', 'false', 1.0)} AS is_badcase FROM s",
}
ORACLES["run_summary_appended"] = ORACLES["run_summary"]
ORACLES["run_summary_rouge_appended"] = ORACLES["run_summary_rouge"]


def _measured(rule_id: str, sql: str) -> str:
    """The number in a rule's SQL, which compares it last."""
    if rule_id.replace(":", "_") not in ifeval.COUNTING or sql == "false":
        return "CAST(NULL AS DOUBLE)"
    if rule_id == "keywords:letter_frequency":
        return "CASE WHEN length(a) > 0 THEN (length(a) - length(replace(a, 'e', ''))) / length(a) * 100.0 END"
    return sql.rsplit(" ", 2)[0]


def _note(rule_id: str, sql: str) -> str:
    return "CAST(NULL AS VARCHAR)" if sql != "false" else "'not implemented'" if rule_id.startswith("unknown") else "'missing argument'"


ORACLES["ifeval_measured"] = f"WITH {_DOC_ALL} " + " UNION ALL ".join(
    f"SELECT doc_id, CAST({i} AS BIGINT) AS pos, round(CAST({_measured(rid, sql)} AS DOUBLE), 6) AS measured, {_note(rid, sql)} AS note FROM d" for i, (rid, _, sql) in enumerate(RULES))
