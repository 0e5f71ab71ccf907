"""Scalar text, JSON and extraction functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import extract, jsons, text
from evalspark.functions.staged import Stages
from evalspark.workload.fixtures import AGENT, BOXED, JSON, LIST, TOOL, Fixture, table

RELATION = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "actual": "o_custkey % 20",
    "target": "CASE o_orderkey % 11 WHEN 10 THEN 'many' WHEN 9 THEN '7.5' ELSE CAST(o_orderkey % 20 AS STRING) END",
    "relation": "CASE o_orderkey % 8 WHEN 0 THEN 'less than' WHEN 1 THEN 'greater than' WHEN 2 THEN 'at least' WHEN 3 THEN 'at most' WHEN 4 THEN 'equal' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'about' END",
})

JSON_LINES = Fixture("events", {
    "event_id": "event_id",
    "line": """CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN concat(props, ' x') WHEN 2 THEN concat('{', props) WHEN 3 THEN '1, 2'
    WHEN 4 THEN concat('[', props, ', ', props, ']') WHEN 5 THEN '' WHEN 6 THEN concat(' ', props, chr(10)) WHEN 7 THEN '{"a": 1, "a": 2}' ELSE '"text"' END""",
})


def boxed_values(spark, sf):
    return BOXED.frame(spark, sf).select(
        "conv_id", "turn",
        extract.boxed_int(F.col("reference_output")).alias("reference_int"),
        extract.boxed_int(F.col("model_output")).alias("output_int"),
        extract.boxed_decimal(F.col("graded")).alias("graded_decimal"),
    )


def json_extract(spark, sf):
    let = Stages()
    want, got = (jsons.extract_json_text(F.col(c), let) for c in ("reference_output", "model_output"))
    return let.add_to(JSON.frame(spark, sf)).select("o_orderkey", want.alias("reference_json"), got.alias("output_json"))


def agent_fields(spark, sf):
    got, want = extract.agent_fields(F.col("model_output")), extract.agent_fields(F.col("reference_output"))
    return AGENT.frame(spark, sf).select(
        "conv_id", "turn",
        *[got[f].alias(f"output_{f}") for f in ("answer", "action", "value")],
        *[want[f].alias(f"reference_{f}") for f in ("answer", "action", "value")],
    )


def tool_parts(spark, sf):
    parts = extract.tool_parts(F.col("model_output"))
    return TOOL.frame(spark, sf).select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.*")


def solution_extract(spark, sf):
    let = Stages()
    answer = extract.solution_answer(jsons.extract_json_text(F.col("model_output"), let), let)
    return let.add_to(LIST.frame(spark, sf)).select("o_orderkey", answer.alias("answer"))


def text_units(spark, sf):
    body = text.strip(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "text").select("doc_id", body.alias("t")).select(
        "doc_id",
        text.word_count(F.col("t")).cast("long").alias("n_words"),
        F.size(text.sentences(F.col("t"))).cast("long").alias("n_sentences"),
        F.size(text.paragraphs(F.col("t"))).cast("long").alias("n_paragraphs"),
        F.size(text.lines(F.col("t"))).cast("long").alias("n_lines"),
        text.first_word(F.col("t")).alias("first_word"),
    )


def relation_compare(spark, sf):
    return RELATION.frame(spark, sf).withColumn(
        "passed", text.relation_cmp(F.col("actual"), F.col("target"), F.col("relation"))
    ).select("o_orderkey", "passed")


def rouge_tokens(spark, sf):
    tokens = text.rouge_tokens(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n_tokens")
    )


def json_valid(spark, sf):
    return JSON_LINES.frame(spark, sf).select("event_id", jsons.json_valid(F.col("line")).alias("valid"))


QUERIES = {f.__name__: f for f in (
    boxed_values, json_extract, agent_fields, tool_parts, solution_extract, text_units, relation_compare, rouge_tokens, json_valid,
)}

BOXED_SQL = r"regexp_extract({0}, '\\boxed\{{(\d+)\}}', 1)"


def extract_json_sql(c: str) -> str:
    return rf"""CASE WHEN regexp_matches({c}, '(?s)```json\s*(.*?)\s*```') THEN trim(regexp_extract({c}, '(?s)```json\s*(.*?)\s*```', 1), ' ' || chr(10))
    WHEN regexp_matches(trim(regexp_extract({c}, '(?s)```\s*(.*?)\s*```', 1), ' ' || chr(10)), '^[{{\[]') THEN trim(regexp_extract({c}, '(?s)```\s*(.*?)\s*```', 1), ' ' || chr(10))
    WHEN regexp_matches(trim({c}, ' ' || chr(10)), '^[{{\[]') THEN trim({c}, ' ' || chr(10)) ELSE {c} END"""


def agent_sql(c: str, field: str) -> str:
    return {
        "answer": rf"regexp_extract({c}, '(?i)(?:Final\s+)?Answer:\s*([\w#]+)', 1)",
        "action": rf"regexp_extract({c}, '(?i)Action:\s*([\w#]+)', 1)",
        "value": rf"trim(regexp_extract({c}, '(?is)Value:\s*(.+)', 1), ' ' || chr(10))",
    }[field]


def solution_sql(c: str) -> str:
    return rf"""CASE WHEN regexp_extract({c}, '(?s)<solution>\s*(.*?)\s*</solution>', 1) <> '' THEN regexp_extract({c}, '(?s)<solution>\s*(.*?)\s*</solution>', 1)
    WHEN json_valid({c}) AND json_extract_string({c}, '$.answer') <> '' THEN json_extract_string({c}, '$.answer') ELSE trim({c}) END"""


WS = "' ' || chr(9) || chr(10) || chr(13)"
WORD = r"[\p{L}\p{N}_]"
STRIPPED = f"trim(text, {WS})"
# RE2 has no look-behind: mark every candidate break, then drop those after abbreviations.
SENTENCES = rf"""CASE WHEN t = '' THEN 0 ELSE 1 + len(list_filter(string_split(regexp_replace(t, '([.?])(\s)', '\1' || chr(30) || '\2', 'g'), chr(30))[:-2],
    lambda p: NOT regexp_matches(p, '{WORD}\.{WORD}[^\n]$') AND NOT regexp_matches(p, '[A-Z][a-z]\.$'))) END"""


def nonblank_parts(sep: str) -> str:
    return f"len(list_filter(string_split(t, {sep}), lambda p: trim(p, {WS}) <> ''))"


ORACLES = {
    "boxed_values": f"""WITH fx AS ({BOXED.sql()}) SELECT conv_id, turn, {BOXED_SQL.format('reference_output')} AS reference_int,
        {BOXED_SQL.format('model_output')} AS output_int, """ + r"regexp_extract(graded, '\\boxed\{(\d+(?:\.\d)?)\}', 1) AS graded_decimal FROM fx",
    "json_extract": f"WITH fx AS ({JSON.sql()}) SELECT o_orderkey, {extract_json_sql('reference_output')} AS reference_json, {extract_json_sql('model_output')} AS output_json FROM fx",
    "agent_fields": f"WITH fx AS ({AGENT.sql()}) SELECT conv_id, turn, "
        + ", ".join(f"{agent_sql(c, f)} AS {p}_{f}" for p, c in (("output", "model_output"), ("reference", "reference_output")) for f in ("answer", "action", "value"))
        + " FROM fx",
    "tool_parts": rf"""WITH fx AS ({TOOL.sql()}) SELECT o_orderkey, regexp_matches(model_output, '(?i)thought:') AS has_thought,
        regexp_matches(model_output, '(?i)action\s*:') AS has_action, regexp_matches(model_output, '(?i)action input\s*:') AS has_action_input,
        regexp_extract(model_output, '(?i)action\s*:\s*(\w+)', 1) AS tool,
        nullif(regexp_extract(model_output, 'Action Input\s*:\s*(\{{[^{{}}]*\}})', 1), '') AS params,
        regexp_matches(model_output, '(?i)action\s*:\s*finish') AS finish,
        nullif(regexp_extract(model_output, '(?i)final_answer\s*:\s*["'']([^"'']*)["'']', 1), '') AS final_answer FROM fx""",
    "solution_extract": f"WITH fx AS ({LIST.sql()}) SELECT o_orderkey, {solution_sql('model_output')} AS answer FROM fx",
    "text_units": rf"""WITH d AS (SELECT doc_id, {STRIPPED} AS t FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(t, '{WORD}+')) AS BIGINT) AS n_words,
        CAST({SENTENCES} AS BIGINT) AS n_sentences, CAST({nonblank_parts("chr(10) || chr(10)")} AS BIGINT) AS n_paragraphs, CAST({nonblank_parts("chr(10)")} AS BIGINT) AS n_lines,
        regexp_extract(t, '{WORD}+') AS first_word FROM d""",
    "relation_compare": f"""WITH fx AS ({RELATION.sql()}) SELECT o_orderkey, coalesce(CASE WHEN relation = 'less than' THEN actual < t WHEN relation = 'greater than' THEN actual > t
        WHEN relation = 'at least' THEN actual >= t WHEN relation = 'at most' THEN actual <= t WHEN coalesce(relation, '') IN ('equal', '') THEN actual = t END, false) AS passed
        FROM (SELECT *, TRY_CAST(target AS DOUBLE) AS t FROM fx)""",
    "rouge_tokens": "SELECT conv_id, turn, array_to_string(k, ' ') AS tokens, CAST(len(k) AS BIGINT) AS n_tokens FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM conversations)",
    "json_valid": f"WITH fx AS ({JSON_LINES.sql()}) SELECT event_id, json_valid(line) AS valid FROM fx",
}
