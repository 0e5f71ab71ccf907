"""Case expansion and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.display import render_messages
from evalspark.operators import cases as ops
from evalspark.operators import prefixes
from evalspark.operators.scorers.judged import AGREEMENT_RUBRIC, judge_requests
from evalspark.plans.durable import fresh_path
from evalspark.sources.turns import group_turns, samples_from_turns as build_samples
from evalspark.workload.fixtures import TEXT, Fixture, table

ENDPOINTS = ["http://a/v1", "http://b/v1", "http://c/v1"]
CONTEXT = 3  # messages before and with the reference
SAMPLE_LIMIT = 37  # below the number of conversations in every table

ROLES = Fixture("conversations", {
    "conv_id": "conv_id", "turn": "turn",
    "raw_role": "CASE (conv_id + turn) % 6 WHEN 0 THEN 'Human' WHEN 1 THEN 'HUMAN' WHEN 2 THEN 'human' WHEN 3 THEN 'Assistant' WHEN 4 THEN 'ASSISTANT' ELSE role END",
})


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _transcript():
    return F.array_join(F.transform("turns", lambda t: F.concat(F.lit("["), t["role"], F.lit("]: "), t["text"])), "\n\n")


def samples_from_turns(spark, sf):
    return build_samples(_turns(spark, sf)).select(
        "conv_id", "original_index", F.size("turns").cast("long").alias("n_turns"), _transcript().alias("transcript")
    )


def expand_cases(spark, sf):
    expanded = ops.split_reference(ops.cases_from_turns(_turns(spark, sf)))
    return expanded.select(
        "conv_id", "original_index", "expanded_index", "index",
        F.size("messages").cast("long").alias("n_messages"),
        render_messages(F.col("user_input")).alias("prompt"), "reference_output",
    )


def role_normalize(spark, sf):
    return ROLES.frame(spark, sf).withColumn("role", ops.normalize_role(F.col("raw_role")))


def prompt_reference(spark, sf):
    cases = ops.split_reference(ops.expand_cases(group_turns(_turns(spark, sf))))
    return cases.select(
        "conv_id", "expanded_index", F.size("user_input").cast("long").alias("n_prompt"),
        F.element_at("user_input", -1)["content"].alias("last_prompt"), "reference_output",
    )


def case_index(spark, sf):
    return ops.turn_case_index(_turns(spark, sf))


def sample_cap(spark, sf):
    kept = ops.limit_samples(build_samples(_turns(spark, sf)), SAMPLE_LIMIT)
    return kept.select("original_index", "conv_id", F.size("turns").cast("long").alias("n_turns"))


def smoke_cap(spark, sf):
    return ops.smoke_cap(ops.turn_case_index(_turns(spark, sf)), test_mode=True, cap=16).select("index", "conv_id", "turn", "test_mode")


def endpoint_assign(spark, sf):
    return ops.assign_endpoint(ops.turn_case_index(_turns(spark, sf)), ENDPOINTS).select("index", "endpoint")


def history_window(spark, sf):
    return ops.history(_turns(spark, sf)).select(
        "conv_id", "turn", F.size("messages").cast("long").alias("n_messages"), render_messages(F.col("messages")).alias("transcript")
    )


def _shared(spark, sf):
    """The shared form, written and read again."""
    path = fresh_path(spark, "shared")
    for name, frame in zip(("cases", "messages"), prefixes.shared_form(_turns(spark, sf))):
        frame.write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/cases"), spark.read.parquet(f"{path}/messages")


def cases_shared(spark, sf):
    cases, messages = _shared(spark, sf)
    return prefixes.with_reference(cases, messages).select(
        "conv_id", "original_index", "expanded_index", "index", (F.col("upto") + 1).alias("n_messages"), "reference_output"
    )


def cases_last_messages(spark, sf):
    cases, messages = _shared(spark, sf)
    found = prefixes.with_last_messages(cases, messages, CONTEXT)
    return found.select("index", F.size("messages").cast("long").alias("n_messages"), render_messages(F.col("messages")).alias("transcript"))


def cases_with_prefix(spark, sf):
    cases, messages = _shared(spark, sf)
    found = ops.split_reference(prefixes.with_messages(cases, messages))
    return found.select("conv_id", "index", render_messages(F.col("user_input")).alias("prompt"), "reference_output")


def render_transcript(spark, sf):
    from evalspark.functions.display import first_user_message

    grouped = group_turns(_turns(spark, sf)).withColumn("messages", ops.message_array())
    return grouped.select(
        "conv_id", render_messages(F.col("messages")).alias("transcript"),
        first_user_message(F.col("messages")).alias("first_user"),
    )


def judge_request_rows(spark, sf):
    cases = ops.split_reference(ops.expand_cases(group_turns(_turns(spark, sf))))
    asked = judge_requests(cases.withColumn("model_output", F.concat(F.lit("model: "), F.col("reference_output"))))
    return asked.select(
        "conv_id", "expanded_index",
        F.element_at("judge_messages", 1)["content"].alias("system_text"),
        F.element_at("judge_messages", 2)["content"].alias("user_text"),
    )


def _shout(messages: list[dict]) -> str:
    if len(messages) % 5 == 0:
        raise ValueError("refused")
    return f"{len(messages)}:{messages[-1]['content']}"


def generate_checkpointed(spark, sf):
    """Answers committed task by task; the second call finds nothing left to ask."""
    from evalspark.operators.generate import generate_resumable

    cases = ops.expand_cases(group_turns(_turns(spark, sf)))
    path = fresh_path(spark, "answers")
    for _ in range(2):
        rows = generate_resumable(cases, _shout, path, ["conv_id", "expanded_index"], interval=200, retries=2, backoff=0.0)
    return rows.select("conv_id", "expanded_index", "model_output", "error")


def generate_outputs(spark, sf):
    from evalspark.operators.generate import generate

    cases = ops.expand_cases(group_turns(_turns(spark, sf)))
    return generate(cases, _shout, keys=["conv_id", "expanded_index"], retries=2, backoff=0.0).select(
        "conv_id", "expanded_index", "model_output", "error"
    )


def attach_outputs(spark, sf):
    from evalspark.operators.joins import attach_outputs as attach

    outputs = TEXT.frame(spark, sf).where("turn < 5").selectExpr(
        "conv_id", "turn", "CASE WHEN conv_id % 6 = 5 THEN NULL ELSE model_output END AS model_output", "inference_time",
        "CASE WHEN conv_id % 6 = 5 THEN 'timeout' END AS error",
    )
    cases = _turns(spark, sf).where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reference_output"))
    return attach(cases, outputs, ["conv_id", "turn"])


QUERIES = {
    **{f.__name__: f for f in (
        samples_from_turns, expand_cases, role_normalize, prompt_reference, case_index, sample_cap, smoke_cap, endpoint_assign,
        history_window, render_transcript, generate_outputs, generate_checkpointed, cases_shared, cases_last_messages, cases_with_prefix, attach_outputs,
    )},
    "judge_requests": judge_request_rows,
}

_SAMPLES = """samples AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS original_index, CAST(count(*) AS BIGINT) AS n_turns,
    string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id)"""
# Roles of the table are already user/assistant/system, so messages equal turns after a blank system message.
_CASES = """cases AS (SELECT c.conv_id, c.turn, c.text AS reference_output,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS expanded_index, row_number() OVER (ORDER BY c.conv_id, c.turn) - 1 AS index,
    1 + (SELECT count(*) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn) AS n_prompt,
    '[system]: ' || coalesce((SELECT string_agg(chr(10) || chr(10) || '[' || p.role || ']: ' || p.text, '' ORDER BY p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn), '') AS prompt,
    coalesce((SELECT max_by(p.text, p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn), '') AS last_prompt
    FROM conversations c WHERE c.role = 'assistant')"""
_INDEX = """numbered AS (SELECT conv_id, turn, dense - 1 AS original_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expanded_index,
    row_number() OVER (ORDER BY conv_id, turn) - 1 AS index FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS dense FROM conversations) WHERE role = 'assistant')"""

ORACLES = {
    "samples_from_turns": f"WITH {_SAMPLES} SELECT conv_id, original_index, n_turns, transcript FROM samples",
    "expand_cases": f"""WITH {_SAMPLES}, {_CASES} SELECT conv_id, original_index, expanded_index, index, CAST(n_prompt + 1 AS BIGINT) AS n_messages, prompt, reference_output
        FROM cases JOIN samples USING (conv_id)""",
    "cases_shared": f"""WITH {_SAMPLES}, {_CASES} SELECT conv_id, original_index, expanded_index, index, CAST(n_prompt + 1 AS BIGINT) AS n_messages, reference_output
        FROM cases JOIN samples USING (conv_id)""",
    "cases_last_messages": f"""WITH {_CASES}, p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at FROM conversations)
        SELECT c.index, 1 + count(*) AS n_messages, '[system]: ' || string_agg(chr(10) || chr(10) || '[' || m.role || ']: ' || m.text, '' ORDER BY m.at) AS transcript
        FROM cases c JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn JOIN p m ON m.conv_id = c.conv_id AND m.at BETWEEN p.at - {CONTEXT - 1} AND p.at GROUP BY c.index""",
    "cases_with_prefix": f"WITH {_CASES} SELECT conv_id, index, prompt, reference_output FROM cases",
    "role_normalize": f"WITH fx AS ({ROLES.sql()}) SELECT conv_id, turn, raw_role, CASE WHEN lower(raw_role) = 'human' THEN 'user' WHEN lower(raw_role) = 'assistant' THEN 'assistant' ELSE raw_role END AS role FROM fx",
    "prompt_reference": f"WITH {_CASES} SELECT conv_id, expanded_index, CAST(n_prompt AS BIGINT) AS n_prompt, last_prompt, reference_output FROM cases",
    "case_index": f"WITH {_INDEX} SELECT conv_id, turn, original_index, expanded_index, index FROM numbered",
    "sample_cap": f"WITH {_SAMPLES} SELECT original_index, conv_id, n_turns FROM samples WHERE original_index < {SAMPLE_LIMIT}",
    "smoke_cap": f"WITH {_INDEX} SELECT index, conv_id, turn, false AS test_mode FROM numbered ORDER BY index LIMIT 16",
    "endpoint_assign": f"WITH {_INDEX} SELECT index, ['http://a/v1', 'http://b/v1', 'http://c/v1'][CAST(index % 3 AS INT) + 1] AS endpoint FROM numbered",
    "history_window": """SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n_messages,
        string_agg('[' || role || ']: ' || text, chr(10) || chr(10)) OVER w AS transcript FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "render_transcript": """SELECT conv_id, '[system]: ' || string_agg(chr(10) || chr(10) || '[' || role || ']: ' || text, '' ORDER BY turn) AS transcript,
        min_by(text, turn) FILTER (role = 'user') AS first_user FROM conversations GROUP BY conv_id""",
    "generate_outputs": f"""WITH {_CASES} SELECT conv_id, expanded_index, CASE WHEN n_prompt % 5 <> 0 THEN CAST(n_prompt AS VARCHAR) || ':' || last_prompt END AS model_output,
        CASE WHEN n_prompt % 5 = 0 THEN 'refused' END AS error FROM cases""",
    "attach_outputs": f"""WITH fx AS ({TEXT.sql()}), o AS (SELECT conv_id, turn, CASE WHEN conv_id % 6 = 5 THEN NULL ELSE model_output END AS model_output, inference_time,
        CASE WHEN conv_id % 6 = 5 THEN 'timeout' END AS error FROM fx WHERE turn < 5)
        SELECT c.conv_id, c.turn, c.text AS reference_output, o.model_output, CASE WHEN o.model_output IS NOT NULL THEN o.inference_time END AS inference_time,
        CASE WHEN o.model_output IS NULL THEN coalesce(o.error, 'no model output') END AS error
        FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id AND o.turn = c.turn WHERE c.role = 'assistant'""",
    "judge_requests": f"""WITH {_CASES} SELECT conv_id, expanded_index, '{AGREEMENT_RUBRIC}' AS system_text,
        'Conversation:' || chr(10) || prompt || chr(10) || chr(10) || 'Reference answer:' || chr(10) || reference_output || chr(10) || chr(10) || 'Model answer:' || chr(10) || 'model: ' || reference_output AS user_text FROM cases""",
}
ORACLES["generate_checkpointed"] = ORACLES["generate_outputs"]
