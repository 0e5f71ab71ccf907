"""Hand-derived expectations per scorer, including every odd branch."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators.scoring import get_scorer, list_scorers, outcome, register_python_scorer, register_scorer, score

COLUMNS = "index long, model_output string, reference_output string, verdict string"


def run(spark, name, rows, threshold=1.0):
    data = [(i, *r, *([None] * (3 - len(r)))) for i, r in enumerate(rows)]
    scored = score(spark.createDataFrame(data, COLUMNS), name, threshold)
    return [(r["score"], r["is_badcase"]) for r in scored.orderBy("index").collect()]


def details(spark, name, output, reference, field, verdict=None):
    df = spark.createDataFrame([(0, output, reference, verdict)], COLUMNS)
    return score(df, name).select(F.col("details")[field]).first()[0]


def fence(body, lang="json"):
    return f"```{lang}\n{body}\n```"


def test_boxed_scorers(spark):
    rows = [(r"so \boxed{7}", r"\boxed{7}"), (r"\boxed{007}", r"\boxed{7}"), ("x", "y"), (r"\boxed{1} \boxed{2}", r"\boxed{1}"), (None, "y")]
    assert run(spark, "exact_match", rows) == [(1.0, 0), (0.0, 1), (0.0, 1), (1.0, 0), (None, 1)]
    # `box` itself never marks a bad case; with threshold 0 only the missing output is bad.
    assert run(spark, "box", rows, 0.0) == [(1.0, 0), (0.0, 0), (0.0, 0), (1.0, 0), (None, 1)]


def test_equal_check(spark):
    rows = [("a.", "a"), (" a. ", "a"), ("a", " a\n"), (".", ""), (" \n", "a"), ("a ", "a")]
    assert run(spark, "equal_check", rows) == [(1.0, 0), (0.0, 1), (1.0, 0), (1.0, 0), (None, 1), (1.0, 0)]


def test_json_check(spark):
    rows = [
        ('{"a":1,"b":"True","c":null}', '{"a":"1","b":true,"c":"none"}'),  # compared as lower-case text
        (fence('{"a":1}'), '{"a":1.0}'),  # 1 and 1.0 print differently
        ("{broken", "{}"),
        ("{}", "{}"),  # nothing to divide by
        ("[1]", '{"a":1}'),
        ("t " + fence('{"a":{"x":1}}', "") + " t", '{"a":{"x": 1},"b":2}'),
        ('{"a":1} trailing', '{"a":1}'),
        ('{"a":2,"a":1}', '{"a":1}'),  # last duplicate counts
    ]
    expected = [(1.0, 0), (0.0, 1), (0.0, 1), (0.0, 1), (0.0, 1), (0.5, 1), (0.0, 1), (1.0, 0)]
    assert run(spark, "json_check", rows, 0.0) == expected


@pytest.mark.parametrize(("output", "reference", "ok"), [
    ("<solution> c, B, a </solution>", "a,b,c", True),
    ('{"answer":"a,b"}', '{"answer":"A, b"}', True),
    ("a,a,a", "a,b,c", True),  # repeats pass: every item occurs in the reference
    ("a,b", "a,b,c", False),
    ("[1, 2]", "[1,2]", True),
    ("[2, 1]", "[1,2]", False),
    ("[1.0]", "[1]", False),
    ('{"b":1,"a":[1, 2]}', '{"a":[1,2],"b":1}', True),
    ("x", "5", False),  # bare number
    ("null", "null", False),
    ("", "a", False),
    ("[答案] a,b [/答案]", "b,a", True),
    ("[答案] a,b", "b,a", True),
    ('{"answer":["a"]}', '["a"]', False),  # answer is not text
    ('{"answer":0}', '{"answer":0}', False),  # falsy answer falls back to the whole text
    ("true", '{"answer":true}', True),
    ('"a"', '{"answer":"a"}', True),
    ('["a", "b"', '["a","b"]', True),  # not JSON on one side: compared as comma list of the printed JSON
    (fence('{"answer": "x"}'), fence('{"answer": "X"}'), True),
    ('{"answer":null}', '{"answer":null}', True),
])
def test_list_check(spark, output, reference, ok):
    got = run(spark, "list_check", [(output, reference)])
    if (output, reference) == ('["a", "b"', '["a","b"]'):
        ok = False  # the items are '["a"' and '"b"' against '["a"' and '"b"]'
    assert got == [(1.0, 0) if ok else (0.0, 1)]


CALL = "Thought: t\nAction: tool_1\nAction Input: {%s}"


def test_tool_call_scores(spark):
    rows = [
        (CALL % '"k": 1, "s": "O"', CALL % '"k": 1.0, "s": "O"'),  # numbers compare by value
        (CALL % '"k": true', CALL % '"k": 1'),
        (CALL % '"k": "1"', CALL % '"k": 1'),  # text is not a number
        (CALL % '"k": [true, [false, "true"]]', CALL % '"k": [1, [0, "true"]]'),
        (CALL % '"k": ["true"]', CALL % '"k": [1]'),
        ('Action: x\nAction Input: {"k": 1}', 'Action: y\nAction Input: {"k": 1, "z": 2}'),
        ("Action Input: {bad}", 'Action Input: {"a":1}'),
        ('Action: Finish final_answer: "alpha beta"', "action: finish final_answer: 'alpha beta gamma'"),
        ('Action: Finish final_answer: "delta"', "Action: Finish final_answer: 'alpha beta gamma'"),
        ("Action: Finish", "Action: Finish"),
        ("a", "b"),
        ("Action: f action input: {}", "Action: f action input: {}"),  # parameters are case-sensitive
    ]
    got = [round(s, 9) for s, _ in run(spark, "toolbench_evaluation", rows, 0.0)]
    assert got == [1.0, 1.0, 0.7, 1.0, 0.7, 0.55, 0.3, 0.6, 0.75, 0.8, 0.0, 0.7]


def test_tool_call_tags(spark):
    tags = details(spark, "toolbench_evaluation", CALL % '"k": 2', CALL % '"k": 1', "assessment_parts")
    assert tags == ["thought_format_correct", "action_format_correct", "action_input_format_correct", "tool_selection_correct", "params_incorrect"]
    assert details(spark, "toolbench_evaluation", "Action: a", CALL % '"k": 1', "assessment_parts") == [
        "thought_format_missing", "action_format_correct", "action_input_format_missing", "tool_selection_incorrect", "params_missing"]
    assert details(spark, "toolbench_evaluation", CALL % "bad", CALL % '"k": 1', "assessment_parts")[-1] == "params_format_error"
    assert details(spark, "toolbench_evaluation", "a", "b", "overall_assessment") == "poor"


def test_agent(spark):
    rows = [
        ("free", "other"),  # both fields missing on both sides counts as equal
        ("Final Answer: a\nAction: x#1\nValue: q V ", "answer: a\nACTION: x#1\nvalue: v"),
        ("answer: a\naction: q\nvalue: has v", "answer: a\naction: z\nvalue: V"),
        ("answer: a\naction: q", "answer: a\naction: z"),
        ("answer: b\naction: q\nvalue: v", "answer: a\naction: z\nvalue: v"),
    ]
    assert run(spark, "agent_instruct_score", rows, 0.0) == [(1.0, 0), (1.0, 0), (0.7, 0), (0.5, 0), (0.0, 1)]


def test_verdict_scorers(spark):
    assert run(spark, "verdict_with_answer", [("a", "b", r"ok \boxed{2}"), ("a", "b", "none"), ("a", "b"), ("a", "b", r"\boxed{0}")]) == [
        (2.0, 0), (None, 1), (None, 1), (0.0, 1)]
    block = fence('{"拒识类型":"a","拒识话术":"b"}')
    rows = [
        (block, "x", r"\boxed{0.4}"), (block, "x", "none"), (block, "x", r"\boxed{0.25}"), (fence('{"a":1}'), "x"), ("none", "x"),
        (fence("{bad"), "x"), (fence("5"), "x"), (fence('["拒识类型","拒识话术"]'), "x", r"\boxed{0.6}"), (fence("[1]"), "x"),
    ]
    assert run(spark, "reject", rows, 0.0) == [
        (0.8, 0), (0.4, 1), (0.4, 1), (0.0, 0), (0.0, 1), (0.0, 1), (0.0, 1), (1.0, 0), (0.0, 0)]


def test_str_check_is_always_an_error(spark):
    assert run(spark, "str_check", [("a,b", "a,b")], 0.0) == [(None, 1)]


def test_rouge(spark):
    rows = [
        ("the cat sat on the mat", "the cat on the mat sat"), ("a b c", "a b c"), ("", "x"), ("你好", "你好"),
        (None, "x"), ("the the the", "the cat"), ("one", "one"),
    ]
    df = spark.createDataFrame([(i, o, r) for i, (o, r) in enumerate(rows)], "index long, model_output string, reference_output string")
    got = score(df, "rouge", 0.5).orderBy("index").select("score", "is_badcase", "details.*", "error").collect()
    assert [r["is_badcase"] for r in got] == [0, 0, 1, 1, 1, 1, 0]
    assert got[4]["score"] is None and got[4]["error"]
    shown = [tuple(round(r[k], 6) for k in ("rouge1", "rouge2", "rougeL")) for r in got if r["error"] is None]
    assert shown == [(1.0, 0.6, 0.833333), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.4, 0.0, 0.4), (1.0, 0.0, 1.0)]


def test_lcs_against_table():
    import random

    from evalspark.operators.scorers.rouge import _lcs

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert _lcs(a, b) == table(a, b)


def test_threshold_and_generation_errors(spark):
    df = spark.createDataFrame([(0, "x", "x", None), (1, None, "x", "timeout")], "index long, model_output string, reference_output string, error string")
    got = score(df, "equal_check").orderBy("index").collect()
    assert [(r["score"], r["is_badcase"], r["error"]) for r in got] == [(1.0, 0, None), (None, 1, "timeout")]


def test_registry(spark):
    assert list_scorers(spark).count() >= 12
    with pytest.raises(ValueError):
        get_scorer("nope")

    @register_scorer("test_constant", "always half")
    def constant(case):
        return outcome(F.lit(0.5), F.lit(0), F.lit(None).cast("string"))

    assert run(spark, "test_constant", [("a", "b")], 0.4) == [(0.5, 0)]


def test_python_scorers_fail_row_by_row(spark):
    def grade(messages, output, reference):
        if output == "boom":
            raise ValueError("no good")
        if output == "silent":
            return None
        return {"score": float(output == reference), "is_badcase": int(len(messages) > 1), "details": {"n": len(messages)}}

    register_python_scorer("test_python", grade)
    turn = [("user", "q")]
    rows = [(0, "a", "a", turn, None), (1, "a", "b", turn, None), (2, "boom", "b", turn, None), (3, "silent", "b", turn, None), (4, None, "b", turn, None),
            (5, "boom", "b", turn, "timeout"), (6, "a", "a", turn * 2, None), (7, "a", "a", None, None)]
    df = spark.createDataFrame(rows, "index long, model_output string, reference_output string, user_input array<struct<role:string,content:string>>, error string")
    got = score(df, "test_python").orderBy("index").select("score", "is_badcase", "details", "error").collect()
    assert [tuple(r) for r in got] == [
        (1.0, 0, '{"n": 1}', None), (0.0, 1, '{"n": 1}', None), (None, 1, None, "no good"), (None, 1, None, "scorer returned no result"),
        (None, 1, None, "missing model_output"), (None, 1, None, "timeout"), (1.0, 1, '{"n": 2}', None), (1.0, 0, '{"n": 0}', None)]


def test_rouge_needs_no_keys(spark):
    # Two runs share an index, one index is missing, and a column has the name of a stage.
    rows = [(0, "r", "a b c", "a b c", 7), (0, "s", "x y", "a b c", 8), (None, "t", "same text", "same text", 9), (3, "u", " ".join(map(str, range(20000))), "7 8 9", 1)]
    df = spark.createDataFrame(rows, "index long, run_id string, model_output string, reference_output string, _let0 long")
    scored = score(df, "rouge", 0.5)
    got = {r["run_id"]: (r["details"]["rouge1"], r["details"]["rouge2"], r["_let0"]) for r in scored.collect()}
    assert (got["r"], got["s"], got["t"]) == ((1.0, 1.0, 7), (0.0, 0.0, 8), (1.0, 1.0, 9))
    assert round(got["u"][0], 9) == round(2 * (3 / 20000) / (3 / 20000 + 1), 9)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
