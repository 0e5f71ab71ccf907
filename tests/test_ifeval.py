"""One passing and one failing text per instruction check."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators.scorers.ifeval import ifeval_checks, ifeval_rollup
from evalspark.operators.scoring import score

X = {"x": 1}
CHECKS = [
    ("detectable_format:title", X, " My title ", "two\nlines"),
    ("detectable_format:title", X, "a" * 150, "a" * 151),
    ("keywords:existence", {"keywords": ["Cat", "dog"]}, "cats and DOGS", "cats"),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say  it\nonce"}, "ok: say it   ONCE more", "say it"),
    ("combination:repeat_prompt", {"prompt_to_repeat": "a"}, "a", ""),
    ("keywords:letter_frequency", {"letter": "A", "let_frequency": 50, "let_relation": "at least"}, "ab, ab", "abb"),
    ("keywords:letter_frequency", {"letter": "a", "let_frequency": 0, "let_relation": "at least"}, "b", "123"),
    ("keywords:frequency", {"keyword": "aa", "frequency": 2, "relation": "equal"}, "aaaa", "aa"),
    ("keywords:frequency", {"keyword": "b", "frequency": "1", "relation": None}, "B", "bb"),
    ("keywords:forbidden_words", {"forbidden_words": ["bad"]}, "good", "BADly"),
    ("length_constraints:number_words", {"num_words": 2, "relation": "less than"}, "one", "one two"),
    ("length_constraints:number_words", {"num_words": 3, "relation": "at most"}, "l'été 你好", "a b c d"),
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two? ", "One! Two!"),
    ("length_constraints:number_sentences", {"num_sentences": 1, "relation": "equal"}, "Mr. Smith of the U.S. army.", "One. Two."),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2, "relation": "equal"}, "a\n\n\n\nb", "a\nb"),
    ("length_constraints:nth_paragraph_first_word", {"nth_paragraph": 2, "first_word": " Hello"}, "x\n\n*hello* y", "hello\n\nx"),
    ("length_constraints:nth_paragraph_first_word", {"nth_paragraph": 1, "first_word": "a"}, "a", "..."),
    ("detectable_format:number_bullet_lists", {"num_bullets": 3, "relation": "equal"}, "- a\n * b\n2. c\n-d", "- a"),
    ("detectable_format:constrained_response", X, "a", " \n"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2, "relation": "at least"}, "*a* and **b**", "*a*"),
    ("detectable_format:multiple_sections", {"num_sections": 2, "relation": "equal"}, "# A\ntext\n ## B", "#A\n# B"),
    ("detectable_format:json_format", X, 'x {"a": {"b": 1}} y', 'x {"a": } y'),
    ("detectable_format:json_format", X, "{}", "none"),
    ("detectable_content:number_placeholders", {"num_placeholders": 2, "relation": "equal"}, "[a] <b>", "[a\n] <b>"),
    ("detectable_content:postscript", X, "p.S. hi", "ps hi"),
    ("start_end_constraints:forbidden_start_words", {"forbidden_words": ["The"]}, "A the", "the A"),
    ("start_end_constraints:keywords", {"keyword": "Hi", "position": "start"}, " hi there", "there hi"),
    ("start_end_constraints:keywords", {"keyword": "Hi", "position": "end"}, "there hi ", "hi there"),
    ("startend:end_checker", {"end_phrase": " The End "}, "this is the end\n", "the end."),
    ("startend:quotation", X, ' "a" ', '"'),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "relation": "equal"}, "AB ÉÀ a1 A1 Ab", "AB"),
    ("change_case:english_lowercase", X, "abc 1!", "aBc"),
    ("change_case:english_capital", X, "ABC 1!", "AbC"),
    ("punctuation:no_comma", X, "a; b", "a, b"),
    ("combination:two_responses", X, "Response 1: a\nresponse 2: b", "response 1: a"),
]


def spec(*pairs):
    return json.dumps({"instruction_id_list": [p[0] for p in pairs], "kwargs": [p[1] for p in pairs]}, ensure_ascii=False)


def test_every_check(spark):
    rows = []
    for i, (name, kwargs, good, bad) in enumerate(CHECKS):
        rows += [(2 * i, good, spec((name, kwargs))), (2 * i + 1, bad, spec((name, kwargs)))]
    df = spark.createDataFrame(rows, "index long, model_output string, reference_output string")
    long = {r["index"]: r["passed"] for r in ifeval_checks(df).collect()}
    scored = {r["index"]: r["score"] for r in score(df, "ifeval_full_scorer").collect()}
    for i, (name, *_) in enumerate(CHECKS):
        assert (long[2 * i], long[2 * i + 1]) == (True, False), (i, name)
        assert (scored[2 * i], scored[2 * i + 1]) == (1.0, 0.0), (i, name)


def test_language_needs_a_detected_column(spark):
    rows = [(0, "bonjour à tous", spec(("language:response_language", {"language": "FR-ca"})), "fr"),
            (1, "bonj", spec(("language:response_language", {"language": "fr"})), "fr"),
            (2, "你好你好你好", spec(("language:response_language", {"language": "zh-cn"})), "zh-cn")]
    df = spark.createDataFrame(rows, "index long, model_output string, reference_output string, detected_lang string")
    assert [r["score"] for r in score(df, "ifeval_full_scorer").orderBy("index").collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize(("reference", "expected"), [
    ("not json", (0.0, 1)),
    ("[1]", (0.0, 1)),
    ("{}", (1.0, 0)),
    ('{"instruction_id_list": []}', (1.0, 0)),
    ('{"instruction_id_list": ["a"], "kwargs": []}', (0.0, 1)),
    ('{"instruction_id_list": ["a"]}', (0.0, 1)),
    ('{"instruction_id_list": ["a"], "kwargs": null}', (None, 1)),
    ('{"instruction_id_list": null}', (1.0, 0)),
    (spec(("punctuation:no_comma", {}), ("punctuation:no_comma", X)), (0.5, 1)),  # no arguments: skipped but counted
    (spec(("punctuation:no_comma", None)), (0.0, 1)),
    (spec(("unknown:rule", X), ("keywords:frequency", {"keyword": "a"})), (0.0, 1)),  # unknown id, missing arguments
    (spec(("keywords:frequency", {"keyword": "a", "frequency": "many", "relation": "at least"})), (0.0, 1)),
])
def test_case_level(spark, reference, expected):
    df = spark.createDataFrame([(0, "aaa", reference)], "index long, model_output string, reference_output string")
    row = score(df, "ifeval_full_scorer").first()
    assert (row["score"], row["is_badcase"]) == expected


def test_rollup_equals_score(spark):
    rows = [(i, "One. two, three", spec(("punctuation:no_comma", X), ("length_constraints:number_words", {"num_words": i, "relation": "at least"}))) for i in range(6)]
    df = spark.createDataFrame(rows, "index long, model_output string, reference_output string")
    rolled = ifeval_rollup(ifeval_checks(df), df.selectExpr("index", "2 AS total"))
    got = {r["index"]: r["passed_count"] / r["total"] for r in rolled.collect()}
    assert got == {r["index"]: r["score"] for r in score(df, "ifeval_full_scorer").collect()}


def test_letter_shares_and_blanks_at_the_edges(spark):
    import re

    from pyspark.sql import functions as F

    from evalspark.functions import text as T
    from evalspark.operators.scorers.ifeval import ifeval_checks

    texts = ["aAbB", "KKak", "İi i", "ab ab", "", "é", "a b\n\nc \t d　 e  ", "Dr. Who. Is e.g. it? Yes! no. end", "AB CÄ aB Äb K"]
    args = [("a", 50), ("k", 50), ("i", 100), ("ab", 50), ("#", 0), ("A", 25)]
    rows = [(k, t, '{"instruction_id_list": ["keywords:letter_frequency"], "kwargs": [{"letter": "%s", "let_frequency": %d, "let_relation": "at least"}]}' % (a, n)) for k, (t, a, n) in enumerate((t, a, n) for t in texts for a, n in args)]
    got = {r["index"]: r.passed for r in ifeval_checks(spark.createDataFrame(rows, "index long, model_output string, reference_output string")).collect()}
    for k, (t, a, n) in enumerate((t, a, n) for t in texts for a, n in args):
        letters = re.sub("[^a-zA-Z]", "", t.strip())
        want = bool(letters) and 100 * letters.lower().count(a.lower()) / len(letters) >= n
        assert got[k] == want, (t, a, n)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.collapse_ws(F.col("t")).alias("c"), T.sentences(F.col("t")).alias("s")).collect():
        assert r.c == re.sub(r"\s+", " ", r.t.strip())
        assert r.s == [x.strip() for x in re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s", r.t) if x.strip()]


def test_breakdown_says_what_was_measured(spark):
    import json

    from evalspark.operators.scoring import score

    spec = {
        "instruction_id_list": ["length_constraints:number_words", "keywords:letter_frequency", "punctuation:no_comma", "no:such", "keywords:frequency", "keywords:letter_frequency"],
        "kwargs": [{"num_words": 3, "relation": "at least"}, {"letter": "a", "let_frequency": 90, "let_relation": "at least"}, {"x": 1}, {"x": 1}, {"keyword": "a"}, {"letter": "a", "let_frequency": "much", "let_relation": ""}],
    }
    df = spark.createDataFrame([(1, "Aa bb, a", json.dumps(spec))], "index long, model_output string, reference_output string")
    row = score(df, "ifeval_full_scorer").first()
    got = [(r.passed, r.measured, r.note) for r in row.details.instruction_breakdown]
    assert got == [(True, 3.0, None), (False, 60.0, None), (False, None, None), (False, None, "not implemented"), (False, None, "missing argument"), (False, 60.0, None)]
    assert (row.score, row.is_badcase) == (1 / 6, 1)


def test_whitespace_class_is_the_whitespace(spark):
    from evalspark.functions.text import LOOSE, S, WHITESPACE, collapse_ws

    every = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    row = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", S, "").alias("other"), F.regexp_replace("t", f"[^{S}]", "").alias("white"), F.regexp_replace("t", LOOSE, " ").alias("loose")).first()
    assert row.white == "".join(sorted(WHITESPACE)) and row.other == "".join(c for c in every if c not in WHITESPACE)
    assert len(row.loose) == len(every) - 4 - 4 - 10 - 1  # runs of 5, 5, 11 and 2 become one blank each
    assert spark.range(1).select(collapse_ws(F.lit("a \u3000 b\t c  d e"))).first()[0] == "a b c d e"


def test_one_choice_of_a_rule_says_what_is_missing(spark):
    """A row names each rule once: the verdict and whether its arguments are there come together."""
    from evalspark.operators.scorers.ifeval import check

    text = F.lit("a b").alias("t")
    found = check(F.col("id"), F.col("kwarg"), text, text, text)
    rows = spark.createDataFrame([("punctuation:no_comma", {"x": "1"}), ("keywords:frequency", {"keyword": "a"}), ("no:rule", {"x": "1"}), ("startend:end_checker", {"end_phrase": " B "})], "id string, kwarg map<string,string>")
    assert [tuple(r.f) for r in rows.select(found.alias("f")).collect()] == [(True, None, None), (False, None, "missing argument"), (False, None, "not implemented"), (True, None, None)]
    assert str(found).count("punctuation_no_comma") == 1
