import json
import random

from pyspark.sql import functions as F

from evalspark.functions import display, extract, jsons, text
from evalspark.functions.staged import Stages


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return [r[0] for r in df.select("i", expr.alias("v")).orderBy("i").select("v").collect()]


def python_valid(t):
    def no_constant(name):
        raise ValueError(name)

    try:
        json.loads(t, parse_constant=no_constant)
        return True
    except ValueError:
        return False


def test_json_valid_matches_python(spark):
    texts = ['{"a":1}', '{"a":1} x', "1", '"s"', "null", "true", "", " ", "[1,2]", "1, 2", "1], [2", "1}, {2", '{"a":1,"a":2}', "{'a':1}",
             "{a:1}", '{"a":01}', "NaN", '{"a":"\n"}', "[1,]", '"a', '{"a":+1}', '{"a":1}\n', "\t[1]", '1, "b":2', '1} x', "1] x", "{}", "[]",
             '{"a":{"b":[1,{"c":null}]}}', "tru", "-", "1e5", "1.", ".5", '"\\u00e9"', '"\\x"', "{}{}", "[[]", '"a" "b"', '1,"b"', '":"']
    rng = random.Random(3)
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', '"', "1", "-2.5", "true", "null", " ", "x"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    texts += [json.dumps({"k": [1, {"z": "é"}], "m": None})[:n] for n in range(35)]
    got = values(spark, texts, jsons.json_valid(F.col("t")))
    wrong = [(t, g) for t, g in zip(texts, got) if g != python_valid(t)]
    assert not wrong, wrong[:10]


def test_canonical_json(spark):
    same = [('{"a":1,"b":[1, 2]}', '{"b":[1,2], "a":1}'), ('{"a":1e2}', '{"a":100.0}'), ('{"x":"a: 1.0, b"}', '{"x" : "a: 1.0, b"}'), ('{"a":1,"a":2}', '{"a":2}')]
    other = [("[1]", "[1.0]"), ("[1,2]", "[2,1]"), ('{"a":"1"}', '{"a":1}'), ('{"a":true}', '{"a":"true"}'), ("[12345678901234567890123]", "[12345678901234567890124]"), ("[1-2]", "[1]")]
    for pairs, equal in ((same, True), (other, False)):
        left = values(spark, [a for a, _ in pairs], jsons.canonical_json(F.col("t")))
        right = values(spark, [b for _, b in pairs], jsons.canonical_json(F.col("t")))
        assert [a == b for a, b in zip(left, right)] == [equal] * len(pairs)


def test_dumped_json(spark):
    assert values(spark, ['{"a":[1,2],"b":"x,y:z"}'], jsons.dumped_json(F.col("t"))) == ['{"a": [1, 2], "b": "x,y:z"}']


def test_extract_json_text(spark):
    cases = {
        'a ```json\n{"x":1}\n``` b': '{"x":1}',
        'a ```\n[1]\n``` b': "[1]",
        "a ```py\nx\n``` b": "a ```py\nx\n``` b",
        "  {broken ": "{broken",
        "plain": "plain",
        "": "",
        "```json\n\n```": "",
        "```json a ``` ```json b ```": "a",
        " [1]\n": "[1]",
    }
    let = Stages()
    expr = jsons.extract_json_text(F.col("t"), let)
    df = let.add_to(spark.createDataFrame(list(enumerate(cases)), "i int, t string"))
    assert [r[0] for r in df.orderBy("i").select(expr).collect()] == list(cases.values())


def test_text_units(spark):
    assert values(spark, ["  a\n\x1f", "a ", "\t"], text.strip(F.col("t"))) == ["a", "a", ""]
    assert values(spark, ["Dr. No went. Why? U.S. law! Yes", "a.b. c. d", ""], F.size(text.sentences(F.col("t")))) == [3, 2, 0]
    assert values(spark, ["l'été_1 你好 é", ""], text.word_count(F.col("t"))) == [4, 0]
    assert values(spark, ["aaaa", "AbAb", "x"], text.count_substr(F.col("t"), F.lit("AA"))) == [2, 0, 0]
    assert values(spark, ["abc"], text.count_substr(F.col("t"), F.lit(""))) == [4]


def test_extraction(spark):
    assert values(spark, [r"\boxed{1.25} \boxed{3}", r"\boxed{2.5}", "x"], extract.boxed_decimal(F.col("t"))) == ["3", "2.5", ""]
    fields = values(spark, ["Value: a\nb \nAnswer: x#1 y\nFinal  Answer: z"], extract.agent_fields(F.col("t")))[0]
    assert (fields["answer"], fields["action"]) == ("x#1", "")
    assert fields["value"] == "a\nb \nAnswer: x#1 y\nFinal  Answer: z"


def test_display(spark):
    numbers = spark.createDataFrame([(0.8,), (0.5,), (0.49,), (None,)], "v double")
    assert [r[0] for r in numbers.select(display.tier(F.col("v"))).collect()] == ["high", "medium", "low", "-"]
    assert [r[0] for r in numbers.select(display.score_text(F.col("v"))).collect()] == ["0.8000", "0.5000", "0.4900", "-"]
    steps = spark.createDataFrame([("generate", 1, 2), ("评分处理", 1, 2), ("report", 0, 0), ("else", 1, 4), ("else", 1, 0)], "p string, c int, n int")
    assert [r[0] for r in steps.select(display.progress_pct(F.col("p"), F.col("c"), F.col("n"))).collect()] == [30.0, 65.0, 80.0, 25.0, 0.0]
    assert values(spark, ["a/b/c", "c"], display.short_name(F.col("t"))) == ["c", "c"]
    assert values(spark, ["a.b.jsonl", "a"], display.export_name(F.col("t"), F.lit("m"))) == ["a.b+m.csv", "a+m.csv"]


def test_stages_order_by_mention(spark):
    let = Stages()
    a = let(F.col("t") + 1)
    b = let(a * 2)
    c = let(F.col("t") - 1)
    df = let.add_to(spark.createDataFrame([(1,)], "t int"))
    assert df.select(a, b, c).first()[:] == (2, 4, 0)
