import os

from pyspark.sql import functions as F

from evalspark.operators import cases, prefixes


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def conversation(spark, conv, n):
    return spark.range(n).select(
        F.lit(conv).cast("long").alias("conv_id"), (F.col("id") * 3).alias("turn"),
        F.when(F.col("id") % 2 == 1, "Assistant").otherwise("HUMAN").alias("role"), F.sha2(F.concat("id", F.lit(str(conv))), 256).alias("text"),
    )


def test_shared_form_equals_expanded_cases(spark):
    turns = conversation(spark, 1, 7).union(conversation(spark, 5, 1)).union(conversation(spark, 3, 12))
    turns = turns.union(spark.createDataFrame([(9, 0, "assistant", None), (9, 1, None, "x"), (9, 2, "assistant", "")], "conv_id long, turn long, role string, text string")).repartition(3)
    shared, messages = prefixes.shared_form(turns)
    want = cases.cases_from_turns(turns).select("conv_id", "original_index", "expanded_index", "index", "messages", "reference_output").collect()
    whole = prefixes.with_reference(prefixes.with_messages(shared, messages), messages)
    got = whole.select("conv_id", "original_index", "expanded_index", "index", "messages", "reference_output").collect()
    key = lambda r: r["index"]
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) == 11
    for system in (True, False):
        last = {r["index"]: r.messages for r in prefixes.with_last_messages(shared, messages, 2, system=system).collect()}
        assert last == {r["index"]: ([r.messages[0]] if system else []) + r.messages[1:][-2:] for r in want}


def test_a_long_conversation_takes_linear_space(spark, tmp_path):
    sizes = []
    for n in (1_000, 10_000):
        turns = conversation(spark, 1, n)
        shared, messages = prefixes.shared_form(turns)
        shared.write.parquet(str(tmp_path / f"c{n}"))
        messages.write.parquet(str(tmp_path / f"m{n}"))
        sizes.append(size(tmp_path / f"c{n}") + size(tmp_path / f"m{n}"))
    assert sizes[1] < 11 * sizes[0]
    stored, texts = spark.read.parquet(str(tmp_path / "c10000")), spark.read.parquet(str(tmp_path / "m10000"))
    assert stored.count() == 5_000 and texts.count() == 10_001
    one = prefixes.with_messages(stored.where("index = 4999"), texts).first()
    assert len(one.messages) == 10_001
    assert prefixes.with_last_messages(stored, texts, 4).agg(F.sum(F.size("messages"))).first()[0] == 5_000 * 5 - 2
