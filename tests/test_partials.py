import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators.partials import RunningSummary, summary_of
from evalspark.operators.summary import run_summary

SCHEMA = "run_id long, index long, score double, is_badcase int, inference_time double, details struct<rouge1:double,rouge2:double,rougeL:double>, part int"


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for k in range(900):
        score = rng.choice([None, 0.0, 0.25, 1.0])
        carried = (score, 0.5, None) if score and k % 2 else None
        out.append((rng.choice([1, 1, 1, 2, 3]), k, score, rng.choice([0, 1, None]), rng.choice([None, 0.5, 2.0]), carried, k // 100))
    return out


def flat(df):
    return sorted(
        (r.run_id, r.total_count, r.correct_count, round(r.accuracy, 9), round(r.average_score, 9), round(r.average_inference_time, 9), tuple(sorted((k, round(v, 9)) for k, v in r.rouge_scores.items())), r.badcase_count)
        for r in df.collect()
    )


@pytest.mark.parametrize("every", [2, 100])
def test_appends_add_up_to_one_pass(spark, tmp_path, every):
    df = spark.createDataFrame(rows(), SCHEMA)
    store = RunningSummary(spark, str(tmp_path / "s"), df, ["run_id"], every=every)
    assert store.partials().count() == 0
    for part in range(9):
        store.append(df.where(F.col("part") == part), part)
        if part % 4 == 0:
            store.append(df.where(F.col("part") == part), part)  # given again after a failure
            assert flat(summary_of(store.partials())) == flat(run_summary(df.where(F.col("part") <= part)))
    assert flat(summary_of(store.partials())) == flat(run_summary(df))


def test_an_append_reads_no_old_result(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    df.write.partitionBy("part").parquet(str(tmp_path / "results"))
    results = lambda part: spark.read.schema(SCHEMA).parquet(str(tmp_path / "results" / f"part={part}"))
    store = RunningSummary(spark, str(tmp_path / "s"), results(0), ["run_id"], every=3)
    import shutil

    for part in range(9):
        store.append(results(part), part)
        shutil.rmtree(tmp_path / "results" / f"part={part}")
    got = summary_of(store.partials())
    assert not [f for f in got.inputFiles() if "/results/" in f]
    assert flat(got) == flat(run_summary(df))


def test_without_scores_times_or_rouge(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (1, None, 0)], "run_id long, score double, is_badcase int")
    store = RunningSummary(spark, str(tmp_path / "s"), df, ["run_id"])
    store.append(df, 0)
    assert flat(summary_of(store.partials())) == flat(run_summary(df))
