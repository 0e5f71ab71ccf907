import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.operators.generate import generate_resumable, load_answers

N = 400


def frame(spark):
    messages = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("q"), "index").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("a").alias("content")))
    return spark.range(N).withColumnRenamed("id", "index").withColumn("messages", messages)


def calls(log):
    return Counter(open(log).read().split()) if os.path.exists(log) else Counter()


def model_of(log, dies_at=None):
    def model(messages):
        name = messages[-1]["content"]
        with open(log, "a") as out:
            out.write(name + "\n")
        if dies_at is not None and sum(1 for _ in open(log)) >= dies_at:
            os._exit(1)  # the worker is gone, as on a lost executor
        return name.upper()

    return model


@pytest.mark.parametrize("concurrency", [1, 4])
def test_a_killed_run_repeats_no_committed_call(spark, tmp_path, concurrency):
    cases, log, path = frame(spark), str(tmp_path / "calls"), str(tmp_path / "answers")
    how = dict(interval=10, retries=1, backoff=0.0, concurrency=concurrency)
    kept = set()
    for dies_at in (120, 260):
        with pytest.raises(Exception):
            generate_resumable(cases, model_of(log, dies_at), path, **how)
        now = {r["index"] for r in load_answers(spark, path, cases).collect()}
        assert kept < now and len(now) < N
        kept = now
    before = calls(log)
    # Nothing but the calls of tasks that had not ended is lost: four tasks were running.
    assert sum(before.values()) - len(kept) <= 2 * 4 * 3 * 10
    rows = generate_resumable(cases, model_of(log), path, **how).collect()
    assert sorted((r["index"], r["model_output"]) for r in rows) == [(k, f"Q{k}") for k in range(N)]
    after = calls(log)
    assert all(after[f"q{k}"] == before[f"q{k}"] for k in kept)
    assert set(after) == {f"q{k}" for k in range(N)}
    assert spark.read.parquet(path).count() == N
    # A finished run asks nothing.
    generate_resumable(cases, model_of(log), path, **how)
    assert calls(log) == after


def test_failed_calls_are_asked_again_only_on_demand(spark, tmp_path):
    cases, log, path = frame(spark), str(tmp_path / "calls"), str(tmp_path / "answers")

    def down(messages):
        if int(messages[-1]["content"][1:]) % 3 == 0:
            raise RuntimeError("down")
        return "fine"

    first = generate_resumable(cases, down, path, interval=50, retries=1)
    assert first.where("error = 'down'").count() == len(range(0, N, 3))
    assert generate_resumable(cases, model_of(log), path, interval=50).where("error is null").count() == N - len(range(0, N, 3)) and not calls(log)
    again = generate_resumable(cases, model_of(log), path, interval=50, retry_errors=True).collect()
    assert calls(log) == Counter({f"q{k}": 1 for k in range(0, N, 3)})
    assert sorted((r["index"], r["model_output"]) for r in again) == [(k, "fine" if k % 3 else f"Q{k}") for k in range(N)]


def test_no_cases(spark, tmp_path):
    assert generate_resumable(frame(spark).where("index < 0"), None, str(tmp_path / "none")).count() == 0
