import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import curate, resume
from evalspark.plans import bitmaps


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def numbers(seed, n, reach):
    rng = random.Random(seed)
    return sorted(rng.sample(range(reach), n))


@pytest.mark.parametrize("reach", [10, 40_000, 200_000])
def test_has_and_rank(spark, reach):
    members = numbers(1, reach // 3, reach)
    sets = bitmaps.directory(spark.createDataFrame([(m,) for m in members] * 2 + [(None,)], "x long"), "x")
    rows = spark.range(reach).withColumn("_at", bitmaps.range_of(F.col("id")))
    got = rows.join(sets, F.col("_at") == F.col("_range")).select("id", bitmaps.has(F.col("id")), (F.col("_before") + bitmaps.rank(F.col("id")))).collect()
    inside, before = set(members), 0
    want = []
    for k in range(reach):
        want.append((k, k in inside, before))
        before += k in inside
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("kind", ["dense", "gaps", "repeats", "none", "all"])
def test_delete_items_equals_an_anti_join(spark, kind):
    n = 70_000
    index = F.col("id") * 2 if kind == "gaps" else F.col("id") % (n // 2) if kind == "repeats" else F.col("id")
    samples = spark.range(n).select(index.alias("original_index"), F.concat(F.lit("text "), "id").alias("text"))
    gone = [] if kind == "none" else list(range(n)) if kind == "all" else numbers(2, 20_000, n) + [-1, n, 10 * n]
    victims = spark.createDataFrame([(v,) for v in gone], "original_index long").withColumn("text", F.lit("x"))
    got = sorted(map(tuple, curate.delete_items(samples, victims).collect()))
    away = set(gone)
    left = sorted(r for r in map(tuple, samples.collect()) if r[0] not in away)
    if kind == "repeats":
        assert len({r[1] for r in got}) == len(left)
    else:
        assert got == [(k, text) for k, (_, text) in enumerate(left)]


def test_delete_items_shuffles_no_text(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("original_index"), F.md5(F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    found = curate.delete_items(samples, samples.where("original_index % 3 = 0").select("original_index"))
    assert found.count() == 50_000 - 16_667 and "text" in found.columns
    shown = plan(found)
    assert "BroadcastHashJoin" in shown and "hashpartitioning" not in shown and "rangepartitioning" not in shown


@pytest.mark.parametrize("spread", [1, 10**9])
def test_pending_equals_an_anti_join(spark, monkeypatch, spread):
    monkeypatch.setattr(bitmaps, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(bitmaps.ranges_within, "__defaults__", (1 << 20,))
    cases = spark.range(5000).select(F.when(F.col("id") % 1000 == 7, None).otherwise((F.col("id") - 100) * spread).alias("index"), F.lit("text").alias("text"))
    done = spark.createDataFrame([((k - 100) * spread, "e" if k % 5 == 0 else None) for k in numbers(3, 2000, 6000)] + [(None, None)], "index long, error string")
    for retry in (False, True):
        got = resume.pending(cases, done, retry_errors=retry)
        rest = done.where("error is null") if retry else done
        want = cases.join(rest.select("index"), "index", "left_anti")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.columns == cases.columns
        assert ("hashpartitioning" in plan(got) or "SortMergeJoin" in plan(got) or "LeftAnti" in plan(got)) == (spread > 1)


def test_pending_by_other_keys(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "name string, k int")
    assert [r.k for r in resume.pending(cases, cases.where("k = 1"), ["name"]).collect()] == [2]
    assert [r.k for r in resume.pending(cases, cases.where("k = 1"), ["name", "k"]).collect()] == [2]
