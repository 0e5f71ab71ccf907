import datetime as dt
import random

import pytest

from evalspark.operators.scoring import score
from evalspark.streaming import admission, incremental

BASE = dt.datetime(2024, 1, 1)


def brute_force(rows, window, n):
    accepted, verdict = {}, {}
    for event, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [t for t in accepted.get(key, []) if at - t < window]
        verdict[event] = len(recent) < n
        accepted[key] = recent + [at] if verdict[event] else recent
    return verdict


def events(seed=5):
    rng = random.Random(seed)
    rows = []
    for event in range(1500):
        key = 0 if event % 3 == 0 else rng.randint(1, 12)  # one key holds a third of the rows
        rows.append((event, key, BASE + dt.timedelta(seconds=rng.choice([rng.randint(0, 3000), rng.randint(9000, 40000)]))))
    return rows


@pytest.mark.parametrize("n", [1, 3])
def test_sliding_admission_batch(spark, n):
    rows = events()
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(4)
    got = {r["event_id"]: r["accepted"] for r in admission.sliding_admission(df, "user_id", "ts", "5 minutes", n).collect()}
    assert got == brute_force(rows, dt.timedelta(minutes=5), n)


def one_key(kind):
    """All events of one key that never pauses for a window of five minutes."""
    rng = random.Random(3)
    if kind == "full":  # steps of one second: full all the time, courses never meet
        at = range(3000)
    elif kind == "bursts":
        at = [t * 60 + rng.choice([0, 0, 1, 7, 30]) for t in range(300) for _ in range(rng.choice([1, 2, 9]))]
    else:  # now full, now not
        at = [t * 40 + rng.randint(0, 39) for t in range(1200) if (t // 100) % 2 or t % 6 == 0]
    return [(k, 1, BASE + dt.timedelta(seconds=t)) for k, t in enumerate(at)] + [(10**6 + k, 2, BASE + dt.timedelta(seconds=400 * k)) for k in range(40)]


@pytest.mark.parametrize("kind", ["full", "bursts", "mixed"])
@pytest.mark.parametrize("n,chunk,rounds", [(1, 37, 2), (4, 100, 2), (4, 100, 0), (10, 7, 1)])
def test_a_key_that_never_pauses_is_cut_into_chunks(spark, kind, n, chunk, rounds):
    rows = one_key(kind)
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(4)
    got = {r["event_id"]: r["accepted"] for r in admission.sliding_admission(df, "user_id", "ts", "5 minutes", n, chunk=chunk, rounds=rounds).collect()}
    assert got == brute_force(rows, dt.timedelta(minutes=5), n)


def test_admission_of_no_events_and_null_keys(spark):
    schema = "event_id long, user_id long, ts timestamp"
    assert admission.sliding_admission(spark.createDataFrame([], schema), "user_id", "ts").count() == 0
    rows = spark.createDataFrame([(1, None, BASE), (2, 5, BASE)], schema)
    assert {r.event_id: r.accepted for r in admission.sliding_admission(rows, "user_id", "ts").collect()} == {1: False, 2: True}


def test_admission_boundary_is_strict(spark):
    rows = [(0, 1, BASE), (1, 1, BASE + dt.timedelta(seconds=299)), (2, 1, BASE + dt.timedelta(seconds=300))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in admission.sliding_admission(df, "user_id", "ts", "5 minutes", 1).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_sliding_admission_stream(spark, tmp_path):
    rows = sorted(events(9), key=lambda r: r[2])
    source = tmp_path / "in"
    closing = (10**6, 99, BASE + dt.timedelta(days=30))  # moves the watermark past everything
    for i in range(0, len(rows), 300):
        part = rows[i:i + 300] + ([closing] if i + 300 >= len(rows) else [])
        spark.createDataFrame(part, "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = admission.sliding_admission_stream(stream, "user_id", "ts", "5 minutes", 3, late="1 minute")
    query = out.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["event_id"]: r["accepted"] for r in spark.table("admitted").collect() if r["event_id"] < 10**6}
    assert got == brute_force(rows, dt.timedelta(minutes=5), 3)


def test_admission_stream_restarts_and_keeps_little(spark, tmp_path):
    """Started anew for every file from the same checkpoint; the state holds accepted times and
    waiting events only, and nothing of keys whose last window is over."""
    rng = random.Random(4)
    schema = "event_id long, user_id string, ts timestamp"
    rows = [(k, rng.choice(["a", "b", "ä"]), BASE + dt.timedelta(milliseconds=k * 3000 + rng.randint(0, 2999))) for k in range(900)]
    rows += [(2000 + k, "a", rows[10][2]) for k in range(5)] + [(3000, None, BASE)]
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[1][2])]
    closing = (10**6, "end", BASE + dt.timedelta(days=30))
    source, out, sizes = str(tmp_path / "in"), str(tmp_path / "out"), []
    for i in range(0, 906, 302):
        part = rows[i:i + 302]
        rng.shuffle(part)
        spark.createDataFrame(part + ([closing] if i == 604 else []), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        verdicts = admission.sliding_admission_stream(stream, "user_id", "ts", "5 minutes", 4, late="10 minutes")
        query = verdicts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append([p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1])
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(out).collect() if r["event_id"] < 10**6}
    assert got == brute_force([r for r in rows if r[1] is not None], dt.timedelta(minutes=5), 4)
    # Ten minutes of events wait, 200 slots of a second; each key has four accepted times and a count.
    # What the last batch accepted stays till the next.
    assert max(sizes[:2]) <= 200 + 3 * 6 and sizes[2] <= 3 * 6


class Handle:
    """State of one key in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getMapState(self, *_):
        return self._state({})

    getValueState = getMapState

    def _state(self, held):
        outer = self

        class State:
            def __getattr__(self, name):
                def call(*given):
                    outer.calls += 1
                    if name in ("getValue", "get"):
                        return held.get(given[0] if given else ())
                    if name in ("updateValue", "update"):
                        held[given[0] if len(given) == 2 else ()] = given[-1]
                    elif name == "removeKey":
                        del held[given[0]]
                    elif name == "clear":
                        held.clear()
                    else:
                        return list(held)
                return call

        return State()


@pytest.mark.parametrize("n,mixed", [(3, 0), (3, 400), (600, 400)])
def test_admission_state_is_touched_by_the_piece(n, mixed):
    """One key, 6,000 events in 6 batches, out of order by up to ``mixed`` seconds."""
    from types import SimpleNamespace

    import pandas as pd

    rng = random.Random(n)
    rows = [(k, 1, BASE + dt.timedelta(seconds=k + rng.randint(0, mixed))) for k in range(6000)]
    judge, handle, got, most = admission.Admit("user_id", "event_id", "ts", "bigint", 300 * 10**6, n), Handle(), {}, 0
    judge.init(handle)
    for batch in range(7):
        part = rows[batch * 1000 : batch * 1000 + 1000]
        rng.shuffle(part)
        if part:
            judge.handleInputRows((1,), iter([pd.DataFrame(part, columns=["event_id", "user_id", "ts"])]), None)
        # All times are UTC; at the end the watermark passes everything.
        reached = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + (batch + 1) * 1_000_000 + (10**8 if batch == 6 else 0)
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: reached)
        while fired := [t for t in handle.timers if t < reached]:
            for out in judge.handleExpiredTimer((1,), now, SimpleNamespace(getExpiryTimeInMs=lambda: min(fired))):
                got.update(zip(out["event_id"], out["accepted"]))
            handle.timers.remove(min(fired))
    assert got == brute_force(rows, dt.timedelta(minutes=5), n)
    assert handle.calls < 600  # a call per event would be 6,000


@pytest.mark.parametrize("name", ["exact_match", "rouge"])
def test_stream_scoring_equals_batch_and_restarts(spark, tmp_path, name):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "run_id long, index long, model_output string, reference_output string, ts timestamp"
    rows = [(1, i, rf"\boxed{{{i % 3}}} w{i}", r"\boxed{1} w1", BASE + dt.timedelta(seconds=i)) for i in range(40)]
    keys = ["run_id", "index"]

    def push(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.start_scoring(stream, name, out, checkpoint, "1 hour", keys=keys).awaitTermination()

    push(rows[:25] + rows[:5])
    push(rows[20:])  # overlaps what was scored before the restart
    columns = [*keys, "score", "is_badcase"]
    got = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    want = sorted(map(tuple, score(spark.createDataFrame(rows, schema), name).select(columns).collect()))
    assert got == want


@pytest.mark.parametrize("files", [1, 3])
def test_stream_scoring_reads_a_file_or_a_folder(spark, tmp_path, files):
    from evalspark.workload.stream_queries import stream_scoring

    rows = spark.createDataFrame([(k // 4, k % 4, "user", f"text {k}") for k in range(40)], "conv_id long, turn long, role string, text string")
    written, at = tmp_path / "written", tmp_path / "sf" / "conversations.parquet"
    rows.repartition(files).write.parquet(str(written))
    at.parent.mkdir()
    (next(written.glob("part-*.parquet")) if files == 1 else written).rename(at)
    rows.write.parquet(str(tmp_path / "sf" / "other.parquet"))
    got = sorted((r.conv_id, r.turn) for r in stream_scoring(spark, str(tmp_path / "sf")).collect())
    assert got == [(k // 4, k % 4) for k in range(40)]


def test_state_stream_equals_batch(spark, tmp_path):
    schema = "task_id long, ts timestamp, event_id long, status string, current long, message string"
    rows = [(i % 4, BASE + dt.timedelta(seconds=(i * 37) % 101), i, None if i % 3 == 0 else f"s{i}", i, None if i % 2 else f"m{i}") for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = incremental.task_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    from evalspark.operators.reports import task_state

    fields = ["task_id", "status", "current", "message"]
    assert sorted(map(tuple, spark.table("state").select(fields).collect())) == sorted(map(tuple, task_state(df).select(fields).collect()))


def test_rows_that_came_too_late_can_be_found(spark):
    source = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "run_id long, index long")
    scored = source.where("index = 1")
    assert [tuple(r) for r in incremental.unscored(source, scored).collect()] == [(1, 2)]


def test_folded_table_stays_small_and_survives_replays(spark, tmp_path):
    from pyspark.sql import functions as F

    from evalspark.plans.folded import FoldedTable, newest_per

    live = FoldedTable(spark, str(tmp_path / "live"), spark.createDataFrame([], "k string, v long").schema, newest_per("k"), every=5)
    assert live.read().count() == 0
    rng, want, most = random.Random(1), {}, 0
    for epoch in range(50):
        changed = {rng.choice("abcdefgh"): epoch for _ in range(3)}
        batch = spark.createDataFrame(list(changed.items()), "k string, v long").coalesce(1)
        live.write(batch, epoch)
        want |= changed
        most = max(most, len(list((tmp_path / "live" / "changes").iterdir())) + len(list((tmp_path / "live").glob("base/*"))))
        if epoch % 7 == 0:
            live.write(batch, epoch)  # the stream failed after the write and replays it
        if epoch in (4, 23):  # a replay of what is folded, and an unfinished fold and batch, change nothing
            live.write(spark.createDataFrame([("a", -1)], "k string, v long"), epoch - 4)
            (tmp_path / "live" / "base" / "1000").mkdir(parents=True)
            (tmp_path / "live" / "changes" / "1000").mkdir(parents=True)
        if epoch % 10 == 3 or epoch == 23:
            assert {r.k: r.v for r in live.read().collect()} == want
        for kind in ("base", "changes"):
            if (tmp_path / "live" / kind / "1000").exists():
                (tmp_path / "live" / kind / "1000").rmdir()
    assert {r.k: r.v for r in live.read().collect()} == want
    assert most <= 2 * 5 + 2 + 2
    # A reader that began before the last fold can still read.
    before = live.read()
    for epoch in range(50, 55):
        live.write(spark.createDataFrame([("z", epoch)], "k string, v long"), epoch)
    assert {r.k: r.v for r in before.collect()} == want
    assert live.read().where(F.col("k") == "z").first().v == 54
