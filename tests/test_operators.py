import json
import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators import cases, curate, joins, reports, resume, summary
from evalspark.operators.generate import PermanentError, generate
from evalspark.operators.scoring import score
from evalspark.plans.numbering import number_rows
from evalspark.sources import checkpoints, csvs, jsonl, reportsink
from evalspark.sources.turns import samples_from_turns, turns_from_samples


def samples(spark, rows):
    """rows: (meta or None, [(role, text)])"""
    data = [(i, (m,) if m is not None else None, turns) for i, (m, turns) in enumerate(rows)]
    return spark.createDataFrame(data, "original_index long, meta struct<meta_description:string>, turns array<struct<role:string,text:string>>")


def test_expand_cases(spark):
    df = samples(spark, [
        ("sys", [("Human", "q1"), ("ASSISTANT", "a1"), ("tool", "t"), ("human", "q2"), ("assistant", "a2")]),
        (None, [("user", "q"), ("Assistant", "a")]),
        ("x", []),
        ("y", [("user", "only")]),
    ])
    got = cases.split_reference(cases.index_cases(df)).orderBy("index").collect()
    assert [(r["index"], r["original_index"], r["expanded_index"], r["reference_output"]) for r in got] == [(0, 0, 0, "a1"), (1, 0, 1, "a2"), (2, 1, 0, "a")]
    assert [(m["role"], m["content"]) for m in got[1]["messages"]] == [
        ("system", "sys"), ("user", "q1"), ("assistant", "a1"), ("tool", "t"), ("user", "q2"), ("assistant", "a2")]
    assert [m["content"] for m in got[2]["user_input"]] == ["", "q"]
    # The tested role is compared as given: a capitalised name never matches a lowered role.
    assert cases.expand_cases(df, "Assistant").count() == 0
    assert cases.expand_cases(df, "tool").count() == 1
    assert cases.expand_cases(df, "human").count() == 0


def test_turn_case_index_equals_sample_form_with_a_hot_conversation(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(400)] + [(c, t, r, "x") for c in range(20) if c != 7 for t, r in enumerate(["user", "assistant", "user"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    direct = {(r["conv_id"], r["expanded_index"]): (r["original_index"], r["index"]) for r in cases.turn_case_index(turns).collect()}
    built = cases.index_cases(samples_from_turns(turns)).collect()
    assert direct == {(r["conv_id"], r["expanded_index"]): (r["original_index"], r["index"]) for r in built}
    assert sorted(v[1] for v in direct.values()) == list(range(len(direct)))


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_number_rows_ignores_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("w")).repartition(6)
        got = number_rows(df, ["k"], "n", "w", "s").orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    running = 0
    for i, r in enumerate(got):
        assert (r["k"], r["n"], r["s"]) == (i, i, running)
        running += r["w"]


def test_history_equals_case_messages(spark):
    turns = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): [(m["role"], m["content"]) for m in r["messages"]] for r in cases.history(turns).collect()}
    assert got == {(1, 0): [("user", "q")], (1, 1): [("user", "q"), ("assistant", "a")], (2, 0): [("user", "z")]}
    back = turns_from_samples(samples_from_turns(turns))
    assert sorted((r["original_index"], r["turn"], r["role"], r["text"]) for r in back.collect()) == [(0, 0, "human", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "z")]


def test_caps_and_endpoints(spark):
    df = spark.range(40).withColumnRenamed("id", "index").repartition(4)
    capped = cases.smoke_cap(df, test_mode=True, cap=16)
    assert sorted(r["index"] for r in capped.collect()) == list(range(16)) and not capped.first()["test_mode"]
    small = cases.smoke_cap(df.where("index < 16"), test_mode=True, cap=16)
    assert small.count() == 16 and small.first()["test_mode"]
    assert cases.smoke_cap(df).count() == 40
    with pytest.raises(ValueError):
        cases.smoke_cap(df, test_mode=True)
    assert [r["endpoint"] for r in cases.assign_endpoint(df, ["a", "b", "c"]).orderBy("index").limit(4).collect()] == ["a", "b", "c", "a"]
    with pytest.raises(ValueError):
        cases.assign_endpoint(df, "abc")
    assert cases.limit_samples(df.withColumnRenamed("index", "original_index"), 0).count() == 40


def test_run_summary(spark):
    rows = [("r", 0, 1.0, 2.0, None), ("r", 1, None, None, "e"), ("r", 1, 0.5, 4.0, None), ("s", 1, None, None, "e")]
    df = spark.createDataFrame(rows, "run_id string, is_badcase int, score double, inference_time double, error string")
    got = {r["run_id"]: r.asDict() for r in summary.run_summary(df).collect()}
    assert got["r"]["total_count"] == 3 and got["r"]["correct_count"] == 1 and got["r"]["badcase_count"] == 2
    assert (round(got["r"]["accuracy"], 6), got["r"]["average_score"], got["r"]["average_inference_time"]) == (0.333333, 0.75, 3.0)
    assert (got["s"]["accuracy"], got["s"]["average_score"], got["s"]["rouge_scores"]) == (0.0, 0.0, {})
    assert summary.run_summary(df.limit(0)).count() == 0 and summary.run_summary(df.limit(0), by=None).count() == 0


def test_rouge_means_skip_error_rows(spark):
    df = spark.createDataFrame([(0, "a b", "a b", "r"), (1, None, "a", "r")], "index long, model_output string, reference_output string, run_id string")
    got = summary.run_summary(score(df, "rouge")).first()
    assert got["rouge_scores"] == {"rouge1": 1.0, "rouge2": 1.0, "rougeL": 1.0} and got["total_count"] == 2


def test_resume(spark):
    allcases = spark.range(6).withColumnRenamed("id", "index")
    done = spark.createDataFrame([(0, 1, "a", None), (0, 2, "b", None), (3, 1, None, "boom")], "index long, attempt int, model_output string, error string")
    assert sorted(r[0] for r in resume.pending(allcases, done).collect()) == [1, 2, 4, 5]
    assert sorted(r[0] for r in resume.pending(allcases, done, retry_errors=True).collect()) == [1, 2, 3, 4, 5]
    kept = resume.dedup_by_index(done, F.col("attempt")).orderBy("index").collect()
    assert [(r["index"], r["model_output"]) for r in kept] == [(0, "b"), (3, None)]
    assert resume.union_checkpoint(done, allcases).count() == 9


def test_generate_retries_and_keeps_failures(spark):
    df = cases.index_cases(samples(spark, [(None, [("user", f"q{i}"), ("assistant", "a")]) for i in range(4)]))

    def model(messages):
        name = messages[-1]["content"]
        if name == "q1":
            raise PermanentError("bad request")
        if name == "q2":
            raise RuntimeError("down")
        return name.upper()

    got = generate(df, model, retries=2, backoff=0.0).orderBy("index").collect()
    assert [(r["model_output"], r["error"]) for r in got] == [("Q0", None), (None, "bad request"), (None, "down"), ("Q3", None)]
    rows = joins.attach_outputs(df, generate(df, model, retries=1, backoff=0.0).where("index < 3"))
    assert [r["error"] for r in rows.orderBy("index").collect()] == [None, "bad request", "down", "no model output"]


def test_generate_keeps_calls_in_flight_and_passes_endpoints(spark):
    import time

    df = cases.assign_endpoint(cases.index_cases(samples(spark, [(None, [("user", f"q{i}"), ("assistant", "a")]) for i in range(8)])), ["u0", "u1"])

    def model(messages, url):
        name = messages[-1]["content"]
        time.sleep(0.6 - 0.07 * int(name[1:]))  # the last call ends first
        return f"{name}@{url}"

    started = time.monotonic()
    got = generate(df.coalesce(1), model, concurrency=8, endpoint="endpoint").orderBy("index").collect()
    assert [r["model_output"] for r in got] == [f"q{i}@u{i % 2}" for i in range(8)]
    assert max(r["inference_time"] for r in got) < 1.5 and time.monotonic() - started < 60


def test_edit_guard(spark):
    base = {"meta": {"meta_description": "m"}, "turns": [{"role": "u", "text": "a"}, {"role": "v", "text": "b"}], "id": 1}

    def edit(**changes):
        return json.dumps({**base, **changes})

    edits = {
        0: (edit(meta={"meta_description": "new"}), None),
        1: (edit(turns=[{"role": "u", "text": "A"}, {"role": "v", "text": "b"}]), None),
        2: (edit(), "no allowed change"),
        3: (edit(id=2), "another field changed"),
        4: (edit(turns=base["turns"][:1]), "turns length changed"),
        5: (edit(turns=[{"role": "x", "text": "A"}, {"role": "v", "text": "b"}]), "role changed"),
        6: (edit(turns=[{"role": "u", "text": "A", "n": 1}, {"role": "v", "text": "b"}]), "turn structure changed"),
        7: (edit(meta={"meta_description": "new", "k": 1}), "meta structure changed"),
        8: (json.dumps({k: base[k] for k in ("meta", "turns")}), "structure changed"),
        9: ("{broken", "not a JSON object"),
        10: (edit(meta=None), "meta structure changed"),
    }
    originals = spark.createDataFrame([(i, json.dumps(base)) for i in range(12)], "original_index long, raw string")
    after = curate.apply_edits(originals, spark.createDataFrame([(i, e) for i, (e, _) in edits.items()], "original_index long, raw string"))
    got = {r["original_index"]: r for r in after.collect()}
    assert {i: r["reason"] for i, r in got.items()} == {**{i: why for i, (_, why) in edits.items()}, 11: None}
    assert [i for i, r in got.items() if r["edited"]] == [0, 1] or {i for i, r in got.items() if r["edited"]} == {0, 1}
    assert got[0]["meta"]["meta_description"] == "new" and got[1]["turns"][0]["text"] == "A" and got[3]["raw"] == json.dumps(base)


def test_curation(spark):
    df = samples(spark, [(f"m{i}", [("u", f"Text {i}"), ("v", "w")]) for i in range(10)]).withColumn("raw", F.to_json(F.struct("meta", "turns")))
    assert [r["original_index"] for r in curate.search_samples(df, "tExT 3").collect()] == [3]
    assert curate.search_samples(df, "  ").count() == 10
    left = curate.delete_items(df, spark.createDataFrame([(0,), (4,), (99,)], "original_index long")).orderBy("original_index").collect()
    assert [(r["original_index"], r["meta"]["meta_description"]) for r in left] == list(enumerate(["m1", "m2", "m3", "m5", "m6", "m7", "m8", "m9"]))
    both = curate.append_items(df, df.where("original_index < 2"))
    assert sorted(r["original_index"] for r in both.collect()) == list(range(12))
    assert curate.append_counts(df, df.limit(2)).first()[:] == (2, 12)
    edited = curate.edit_turn_text(df, "v", "new").first()
    assert [t["text"] for t in edited["turns"]] == ["Text 0", "new"]
    with pytest.raises(ValueError):
        curate.edit_meta(df, "  ")


def test_edits_keep_unknown_members_of_raw(spark):
    item = {"meta": {"meta_description": "m", "k": [1]}, "turns": [{"role": "u", "text": "a", "n": 2}, {"role": "v", "text": "b"}], "id": {"x": "é"}}
    raws = spark.createDataFrame([(0, json.dumps(item)), (1, '{"id": 1}')], "original_index long, raw string")
    df = jsonl._with_fields(raws)
    meta = [json.loads(r["raw"]) for r in curate.edit_meta(df, 'new "q"').orderBy("original_index").collect()]
    assert meta == [{**item, "meta": {"meta_description": 'new "q"', "k": [1]}}, {"id": 1, "meta": {"meta_description": 'new "q"'}}]
    turns = [json.loads(r["raw"]) for r in curate.edit_turn_text(df, "u", "z").orderBy("original_index").collect()]
    assert turns == [{**item, "turns": [{"role": "u", "text": "z", "n": 2}, {"role": "v", "text": "b"}]}, {"id": 1}]


def test_edits_keep_the_spelling_of_numbers(spark):
    raw = '{"a":1.0,"b":[1.50,1e2,-0.0,{"c":10}],"meta":{"k":2.0,"meta_description":"1.0"},"turns":[{"n":3.10,"role":"u","text":"7.0"}]}'
    df = jsonl._with_fields(spark.createDataFrame([(0, raw)], "original_index long, raw string"))
    assert curate.edit_meta(df, "new 5.0").first()["raw"] == raw.replace('"meta_description":"1.0"', '"meta_description":"new 5.0"')
    assert curate.edit_turn_text(df, "u", "9.0").first()["raw"] == raw.replace('"7.0"', '"9.0"')


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    good = ['{"meta": {"meta_description": "m"}, "turns": [{"role": "Human", "text": "a"}], "extra": [1]}', "", "  ", '{"turns": []}', ' {"meta": null} ']
    path.write_text("\n".join(good))
    got = jsonl.read_samples(spark, str(path)).orderBy("original_index").collect()
    assert [r["original_index"] for r in got] == [0, 1, 2] and json.loads(got[0]["raw"])["extra"] == [1]
    assert got[0]["turns"][0]["text"] == "a" and got[2]["meta"] is None
    path.write_text("\n".join([*good, '{"a": 1} x']))
    with pytest.raises(Exception, match="not valid JSON"):
        jsonl.read_samples(spark, str(path)).collect()


def test_jsonl_numbers_across_splits_and_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.jsonl").write_text("\n".join(json.dumps({"n": f * 500 + i, "pad": "x" * 80}) + ("\n" if i % 7 == 0 else "") for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = jsonl.read_samples(spark, str(tmp_path)).select("original_index", F.get_json_object("raw", "$.n").cast("long").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 1500 and all(r["original_index"] == r["n"] for r in got)


def test_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('h0,h1,h2,h3,h4,h5,h6\nmeta,"d ""q""",q1,a1,"q\n2",a2,odd\n ,d,q,a,,,\nother,d,q,,q2,a2,\nmeta,,,,,,\n')
    rows = csvs.read_csv_rows(spark, str(path), multiline=True)
    assert [r["original_index"] for r in csvs.csv_to_samples(rows).orderBy("original_index").collect()] == [0, 2, 3]
    got = csvs.read_samples_csv(spark, str(path), multiline=True).orderBy("original_index").collect()
    assert [r["original_index"] for r in got] == [0, 1, 2]
    assert [r["meta"]["meta_description"] for r in got] == ['d "q"', "d", ""]
    assert [[(t["role"], t["text"]) for t in r["turns"]] for r in got] == [
        [("Human", "q1"), ("Assistant", "a1"), ("Human", "q\n2"), ("Assistant", "a2")], [("Human", "q2"), ("Assistant", "a2")], []]
    report, invalid = csvs.validate_csv(rows)
    assert report.first()[:4] == (5, 2, 0, 2)
    assert sorted(r["row"] for r in invalid.collect()) == [3, 4]
    assert [r["row"] for r in csvs.preview_csv(rows).orderBy("row").collect()] == [2, 5]
    (tmp_path / "bad.csv").write_text("a,b,c\nmeta,d,q\nmeta,d\n")
    with pytest.raises(Exception):
        csvs.read_csv_rows(spark, str(tmp_path / "bad.csv")).collect()


def test_dataset_blobs(spark):
    df = spark.createDataFrame([(1, '{"turns":[]}\r\n\n {"a":1}'), (2, '{"a":1}\n\n{bad\n{"b":1}\n'), (3, "")], "id long, file_content string")
    ok = jsonl.explode_dataset(df.where("id <> 2")).orderBy("id", "original_index").collect()
    assert [(r["id"], r["original_index"], r["raw"]) for r in ok] == [(1, 0, '{"turns":[]}'), (1, 1, '{"a":1}')]
    good, rejected = jsonl.explode_readable(df)
    assert sorted((r["id"], r["original_index"]) for r in good.collect()) == [(1, 0), (1, 1)]
    assert [tuple(r) for r in rejected.collect()] == [(2, 3, "{bad")]
    with pytest.raises(Exception, match="not valid JSON"):
        jsonl.explode_dataset(df).collect()
    items, counts = jsonl.preview_dataset(df)
    assert [(r["id"], r["total_count"], r["bad_line"]) for r in counts.orderBy("id").collect()] == [(1, 2, None), (2, 5, "{bad"), (3, 0, None)]
    assert sorted((r["id"], r["raw"]) for r in items.collect()) == [(1, '{"a":1}'), (1, '{"turns":[]}'), (2, '{"a":1}')]
    valid = {r["id"]: (r["valid"], r["bad_lines"]) for r in jsonl.validate_jsonl(jsonl.dataset_lines(df)).collect()}
    assert valid == {1: (True, 0), 2: (False, 1), 3: (True, 0)}


def test_checkpoint_files(spark, tmp_path):
    path = str(tmp_path / "ck")
    rows = spark.createDataFrame([(1, "a")], "index long, model_output string")
    assert checkpoints.load_checkpoint(spark, path, rows.schema).count() == 0
    checkpoints.append_checkpoint(rows, path)
    checkpoints.append_checkpoint(rows, path)
    assert checkpoints.load_checkpoint(spark, path, rows.schema).count() == 2


def test_report_round_trip(spark, tmp_path):
    results = score(spark.createDataFrame([(0, r"\boxed{1}", r"\boxed{1}", 5), (1, "x", "y", 5)], "index long, model_output string, reference_output string, run_id long"), "exact_match")
    config = spark.createDataFrame([(5, {"model": "m", "api_key": "k", "auth_token": "t", "report_dir": "d"})], "run_id long, config map<string,string>")
    reportsink.write_report(results, config, str(tmp_path), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    record = json.loads(spark.read.json(str(tmp_path / "records")).first()["record"])
    assert record["config"] == {"model": "m"} and record["summary"]["badcase_count"] == 1 and record["timestamp"] == "20240102_030405"
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2 and spark.read.parquet(str(tmp_path / "badcases")).count() == 1
    assert os.path.isdir(tmp_path / "text")
    with pytest.raises(ValueError):
        reportsink.write_report(results, config, str(tmp_path), F.current_timestamp(), ["pdf"])


def test_export_csv(spark, tmp_path):
    message = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(0.5, [("system", "s"), ("user", 'a "b"\nc')], "o", ""), (None, [("system", "s")], None, "r")],
                               f"score double, user_input {message}, model_output string, reference_output string")
    reportsink.export_results_csv(df.coalesce(1), str(tmp_path / "e"))
    part = next(p for p in (tmp_path / "e").iterdir() if p.suffix == ".txt")
    header = '"得分","用户输入","模型输出","参考答案"\n'
    assert part.read_bytes() == b"\xef\xbb\xbf" + (
        header + '"0.5000","a ""b""\nc","o","-"\n"-","[{""role"":""system"",""content"":""s""}]","-","r"\n'
    ).encode()
    reportsink.export_results_csv(df.limit(0), str(tmp_path / "none"))
    part = next(p for p in (tmp_path / "none").iterdir() if p.suffix == ".txt")
    assert part.read_bytes() == b"\xef\xbb\xbf" + header.encode()


def test_latest_and_state(spark):
    df = spark.createDataFrame([(1, 1, "d", "m", "2024-01-01", 0.1), (2, 1, "d", "m", "2024-01-01", 0.2), (3, 1, "d", "n", "2023-01-01", None)],
                               "id long, user_id long, dataset string, model string, created_at string, accuracy double")
    assert sorted(r["id"] for r in reports.latest_report(df).collect()) == [2, 3]
    assert reports.avg_accuracy(df).first()[0] == pytest.approx(0.1)
    assert reports.avg_accuracy(df.limit(0)).first()[0] == 0.0
    rows, total = reports.page(df, 2, 2)
    assert [r["id"] for r in rows.collect()] == [3] and total.first()[0] == 3
    updates = spark.createDataFrame([("t", 1, 1, "running", None), ("t", 3, 3, None, "late"), ("t", 2, 2, "done", "m")],
                                    "task_id string, ts long, event_id long, status string, message string")
    state = reports.task_state(updates, fields=("status", "message")).first()
    assert (state["status"], state["message"]) == ("done", "late")


def test_cascade_and_ownership(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, username string")
    runs = spark.createDataFrame([(10, "t1", 1), (11, "t2", 2), (12, "t3", 2)], "id long, task_id string, user_id long")
    stored = spark.createDataFrame([(20, "t1", 1), (21, "t2", 2), (22, "t3", 2), (23, "t1", 2)], "id long, task_id string, user_id long")
    left = joins.cascade_delete({"users": users, "runs": runs, "reports": stored}, spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([("t2",)], "task_id string"))
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in left.items()} == {"users": [2], "runs": [12], "reports": [22]}
    assert joins.owned(runs, 2, spark.createDataFrame([(11,), (10,)], "id long")).count() == 1
    assert {r["username"] for r in joins.with_owner(runs, users.where("id = 1")).collect()} == {"a", None}
