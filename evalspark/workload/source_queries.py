"""Readers, writers, validation and exports. File sources are first written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators.scoring import score
from evalspark.plans.durable import fresh_path
from evalspark.sources import checkpoints, csvs, jsonl, reportsink
from evalspark.sources.turns import group_turns
from evalspark.workload.case_queries import _transcript
from evalspark.workload.fixtures import BOXED, DATASETS, REPORTS, Fixture, table
from evalspark.workload.score_queries import _BOX_PAIR, _bad

STAMP = "2024-05-06 07:08:09"


def samples_jsonl(spark, sf):
    """Write all conversations as ordered JSONL text, read them back as samples."""
    path = fresh_path(spark, "jsonl")
    lines = group_turns(table(spark, sf, "conversations")).withColumn("line", F.to_json(F.struct("meta", "turns", "conv_id")))
    ordered = lines.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    # A blank line after every row must not change the numbering.
    ordered.select(F.concat("line", F.lit("\n  ")).alias("value")).write.text(path)
    return jsonl.read_samples(spark, path).select(
        "original_index", F.get_json_object("raw", "$.conv_id").cast("long").alias("conv_id"), _transcript().alias("transcript")
    )


def dataset_explode(spark, sf):
    return jsonl.explode_readable(DATASETS.frame(spark, sf))[0].select(
        "id", "original_index", "meta.meta_description", F.size("turns").cast("long").alias("n_turns"), F.get("turns", F.lit(0))["text"].alias("first_text")
    )


def dataset_rejects(spark, sf):
    return jsonl.explode_readable(DATASETS.frame(spark, sf))[1]


def dataset_preview(spark, sf):
    return jsonl.preview_dataset(DATASETS.frame(spark, sf))[1]


def dataset_preview_items(spark, sf):
    return jsonl.preview_dataset(DATASETS.frame(spark, sf))[0].select("id", F.col("pos").cast("long").alias("pos"), "raw")


def jsonl_validate(spark, sf):
    return jsonl.validate_jsonl(jsonl.dataset_lines(DATASETS.frame(spark, sf)))


def dataset_catalog(spark, sf):
    return jsonl.dataset_catalog(DATASETS.frame(spark, sf), 4)


CSV = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "marker": "CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'other' ELSE 'meta' END",
    "description": "concat(o_orderpriority, ', \"quoted\"')",
    "human_1": "concat('ask', chr(10), CAST(o_custkey AS STRING))",
    "assistant_1": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'reply' END",
    "human_2": "o_orderstatus",
    "assistant_2": "CAST(o_orderkey AS STRING)",
    "odd": "'x'",
})
CSV_COLUMNS = [c for c in CSV.columns if c != "o_orderkey"]


def _csv_path(spark, sf, columns=CSV_COLUMNS, limit=None):
    """The rows as real CSV files with quotes, commas and line breaks."""
    path = fresh_path(spark, "csv")
    rows = CSV.frame(spark, sf)
    ordered = (rows if limit is None else rows.limit(limit)).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.select(*columns).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return path


def _csv_rows(spark, sf):
    return csvs.read_csv_rows(spark, _csv_path(spark, sf), multiline=True)


def csv_to_samples(spark, sf):
    return csvs.read_samples_csv(spark, _csv_path(spark, sf), multiline=True).select("original_index", "meta.meta_description", _transcript().alias("transcript"))


def csv_validate(spark, sf):
    """Counters of three uploads: whole rows, their first column alone (blank rows are empty
    there), and a header without rows."""
    uploads = {"wide": _csv_path(spark, sf), "narrow": _csv_path(spark, sf, ["marker"]), "header": _csv_path(spark, sf, limit=0)}
    reports = [csvs.validate_csv(csvs.read_csv_rows(spark, path, multiline=True))[0].withColumn("upload", F.lit(name)) for name, path in uploads.items()]
    return reports[0].union(reports[1]).union(reports[2])


def csv_invalid_rows(spark, sf):
    return csvs.validate_csv(_csv_rows(spark, sf))[1].select("row", F.get("cells", F.lit(0)).alias("marker"), "error")


def csv_preview(spark, sf):
    return csvs.preview_csv_file(spark, _csv_path(spark, sf)).select("row", "meta.meta_description", _transcript().alias("transcript"))


def checkpoint_roundtrip(spark, sf):
    path = fresh_path(spark, "checkpoint")
    rows = BOXED.frame(spark, sf).select("conv_id", "turn", "model_output")
    for part in ("turn < 2", "turn >= 2"):
        checkpoints.append_checkpoint(rows.where(part), path)
    return checkpoints.load_checkpoint(spark, path, rows.schema)


def _run_config(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("run_id")).distinct().withColumn(
        "config", F.create_map(*[F.lit(x) for x in ("model", "org/m", "api_key", "k", "report_dir", "/r", "auth_token", "t", "timeout", "600")])
    )


def report_record(spark, sf):
    """Write a report, then read its parts back."""
    path = fresh_path(spark, "report")
    reportsink.write_report(score(BOXED.frame(spark, sf), "exact_match"), _run_config(spark, sf), path, F.lit(STAMP).cast("timestamp"))
    record = spark.read.schema("run_id long, record string").json(f"{path}/records")
    bad = spark.read.parquet(f"{path}/badcases").groupBy("run_id").agg(F.count(F.lit(1)).alias("stored_badcases"))
    get = lambda p: F.get_json_object("record", p)
    return record.join(bad.withColumn("run_id", F.col("run_id").cast("long")), "run_id", "left").select(
        "run_id", get("$.timestamp").alias("stamp"), get("$.summary.total_count").cast("long").alias("total_count"),
        get("$.summary.badcase_count").cast("long").alias("badcase_count"), F.coalesce("stored_badcases", F.lit(0)).alias("stored_badcases"),
        F.array_join(F.array_sort(F.map_keys(F.from_json(get("$.config"), "map<string,string>"))), ",").alias("config_keys"),
    )


def safe_config(spark, sf):
    from evalspark.operators.reports import safe_config as safe

    configs = table(spark, sf, "orders").select("o_orderkey", F.create_map(
        F.lit("model"), F.col("o_orderpriority"), F.lit("api_key"), F.col("o_orderstatus"), F.lit("checkpoint_path"), F.lit("/c"),
        F.lit("database_service_url"), F.lit("u"), F.lit("scoring"), F.lit("rouge")).alias("config"))
    return configs.withColumn("safe", safe(F.col("config"))).select(
        "o_orderkey", F.array_join(F.array_sort(F.map_keys("safe")), ",").alias("keys"), F.try_element_at("safe", F.lit("model")).alias("model"))


REPORT_DOCS = Fixture("orders", {
    "id": "o_orderkey",
    "report_content": """CASE WHEN o_orderkey % 7 = 0 THEN concat('raw ', o_orderstatus) ELSE concat('{"timestamp": "20240101_000000", "config": {"model": "m', CAST(o_custkey % 3 AS STRING), '"}, "summary": {"total_count": 2, "accuracy": 0.5, "badcase_count": ',
        CAST(o_custkey % 2 AS STRING), '}, "badcases": [], "results": [{"index": 0, "score": 1.0, "is_badcase": 0, "model_output": "', o_orderpriority, '", "user_input": [{"role": "user", "content": "hi"}]}, {"index": ', CAST(o_orderkey AS STRING), ', "is_badcase": 1, "error": "timeout"}]}') END""",
})


def report_explode(spark, sf):
    return reportsink.explode_report(REPORT_DOCS.frame(spark, sf)).select(
        "id", F.col("pos").cast("long").alias("pos"), "index", "score", "is_badcase", "model_output", "error")


def report_explode_summary(spark, sf):
    summaries = reportsink.report_summaries(REPORT_DOCS.frame(spark, sf))
    return summaries.select("id", F.col("config")["model"].alias("model"), "total_count", "accuracy", "badcase_count", "raw")


EXPORT = Fixture("orders", {
    "id": "o_orderkey",
    "score": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 64 AS DOUBLE) / 64 END",
    "question": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('q \"', o_orderpriority, '\"') END",
    "model_output": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('a,', o_orderstatus) END",
    "reference_output": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END",
})


def _export_results(spark, sf):
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.array(message("system", F.lit("s")), message("user", F.col("question")))
    return EXPORT.frame(spark, sf).withColumn("user_input", F.when(F.col("question").isNotNull(), asked).otherwise(F.array(message("system", F.lit("s")))))


def export_rows(spark, sf):
    """Rows of the export; the id is kept out of it, so rows are counted."""
    rows = reportsink.export_rows(_export_results(spark, sf))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def export_csv(spark, sf):
    """Write the CSV export and read it back."""
    path = fresh_path(spark, "export")
    reportsink.export_results_csv(_export_results(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).toDF("score", "user_input", "model_output", "reference_output")
    return back.groupBy(*back.columns).agg(F.count(F.lit(1)).alias("n"))


def export_file_name(spark, sf):
    from evalspark.functions.display import export_name

    return REPORTS.frame(spark, sf).select("id", export_name(F.col("dataset"), F.col("model")).alias("name"))


QUERIES = {f.__name__: f for f in (
    samples_jsonl, dataset_explode, dataset_rejects, dataset_preview, dataset_preview_items, jsonl_validate, dataset_catalog, csv_to_samples, csv_validate,
    csv_invalid_rows, csv_preview, checkpoint_roundtrip, report_record, safe_config, report_explode, report_explode_summary, export_rows,
    export_csv, export_file_name,
)}

_LINES = f"""fx AS ({DATASETS.sql()}), p AS (SELECT id, list_transform(string_split(file_content, chr(10)), lambda x: trim(x)) AS parts FROM fx), l AS (SELECT id, i AS pos, parts[i + 1] AS line FROM (SELECT id, parts, unnest(range(0, len(parts))) AS i FROM p)),
    n AS (SELECT id, list(line ORDER BY pos) AS lines, count(*) AS raw_lines, min(pos) FILTER (line <> '' AND NOT json_valid(line)) AS bad FROM l GROUP BY id)"""
_CSV = f"""fx AS ({CSV.sql()}), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) + 1 AS row,
    concat_ws(chr(10) || chr(10), CASE WHEN human_1 <> '' AND assistant_1 <> '' THEN '[Human]: ' || human_1 || chr(10) || chr(10) || '[Assistant]: ' || assistant_1 END,
    CASE WHEN human_2 <> '' AND assistant_2 <> '' THEN '[Human]: ' || human_2 || chr(10) || chr(10) || '[Assistant]: ' || assistant_2 END) AS transcript FROM fx)"""
_EXPORT = f"""WITH fx AS ({EXPORT.sql()}), e AS (SELECT CASE WHEN score IS NULL THEN '-' ELSE printf('%.4f', round(score, 4)) END AS score,
    coalesce(question, '[{{"role":"system","content":"s"}}]') AS user_input, coalesce(model_output, '-') AS model_output, coalesce(nullif(reference_output, ''), '-') AS reference_output FROM fx)
    SELECT score, user_input, model_output, reference_output, count(*) AS n FROM e GROUP BY ALL"""

ORACLES = {
    "samples_jsonl": """SELECT row_number() OVER (ORDER BY conv_id) - 1 AS original_index, conv_id, string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""",
    "dataset_explode": f"""WITH {_LINES}, k AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS original_index FROM l WHERE line <> '' AND id IN (SELECT id FROM n WHERE bad IS NULL))
        SELECT id, original_index, json_extract_string(line, '$.meta.meta_description') AS meta_description, CAST(json_array_length(line, '$.turns') AS BIGINT) AS n_turns, json_extract_string(line, '$.turns[0].text') AS first_text FROM k""",
    "dataset_rejects": f"WITH {_LINES} SELECT id, bad + 1 AS line_number, lines[bad + 1] AS line FROM n WHERE bad IS NOT NULL",
    "dataset_preview": f"""WITH {_LINES} SELECT id, CAST(CASE WHEN bad IS NOT NULL THEN raw_lines ELSE len(list_filter(lines, lambda x: x <> '')) END AS BIGINT) AS total_count,
        CASE WHEN bad IS NOT NULL THEN lines[bad + 1] END AS bad_line FROM n""",
    "dataset_preview_items": f"WITH {_LINES} SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY l.pos) - 1 AS pos, l.line AS raw FROM l JOIN n USING (id) WHERE l.line <> '' AND (bad IS NULL OR l.pos < bad)",
    "jsonl_validate": f"WITH {_LINES} SELECT id, count(*) FILTER (line <> '' AND NOT json_valid(line)) = 0 AS valid, count(*) FILTER (line <> '' AND NOT json_valid(line)) AS bad_lines, count(*) FILTER (line <> '') AS items FROM l GROUP BY id",
    "dataset_catalog": f"WITH fx AS ({DATASETS.sql()}) SELECT id, user_id, filename, description, CAST(strlen(file_content) AS BIGINT) AS file_size, created_at FROM fx WHERE user_id = 4",
    "csv_to_samples": f"WITH {_CSV} SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS original_index, description AS meta_description, transcript FROM r WHERE trim(marker) <> ''",
    "csv_validate": f"""WITH {_CSV} SELECT 'wide' AS upload, count(*) + 1 AS total_rows, count(*) FILTER (marker = 'meta') AS valid_rows, CAST(0 AS BIGINT) AS empty_rows, count(*) FILTER (marker <> 'meta') AS invalid_rows, CAST(NULL AS VARCHAR) AS error FROM r
        UNION ALL SELECT 'narrow', count(*) + 1, 0, count(*) FILTER (trim(marker) = ''), count(*) FILTER (trim(marker) <> ''), NULL FROM r
        UNION ALL SELECT 'header', 1, 0, 0, 0, 'a header row and one data row are required'""",
    "csv_invalid_rows": f"WITH {_CSV} SELECT row, marker, 'First column must be ''meta''' AS error FROM r WHERE marker <> 'meta'",
    "csv_preview": f"WITH {_CSV} SELECT row, description AS meta_description, transcript FROM r WHERE marker = 'meta' ORDER BY row LIMIT 5",
    "checkpoint_roundtrip": f"WITH fx AS ({BOXED.sql()}) SELECT conv_id, turn, model_output FROM fx",
    "report_record": f"""WITH fx AS ({BOXED.sql()}), {_BOX_PAIR}, z AS (SELECT run_id, {_bad('score', 'false', 1.0)} AS bad FROM s)
        SELECT run_id, '20240506_070809' AS stamp, count(*) AS total_count, count(*) FILTER (bad = 1) AS badcase_count, count(*) FILTER (bad = 1) AS stored_badcases, 'model,timeout' AS config_keys FROM z GROUP BY run_id""",
    "safe_config": "SELECT o_orderkey, 'model,scoring' AS keys, o_orderpriority AS model FROM orders",
    "report_explode": """SELECT o_orderkey AS id, CAST(p AS BIGINT) AS pos, CASE p WHEN 0 THEN 0 ELSE o_orderkey END AS index, CASE p WHEN 0 THEN 1.0::DOUBLE END AS score, CAST(p AS INTEGER) AS is_badcase,
        CASE p WHEN 0 THEN o_orderpriority END AS model_output, CASE p WHEN 1 THEN 'timeout' END AS error FROM orders, (VALUES (0), (1)) AS v(p) WHERE o_orderkey % 7 <> 0""",
    "report_explode_summary": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'm' || o_custkey % 3 END AS model, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(2 AS BIGINT) END AS total_count,
        CASE WHEN o_orderkey % 7 <> 0 THEN 0.5::DOUBLE END AS accuracy, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 2 AS BIGINT) END AS badcase_count, CASE WHEN o_orderkey % 7 = 0 THEN 'raw ' || o_orderstatus END AS raw FROM orders""",
    "export_rows": _EXPORT,
    "export_csv": _EXPORT,
    "export_file_name": f"WITH fx AS ({REPORTS.sql()}) SELECT id, regexp_replace(dataset, '\\.[^/.]+$', '') || '+' || model || '.csv' AS name FROM fx",
}
