"""Dataset curation, resume, joins and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import text
from evalspark.operators import curate, joins, resume
from evalspark.operators.cases import turn_case_index
from evalspark.plans.numbering import number_rows
from evalspark.schemas import TURN
from evalspark.sources.turns import samples_from_turns
from evalspark.workload.case_queries import _INDEX, _SAMPLES, _transcript
from evalspark.workload.fixtures import Fixture, table

NEEDLE = "NICHT"
META = "fresh description"
REPLY = "[removed]"


def _samples(spark, sf):
    return samples_from_turns(table(spark, sf, "conversations"))


def sample_search(spark, sf):
    return curate.search_samples(_samples(spark, sf), NEEDLE).select("conv_id", F.size("turns").cast("long").alias("n_turns"))


def distinct_roles(spark, sf):
    return curate.distinct_roles(_samples(spark, sf))


def edit_meta(spark, sf):
    return curate.edit_meta(_samples(spark, sf), META).select(
        "conv_id", "meta.meta_description", F.size("turns").cast("long").alias("n_turns"),
        F.get_json_object("raw", "$.meta.meta_description").alias("stored_description"))


def edit_turn_text(spark, sf):
    return curate.edit_turn_text(_samples(spark, sf), "assistant", REPLY).select(
        "conv_id", _transcript().alias("transcript"), text.count_substr(F.col("raw"), F.lit(REPLY)).cast("long").alias("stored_replies"))


def delete_items(spark, sf):
    samples = _samples(spark, sf)
    victims = samples.where(F.size("turns") > 4)
    return curate.delete_items(samples, victims).select("original_index", "conv_id")


def edit_guard(spark, sf):
    """Six kinds of edit, by sample number."""
    samples = _samples(spark, sf)
    kind = F.col("original_index") % 6

    def last(change):
        return F.transform("turns", lambda t, i: F.when(i == F.size("turns") - 1, change(t)).otherwise(t))

    turns = (
        F.when(kind == 1, last(lambda t: t.withField("text", F.lit(REPLY))))
        .when(kind == 2, last(lambda t: t.withField("role", F.lit("other"))))
        .when(kind == 3, F.slice("turns", F.lit(1), F.size("turns") - 1))
        .otherwise(F.col("turns"))
    )
    body = F.to_json(F.struct("meta", turns.alias("turns")))
    edits = samples.where(kind != 0).select(
        "original_index", F.when(kind == 4, F.concat(F.lit('{"extra": 1, '), F.substring(body, F.lit(2), F.length(body)))).otherwise(body).alias("raw")
    )
    after = curate.apply_edits(samples.select("original_index", "raw"), edits)
    return after.select("original_index", "edited", "reason", _transcript().alias("transcript"))


def append_items(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    numbers = number_rows(docs.select("doc_id"), ["doc_id"], "original_index")
    new = docs.join(numbers, "doc_id").select(
        "original_index",
        F.array(F.struct(F.lit("user").alias("role"), F.col("text"))).cast(f"array<{TURN.simpleString()}>").alias("turns"),
    )
    both = curate.append_items(_samples(spark, sf).select("original_index", "turns"), new)
    return both.select("original_index", F.size("turns").cast("long").alias("n_turns"), F.md5(F.col("turns")[0]["text"]).alias("first_text"))


def append_counts(spark, sf):
    return curate.append_counts(table(spark, sf, "orders"), table(spark, sf, "documents"))


def _checkpoint(cases):
    """Unscored checkpoint rows of some cases; those of late turns were appended twice."""
    first = cases.select("index", "turn", F.lit(1).alias("attempt"), F.concat(F.lit("out"), F.col("index")).alias("model_output"))
    again = first.where("turn > 3").withColumns({"attempt": F.lit(2), "model_output": F.concat(F.col("model_output"), F.lit("b"))})
    return first.unionByName(again).drop("turn")


def resume_pending(spark, sf):
    cases = turn_case_index(table(spark, sf, "conversations"))
    todo, _ = resume.resume(cases, _checkpoint(cases.where("turn > 1")), F.col("attempt"))
    return todo.select("index", "conv_id", "turn")


def union_checkpoint(spark, sf):
    cases = turn_case_index(table(spark, sf, "conversations"))
    done = _checkpoint(cases.where("turn > 1"))
    new = cases.where("turn <= 1").select("index", F.lit("new").alias("model_output"))
    return resume.union_checkpoint(done, new).select("index", F.coalesce("attempt", F.lit(0)).alias("attempt"), "model_output")


def checkpoint_dedup(spark, sf):
    return resume.dedup_by_index(_checkpoint(turn_case_index(table(spark, sf, "conversations"))), F.col("attempt"))


REQUESTS = Fixture("orders", {
    "request_id": "o_orderkey",
    "model": "concat('org/m', CAST(o_orderkey % 6 AS STRING))",
    "data_file": "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'set.jsonl' END",
    "scoring": "'rouge'",
    "n_urls": "o_custkey % 2",
    "api_key": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'sk-xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx' ELSE 'own' END",
    "max_workers": "CAST(o_custkey % 3 AS INT)",
    "badcase_threshold": "CAST(o_custkey % 4 AS DOUBLE) / 4",
    "timeout": "CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 600 ELSE 30 END AS INT)",
    "max_tokens": "CAST(CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 16384 ELSE 512 END AS INT)",
    "temperature": "CAST(o_orderkey % 2 AS DOUBLE) / 2",
    "top_p": "CAST(o_custkey % 2 AS DOUBLE)",
})

CONFIGS = Fixture("region", {
    "id": "r_regionkey",
    "model_name": "concat('org/m', CAST(r_regionkey AS STRING))",
    "url": "concat('http://', r_name)",
    "api_key": "CASE WHEN r_regionkey = 1 THEN '' ELSE concat('key', CAST(r_regionkey AS STRING)) END",
    "timeout": "CAST(100 + r_regionkey AS INT)",
    "max_tokens": "CAST(1000 + r_regionkey AS INT)",
    "temperature": "CAST(r_regionkey AS DOUBLE) / 8",
    "top_p": "0.5 + CAST(r_regionkey AS DOUBLE) / 16",
    "is_vllm": "r_regionkey % 2 = 1",
    "is_active": "r_regionkey <> 2",
    "created_at": "concat('2024-01-0', CAST(r_regionkey % 3 + 1 AS STRING))",
})


def _resolved(spark, sf):
    no_urls = F.array().cast("array<string>")
    requests = REQUESTS.frame(spark, sf).withColumn("api_urls", F.when(F.col("n_urls") > 0, F.array(F.lit("http://own"))).otherwise(no_urls)).drop("n_urls")
    configs = CONFIGS.frame(spark, sf).withColumn("api_urls", F.array("url")).drop("url", "created_at", "is_active", "id")
    return joins.resolve_config(requests, configs)


def resolve_run_config(spark, sf):
    ok, _ = _resolved(spark, sf)
    return ok.select("request_id", "model", F.array_join("api_urls", ",").alias("urls"), "api_key", "max_workers", "badcase_threshold", "timeout", "max_tokens", "temperature", "top_p", "is_vllm")


def rejected_requests(spark, sf):
    return _resolved(spark, sf)[1].select("request_id", "model", "reason")


OWNED = Fixture("orders", {"id": "o_orderkey", "task_id": "o_orderkey", "user_id": "o_custkey", "status": "o_orderstatus"})
ALL_USERS = Fixture("customer", {"id": "c_custkey", "username": "c_name"})
# Some runs of owners nobody knows.
STRAY = Fixture("orders", OWNED.columns | {"user_id": "CASE WHEN o_orderkey % 11 = 0 THEN -1 - o_custkey ELSE o_custkey END"})
TASK_REPORTS = Fixture("lineitem", {"id": "l_orderkey * 10 + l_linenumber", "task_id": "l_orderkey", "user_id": "l_suppkey"})


def owner_enrich(spark, sf):
    return joins.with_owner(STRAY.frame(spark, sf), ALL_USERS.frame(spark, sf)).select("id", "user_id", "username")


def owned_subset(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return joins.owned(OWNED.frame(spark, sf), 7, ids).select("id", "status")


def cascade_delete(spark, sf):
    """Deleting some users and some runs: what is left per table."""
    tables = {"users": ALL_USERS.frame(spark, sf), "runs": OWNED.frame(spark, sf), "reports": TASK_REPORTS.frame(spark, sf)}
    users = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    tasks = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("task_id"))
    left = joins.cascade_delete(tables, users, tasks)
    sized = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("id_sum")) for name, df in left.items()]
    return sized[0].unionByName(sized[1]).unionByName(sized[2])


QUERIES = {f.__name__: f for f in (
    sample_search, distinct_roles, edit_meta, edit_turn_text, delete_items, edit_guard, append_items, append_counts, resume_pending,
    union_checkpoint, checkpoint_dedup, resolve_run_config, rejected_requests, owner_enrich, owned_subset, cascade_delete,
)}

_CKPT_ALL = f"""WITH {_INDEX}, ck AS (SELECT index, turn, CAST(1 AS INTEGER) AS attempt, 'out' || index AS model_output FROM numbered
    UNION ALL SELECT index, turn, CAST(2 AS INTEGER), 'out' || index || 'b' FROM numbered WHERE turn > 3)"""
_CKPT = f"""WITH {_INDEX}, ck AS (SELECT index, CAST(1 AS INTEGER) AS attempt, 'out' || index AS model_output FROM numbered WHERE turn > 1
    UNION ALL SELECT index, CAST(2 AS INTEGER), 'out' || index || 'b' FROM numbered WHERE turn > 3)"""
_MERGED = f"""WITH q AS ({REQUESTS.sql()}), c AS ({CONFIGS.sql()}), j AS (SELECT q.*, c.url, c.api_key AS c_key, c.timeout AS c_timeout, c.max_tokens AS c_tokens, c.temperature AS c_temp, c.top_p AS c_top, c.is_vllm, c.model_name
    FROM q LEFT JOIN c ON q.model = c.model_name)"""
_RENDER = "string_agg('[' || {0} || ']: ' || {1}, chr(10) || chr(10) ORDER BY turn)"
_EDITED = f"""e AS (SELECT s.original_index, s.original_index % 6 AS kind, c.turn, c.role,
    CASE WHEN s.original_index % 6 = 1 AND c.turn = m.last_turn THEN '{REPLY}' ELSE c.text END AS text FROM samples s JOIN conversations c USING (conv_id) JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) m USING (conv_id))"""

ORACLES = {
    "sample_search": f"WITH {_SAMPLES} SELECT conv_id, n_turns FROM samples WHERE conv_id IN (SELECT conv_id FROM conversations WHERE contains(lower(text), lower('{NEEDLE}')))",
    "distinct_roles": f"WITH {_SAMPLES}, p AS (SELECT role, original_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations JOIN samples USING (conv_id)) SELECT role, CAST(min(original_index) AS BIGINT) AS original_index, CAST(arg_min(pos, original_index * 1000 + pos) AS INTEGER) AS pos FROM p GROUP BY role",
    "edit_meta": f"WITH {_SAMPLES} SELECT conv_id, '{META}' AS meta_description, n_turns, '{META}' AS stored_description FROM samples",
    "edit_turn_text": f"SELECT conv_id, {_RENDER.format('role', f'CASE WHEN role = {chr(39)}assistant{chr(39)} THEN {chr(39)}{REPLY}{chr(39)} ELSE text END')} AS transcript, count(*) FILTER (role = 'assistant') AS stored_replies FROM conversations GROUP BY conv_id",
    "delete_items": f"WITH {_SAMPLES} SELECT row_number() OVER (ORDER BY original_index) - 1 AS original_index, conv_id FROM samples WHERE n_turns <= 4",
    "edit_guard": f"""WITH {_SAMPLES}, {_EDITED} SELECT original_index, kind = 1 AS edited,
        CASE kind WHEN 2 THEN 'role changed' WHEN 3 THEN 'turns length changed' WHEN 4 THEN 'structure changed' WHEN 5 THEN 'no allowed change' END AS reason,
        {_RENDER.format('role', 'text')} AS transcript FROM e GROUP BY original_index, kind""",
    "append_items": f"""WITH {_SAMPLES}, n AS (SELECT count(*) AS n FROM samples) SELECT original_index, n_turns, md5((SELECT min_by(text, turn) FROM conversations c WHERE c.conv_id = s.conv_id)) AS first_text FROM samples s
        UNION ALL SELECT (SELECT n FROM n) + row_number() OVER (ORDER BY doc_id) - 1, CAST(1 AS BIGINT), md5(text) FROM documents""",
    "append_counts": "SELECT (SELECT count(*) FROM documents) AS added_count, (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders) AS total_count",
    "resume_pending": f"WITH {_INDEX} SELECT index, conv_id, turn FROM numbered WHERE turn <= 1",
    "union_checkpoint": f"{_CKPT} SELECT index, attempt, model_output FROM ck UNION ALL SELECT index, CAST(0 AS INTEGER), 'new' FROM numbered WHERE turn <= 1",
    "checkpoint_dedup": f"{_CKPT_ALL} SELECT index, max(attempt) AS attempt, max_by(model_output, attempt) AS model_output FROM ck GROUP BY index",
    "resolve_run_config": f"""{_MERGED} SELECT request_id, model, CASE WHEN n_urls > 0 THEN 'http://own' ELSE url END AS urls,
        coalesce(CASE WHEN api_key = 'own' THEN api_key END, nullif(c_key, ''), 'sk-xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx') AS api_key,
        CAST(CASE WHEN max_workers = 0 THEN 4 ELSE max_workers END AS INTEGER) AS max_workers, CASE WHEN badcase_threshold = 0 THEN 1.0::DOUBLE ELSE badcase_threshold END AS badcase_threshold,
        CASE WHEN timeout IN (0, 600) THEN c_timeout ELSE timeout END AS timeout, CASE WHEN max_tokens IN (0, 16384) THEN c_tokens ELSE max_tokens END AS max_tokens,
        CASE WHEN temperature = 0 THEN c_temp ELSE temperature END AS temperature, CAST(CASE WHEN top_p = 0 THEN c_top ELSE top_p END AS DOUBLE) AS top_p, is_vllm FROM j WHERE model_name IS NOT NULL AND data_file <> ''""",
    "rejected_requests": f"{_MERGED} SELECT request_id, model, CASE WHEN data_file = '' THEN 'model, data_file and scoring are required' ELSE 'unknown model' END AS reason FROM j WHERE model_name IS NULL OR data_file = ''",
    "owner_enrich": f"WITH r AS ({STRAY.sql()}), u AS ({ALL_USERS.sql()}) SELECT r.id, r.user_id, u.username FROM r LEFT JOIN u ON r.user_id = u.id",
    "owned_subset": f"WITH r AS ({OWNED.sql()}) SELECT id, status FROM r WHERE user_id = 7 AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "cascade_delete": f"""WITH u AS ({ALL_USERS.sql()}), r AS ({OWNED.sql()}), p AS ({TASK_REPORTS.sql()}), du AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), gone AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM du) OR o_orderpriority = '1-URGENT')
        SELECT 'users' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM u WHERE id NOT IN (SELECT c_custkey FROM du)
        UNION ALL SELECT 'runs', count(*), CAST(sum(id) AS BIGINT) FROM r WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'reports', count(*), CAST(sum(id) AS BIGINT) FROM p WHERE task_id NOT IN (SELECT id FROM gone) AND user_id NOT IN (SELECT c_custkey FROM du)""",
}
