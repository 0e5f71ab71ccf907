"""Incremental scoring and sliding admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.plans.durable import fresh_path
from evalspark.plans.folded import FoldedTable, newest_per
from evalspark.streaming import admission, incremental
from evalspark.workload.fixtures import BOXED, UPDATES, table
from evalspark.workload.score_queries import _BOX_PAIR, _bad

WINDOW, ACCEPTED = "2 days", 10
PARTS = 6  # files, and so batches, of the live run state


def _stream(spark, sf, name):
    # As a pattern the path may be one file or a folder of files; a plain one must be a folder.
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name[:-1]}[{name[-1]}].parquet")


def stream_scoring(spark, sf):
    """Stream the conversations through a scorer to a table; equals the batch result."""
    source = _stream(spark, sf, "conversations")
    # The time of arrival: nothing is late, and a key's state expires an hour after it came.
    rows = BOXED.project(source).withColumn("ts", F.current_timestamp())
    path = fresh_path(spark, "stream")
    query = incremental.start_scoring(rows, "exact_match", f"{path}/out", f"{path}/state", "1 hour", keys=["conv_id", "turn"])
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("conv_id", "turn", "score", "is_badcase")


def task_state_live(spark, sf):
    """Stream the updates in several batches into a folded table; the final state equals the batch form."""
    path = fresh_path(spark, "state")
    table(spark, sf, "events").repartition(PARTS).write.parquet(f"{path}/in")
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    state = incremental.task_state_stream(UPDATES.project(source))
    live = FoldedTable(spark, f"{path}/out", state.schema, newest_per("task_id"), every=4)
    query = state.writeStream.outputMode("update").foreachBatch(live.write).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return live.read().select("task_id", "status", "current", "message")


def sliding_admission(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return admission.sliding_admission(events, "user_id", "ts", WINDOW, ACCEPTED).select("event_id", "user_id", "accepted")


def sliding_admission_stream(spark, sf):
    """The streaming form over all events; equals the batch form."""
    path = fresh_path(spark, "admission")
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{path}/in")
    # A last event far behind all others lets the watermark pass them.
    closing = events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    closing.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    verdicts = admission.sliding_admission_stream(stream, "user_id", "ts", WINDOW, ACCEPTED, late="1 minute")
    query = verdicts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").where("event_id >= 0").select("event_id", "user_id", "accepted")


QUERIES = {f.__name__: f for f in (stream_scoring, task_state_live, sliding_admission, sliding_admission_stream)}

ORACLES = {
    "stream_scoring": f"WITH fx AS ({BOXED.sql()}), {_BOX_PAIR} SELECT conv_id, turn, score, {_bad('score', 'false', 1.0)} AS is_badcase FROM s",
    "task_state_live": f"""WITH fx AS ({UPDATES.sql()}), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM fx)
        SELECT task_id, arg_max(status, rn) AS status, arg_max(current, rn) AS current, arg_max(message, rn) FILTER (message IS NOT NULL) AS message FROM n GROUP BY task_id""",
    "sliding_admission": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        w AS (SELECT event_id, user_id, rn, true AS accepted, [us] AS kept FROM e WHERE rn = 1
        UNION ALL SELECT e.event_id, e.user_id, e.rn, len(k.kept) < {ACCEPTED}, CASE WHEN len(k.kept) < {ACCEPTED} THEN list_append(k.kept, e.us) ELSE k.kept END
        FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1, LATERAL (SELECT list_filter(w.kept, lambda t: e.us - t < 2 * 86400000000) AS kept) k)
        SELECT event_id, user_id, accepted FROM w""",
}
ORACLES["sliding_admission_stream"] = ORACLES["sliding_admission"]
