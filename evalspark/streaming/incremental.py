"""Incremental scoring and live run state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.scoring import score


def score_stream(stream: DataFrame, scorer: str, late: str, threshold: float = 1.0, keys: Sequence[str] = ("run_id", "index"),
                 time: str = "ts") -> DataFrame:
    """Score outputs as they arrive; a key repeated within the watermark is scored once.

    The same scorers as in batch. State is one entry per key and expires with the watermark.
    ``late`` is the caller's choice: rows that much behind the newest are not scored, and
    :func:`unscored` finds them.
    """
    unique = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return score(unique, scorer, threshold)


def unscored(source: DataFrame, scored: DataFrame, keys: Sequence[str] = ("run_id", "index")) -> DataFrame:
    """Rows of the source, read as a table, whose key was never scored: those that came too late."""
    return source.join(scored.select(*keys), list(keys), "left_anti")


def start_scoring(stream: DataFrame, scorer: str, path: str, checkpoint: str, late: str, threshold: float = 1.0,
                  keys: Sequence[str] = ("run_id", "index"), time: str = "ts", available_now: bool = True) -> StreamingQuery:
    """Score to a Parquet folder; restarts continue from ``checkpoint``."""
    scored = score_stream(stream, scorer, late, threshold, keys, time)
    writer = scored.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def task_state_stream(stream: DataFrame, key: str = "task_id", order: Sequence[str] = ("ts", "event_id"),
                      fields: Sequence[str] = ("status", "current", "message")) -> DataFrame:
    """Newest value of every field per task, for update or complete mode.

    ``max_by`` ignores stale updates, so late rows need no watermark; state is one row per task.
    """
    from evalspark.operators.reports import task_state

    return task_state(stream, key, order, fields)
