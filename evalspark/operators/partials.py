"""Summaries that new rows are added to, without reading old results again.

A partial holds counts and sums per run (and day, or whatever ``by`` names); partials of disjoint rows
add up. Each append writes the partials of its own rows, a few per run, into a folded
table; a summary reads those alone. Means are sums over counts, so they equal the means of one pass
but for the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.summary import ROUGE_KEYS, carries_rouge
from evalspark.plans.folded import FoldedTable


def result_measures(results: DataFrame) -> dict[str, Column]:
    """Counts and sums behind ``run_summary``."""
    found = {
        "total": F.count(F.lit(1)), "good": F.count_if(F.col("is_badcase") == 0), "bad": F.count_if(F.col("is_badcase") == 1),
        "score_sum": F.sum("score"), "score_n": F.count("score"),
    }
    timed = "inference_time" in results.columns
    found["time_sum"] = F.sum("inference_time") if timed else F.sum(F.lit(0.0))
    found["time_n"] = F.count("inference_time") if timed else F.sum(F.lit(0).cast("long"))
    rouge = carries_rouge(results)
    for key in ROUGE_KEYS:
        found[f"{key}_sum"] = F.sum(f"details.{key}") if rouge else F.sum(F.lit(0.0))
        found[f"{key}_n"] = F.count(f"details.{key}") if rouge else F.sum(F.lit(0).cast("long"))
    return found


def report_measures(reports: DataFrame) -> dict[str, Column]:
    """Counts and sums behind ``accuracy_trend`` and ``avg_accuracy``."""
    return {"reports": F.count(F.lit(1)), "accuracy_sum": F.sum("accuracy"), "accuracy_n": F.count("accuracy")}


def _added(by: Sequence[str], names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])


class RunningSummary:
    """Partials of appended rows below ``path``. ``measures`` names the counts and sums of a frame;
    ``rows`` is a frame of the kind that will come (it is not read)."""

    def __init__(self, spark: SparkSession, path: str, rows: DataFrame, by: Sequence[str], measures: Callable[[DataFrame], dict[str, Column]] = result_measures, every: int = 16):
        self.by, self.measures, self.names = list(by), measures, list(measures(rows))
        self.table = FoldedTable(spark, path, self._partials(rows).schema, _added(self.by, self.names), every)

    def _partials(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.by).agg(*[c.alias(n) for n, c in self.measures(rows).items()])

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add rows that no other batch holds. Numbers of batches grow; a batch given again, after
        a failure say, replaces itself."""
        self.table.write(self._partials(rows), batch)

    def partials(self, by: Sequence[str] | None = None) -> DataFrame:
        """Counts and sums so far, by the store's keys or some of them."""
        kept = self.by if by is None else list(by)
        return _added(kept, self.names)(self.table.read())


def _mean(name: str) -> Column:
    return F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n"))


def summary_of(partials: DataFrame) -> DataFrame:
    """``run_summary`` of the rows behind ``partials``, with their keys."""
    keys = [c for c in partials.columns if c not in {"total", "good", "bad", *[f"{m}_{k}" for m in ("score", "time", *ROUGE_KEYS) for k in ("sum", "n")]}]
    means = F.create_map(*[x for k in ROUGE_KEYS for x in (F.lit(k), _mean(k))])
    return partials.where("total > 0").select(
        *keys, F.col("total").alias("total_count"), F.col("good").alias("correct_count"), (F.col("good") / F.col("total")).alias("accuracy"),
        F.coalesce(_mean("score"), F.lit(0.0)).alias("average_score"), F.coalesce(_mean("time"), F.lit(0.0)).alias("average_inference_time"),
        F.map_filter(means, lambda _, v: v.isNotNull()).alias("rouge_scores"), F.col("bad").alias("badcase_count"),
    )


def trend_of(partials: DataFrame) -> DataFrame:
    """Mean accuracy and report count of the reports behind ``partials``."""
    keys = [c for c in partials.columns if c not in ("reports", "accuracy_sum", "accuracy_n")]
    return partials.select(*keys, _mean("accuracy").alias("accuracy"), "reports")
