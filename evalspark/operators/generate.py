"""Model call hook: a caller-supplied function applied to case partitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from evalspark.operators.resume import dedup_by_index, pending
from evalspark.plans.durable import durable
from evalspark.sources.checkpoints import append_as_tasks_end, load_checkpoint


class PermanentError(Exception):
    """Raised by a model function for a request that a retry cannot fix."""


def generate(
    cases: DataFrame,
    fn: Callable[..., str],
    keys: Sequence[str] = ("index",),
    retries: int = 3,
    backoff: float = 1.0,
    store: bool = True,
    concurrency: int = 1,
    endpoint: str | None = None,
) -> DataFrame:
    """(keys, model_output, inference_time, error) for every case.

    ``fn`` gets the prompt as a list of ``{role, content}``, and with ``endpoint`` the value of
    that column (see ``assign_endpoint``) as second argument. Each task keeps ``concurrency``
    calls in flight; rows come out in their order, whichever call ends first. Failures are retried with
    doubling pauses; the last failure is kept as error text, never raised. With
    ``store`` the outputs are written to the checkpoint folder first, so a lost executor
    or a second action does not call the model again.
    """
    target = F.col(endpoint) if endpoint else F.lit(None)
    prompts = cases.select(*keys, F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), target.cast("string").alias("_endpoint"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*keys).schema)

    def call(prompt, url) -> tuple[str | None, str | None, float]:
        messages = [{"role": m["role"], "content": m["content"]} for m in prompt]
        started = time.monotonic()
        problem = None
        for attempt in range(retries):
            try:
                return (fn(messages, url) if endpoint else fn(messages)), None, time.monotonic() - started
            except PermanentError as caught:
                problem = str(caught)
                break
            except Exception as caught:  # the hook is foreign code
                problem = str(caught)
                if attempt + 1 < retries:
                    time.sleep(backoff * 2**attempt)
        return None, problem or "model call failed", time.monotonic() - started

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                answers = list(pool.map(call, batch["prompt"], batch["_endpoint"]))
                out = batch[list(keys)].copy()
                out["model_output"] = [a[0] for a in answers]
                out["inference_time"] = [a[2] for a in answers]
                out["error"] = [a[1] for a in answers]
                yield out

    answered = prompts.mapInPandas(run, f"{key_schema}, model_output string, inference_time double, error string")
    return durable(answered) if store else answered


def generate_resumable(
    cases: DataFrame,
    fn: Callable[..., str],
    path: str,
    keys: Sequence[str] = ("index",),
    interval: int = 1000,
    retry_errors: bool = False,
    **how,
) -> DataFrame:
    """``generate`` with answers that are durable after about every ``interval`` calls of a task.

    Cases without an answer below ``path`` are dealt by key into tasks of about ``interval`` rows,
    and every task commits its own rows (``append_as_tasks_end``). A run that dies loses only the
    calls of tasks that had not ended; calling this again makes those, and no committed call twice.
    Failed calls are answers too, unless ``retry_errors`` has them asked again; the newer answer
    counts then. ``how`` goes to ``generate``. ``path`` takes one run at a time.
    """
    spark = cases.sparkSession
    found = load_checkpoint(spark, path, _answer_schema(cases, keys))
    newest = dedup_by_index(found, F.col("run"), keys)
    left = pending(cases, newest, keys, retry_errors)
    size = left.count()
    if size:
        run = found.agg(F.coalesce(F.max("run"), F.lit(-1)) + 1).first()[0]
        dealt = left.repartition(-(-size // interval), *keys)
        answers = generate(dealt, fn, keys, store=False, **how).withColumn("run", F.lit(run).cast("long"))
        append_as_tasks_end(answers, path)
    return load_answers(spark, path, cases, keys)


def load_answers(spark: SparkSession, path: str, cases: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """The answers committed so far, one per key, also while a run is going on."""
    found = load_checkpoint(spark, path, _answer_schema(cases, keys))
    return dedup_by_index(found, F.col("run"), keys).drop("run")


def _answer_schema(cases: DataFrame, keys: Sequence[str]) -> StructType:
    schema = StructType()
    for k in keys:
        schema = schema.add(k, cases.schema[k].dataType)
    return schema.add("model_output", StringType()).add("inference_time", DoubleType()).add("error", StringType()).add("run", LongType())
