"""Scorer registry, the scoring wrapper and the bad-case threshold."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.staged import Stages


@dataclass(frozen=True)
class Case:
    """Columns a scorer may read; ``let`` names an expression that is used more than once."""

    user_input: Column
    model_output: Column
    reference_output: Column
    verdict: Column
    detected_lang: Column
    error: Column
    let: Stages


@dataclass(frozen=True)
class Scorer:
    name: str
    description: str
    build: Callable


_REGISTRY: dict[str, Scorer] = {}


def outcome(score: Column, is_badcase: Column, details: Column, error: Column | None = None) -> Column:
    """What a scorer returns: one struct per row."""
    return F.struct(
        score.cast("double").alias("score"),
        is_badcase.cast("int").alias("is_badcase"),
        details.alias("details"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    )


def bad_unless(ok: Column) -> Column:
    return F.when(ok, 0).otherwise(1)


def register_scorer(name: str, description: str = "") -> Callable:
    """Decorator for a scorer: a function from a :class:`Case` to an :func:`outcome` column."""

    def add(build: Callable) -> Callable:
        _REGISTRY[name] = Scorer(name, description or (build.__doc__ or "").strip().split("\n")[0], build)
        return build

    return add


NO_RESULT = "scorer returned no result"


def register_python_scorer(name: str, fn: Callable[[list[dict], str, str], dict], description: str = "") -> None:
    """Register a plain Python function as an Arrow-batched scorer.

    ``fn(messages, model_output, reference_output)`` returns a dict with ``score``,
    ``is_badcase`` and ``details`` (any JSON value), each optional. ``messages`` is the prompt as
    ``{role, content}`` dicts. A row on which it raises, or returns neither score nor verdict,
    becomes an error row; the others are not touched. Rows that failed before, or miss a text,
    are not passed to it. ``details`` come back as JSON text.
    """

    def one(messages, output, reference) -> tuple:
        if output is None or reference is None:
            return None, None, None, None
        try:
            turns = [{"role": m["role"], "content": m["content"]} for m in messages] if messages is not None else []
            got = fn(turns, output, reference) or {}
            value, bad, details = got.get("score"), got.get("is_badcase"), got.get("details")
            return (
                None if value is None else float(value), None if bad is None else int(bad),
                None if details is None else json.dumps(details, ensure_ascii=False), None,
            )
        except Exception as caught:  # foreign code: only this row fails
            return None, None, None, str(caught) or type(caught).__name__

    def run(messages: pd.Series, output: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = [one(*r) for r in zip(messages, output, reference)]
        frame = pd.DataFrame(rows, columns=["score", "is_badcase", "details", "error"], dtype=object)
        return frame.astype({"score": "float64", "is_badcase": "Int32"})

    @register_scorer(name, description)
    def build(case: Case) -> Column:
        fit = F.when(case.error.isNull(), case.model_output)
        # Made here, not above: an executor that imports a module of scorers registers them too.
        batched = F.pandas_udf(run, "score double, is_badcase int, details string, error string")
        got = case.let(batched(case.user_input, fit, case.reference_output))
        return outcome(F.nanvl(got["score"], F.lit(None).cast("double")), got["is_badcase"], got["details"], got["error"])


def get_scorer(name: str) -> Scorer:
    if name not in _REGISTRY:
        raise ValueError(f"scorer {name!r} is not registered")
    return _REGISTRY[name]


def registered() -> dict[str, Scorer]:
    return dict(_REGISTRY)


def restore(scorers: dict[str, Scorer]) -> None:
    """Go back to an earlier state of the registry."""
    _REGISTRY.clear()
    _REGISTRY.update(scorers)


def list_scorers(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.description) for s in sorted(_REGISTRY.values(), key=lambda s: s.name)]
    return spark.createDataFrame(rows, "name string, description string")


def score(df: DataFrame, name: str, threshold: float = 1.0) -> DataFrame:
    """Add ``score, is_badcase, details, error``; a narrow map for every scorer.

    A row whose generation failed (``error`` set, or no output) is bad and has no score.
    """
    scorer = get_scorer(name)
    optional = {
        c: F.col(c) if c in df.columns else F.lit(None).cast(t)
        for c, t in (
            ("user_input", "array<struct<role:string,content:string>>"), ("verdict", "string"), ("detected_lang", "string"), ("error", "string"),
        )
    }
    let = Stages.for_frame(df)
    built = scorer.build(Case(model_output=F.col("model_output"), reference_output=F.col("reference_output"), let=let, **optional))
    return apply_threshold(let.add_to(df).withColumn("_outcome", built).drop(*let.names), threshold)


def apply_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Resolve ``_outcome``: bad if the scorer says so, or the score is below the threshold, or it
    failed. A scorer that gives neither a score nor a verdict has failed."""
    failed = F.when(F.col("model_output").isNull(), "missing model_output").when(
        F.col("reference_output").isNull(), "missing reference_output"
    )
    if "error" in scored.columns:
        failed = F.coalesce(F.col("error"), failed)
    got = F.col("_outcome")
    silent = F.when(got["score"].isNull() & got["is_badcase"].isNull(), NO_RESULT)
    error = F.coalesce(failed, got["error"], silent)
    kept = [c for c in scored.columns if c not in ("_outcome", "error", "score", "is_badcase", "details")]
    with_error = scored.withColumn("_error", error)
    error = F.col("_error")
    return with_error.select(
        *kept,
        F.when(error.isNull(), got["score"]).alias("score"),
        F.when(error.isNotNull() | (got["is_badcase"] == 1) | (got["score"] < threshold), 1).otherwise(0).alias("is_badcase"),
        F.when(error.isNull(), got["details"]).alias("details"),
        error.alias("error"),
    )


from evalspark.operators import scorers  # noqa: E402,F401  (registers the built-ins)
