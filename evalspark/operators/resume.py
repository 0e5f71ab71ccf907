"""Resuming an interrupted run from its checkpoint rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.reports import newest_by
from evalspark.plans.bitmaps import whole_number, without


def pending(cases: DataFrame, done: DataFrame, keys: Sequence[str] = ("index",), retry_errors: bool = False) -> DataFrame:
    """Cases whose key is not in the checkpoint yet.

    A single whole-number key, such as the dense ``index``, is looked up in bitmaps, so that no case
    is shuffled. Other keys, and numbers spread too thin for bitmaps, meet in an anti join.
    """
    if retry_errors:
        done = done.where(F.col("error").isNull())
    if len(keys) == 1 and whole_number(cases, keys[0]) and whole_number(done, keys[0]):
        left = without(cases, done, keys[0])
        if left is not None:
            return left
    return cases.join(done.select(*keys), list(keys), "left_anti")


def union_checkpoint(done: DataFrame, new: DataFrame) -> DataFrame:
    return done.unionByName(new, allowMissingColumns=True)


def dedup_by_index(rows: DataFrame, order: Column, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Keep the last row per key.

    Every task keeps one row per key before the shuffle, so a hot key is cheap.
    """
    return newest_by(rows, keys, order.desc())


def resume(cases: DataFrame, done: DataFrame, order: Column, keys: Sequence[str] = ("index",)) -> tuple[DataFrame, DataFrame]:
    """(cases still to run, checkpoint rows without repeats)."""
    return pending(cases, done, keys), dedup_by_index(done, order, keys)
