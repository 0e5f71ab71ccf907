"""Exploding computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, array: Column, pos: str, item: str, *keep: Column | str) -> DataFrame:
    """``posexplode`` of a costly array expression, evaluating it once.

    For a plain explode the optimizer adds a filter ``size(array) > 0`` below the
    generator, which repeats the expression. The outer form has no such filter; rows of
    empty arrays are dropped afterwards.
    """
    exploded = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return exploded.where(F.col(pos).isNotNull())
