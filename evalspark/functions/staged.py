"""Evaluate a shared sub-expression once.

A Column is a tree: using one expression in five places copies it five times. ``Stages``
turns it into a named column of an earlier projection instead. The optimizer merges a
stage back only where it is used once or costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(expr: Column, body: Callable[[Column], Column]) -> Column:
    """``body(expr)`` with ``expr`` evaluated once, for use inside one expression."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


class Stages:
    """Collects named expressions; each goes one projection above the stages it mentions."""

    def __init__(self, prefix: str = "_let"):
        self._prefix = prefix
        self._levels: list[dict[str, Column]] = []
        self._level_of: dict[str, int] = {}

    @classmethod
    def for_frame(cls, df: DataFrame) -> Stages:
        """Stages whose names no column of ``df`` has."""
        prefix = "_let"
        while any(c.startswith(prefix) for c in df.columns):
            prefix = "_" + prefix
        return cls(prefix)

    def __call__(self, expr: Column) -> Column:
        mentioned = re.findall(rf"{self._prefix}[0-9]+", str(expr))
        level = max((self._level_of[m] + 1 for m in mentioned), default=0)
        name = f"{self._prefix}{len(self._level_of)}"
        if level == len(self._levels):
            self._levels.append({})
        self._levels[level][name] = expr
        self._level_of[name] = level
        return F.col(name)

    def add_to(self, df: DataFrame) -> DataFrame:
        for level in self._levels:
            df = df.withColumns(level)
        return df

    @property
    def names(self) -> list[str]:
        return list(self._level_of)
