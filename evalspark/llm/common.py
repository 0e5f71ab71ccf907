"""Shared helpers: reading tables, Arrow batches, local and distributed components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.plans.durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` with a function from one batch to a dict of output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch))

    return df.mapInArrow(trimmed(run), schema)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving freed memory back at the end of its task: workers are
    kept for later tasks, and several of them share a machine with the executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return whole


def row_and_text(docs: DataFrame, keep: Sequence[str], text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """A frame with ``_row``, the struct of the columns ``keep``, and how to get the texts from its
    batches: from the struct where it holds them, so that they travel once, else from ``_text``."""
    row = F.struct(*keep).alias("_row")
    if text_col in keep:
        at = list(keep).index(text_col)
        return docs.select(row), lambda batch: batch.column(0).field(at)
    return docs.select(row, F.col(text_col).alias("_text")), lambda batch: batch.column(1)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Re-cut batches sorted by ``keys`` so that no group is split between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for name in keys:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            if held and values[0] != held[-1].column(name)[-1].as_py():
                change[0] = True
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        ready = [*held, *([batch.slice(0, last)] if last else [])]
        if ready:
            yield pa.concat_batches(ready)
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable node for each of ``n`` nodes under the edges ``u[i] - v[i]``."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            break
        u, v = u[differ], v[differ]
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: one row (node, root) for every node that is
    not itself the smallest of its component.

    Alternates large-star and small-star steps until nothing changes. Minima are partial
    aggregates and hubs meet their minimum in a join, which adaptive execution splits, so one
    node may carry any share of the edges. The minima are stored before they are joined: a join
    right on top of an aggregate keeps its partitioning, which cannot be split. Null ends and
    self loops are ignored.
    """
    now = durable(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
        .distinct()
    )
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select("root", "node"))
        low = durable(both.groupBy("node").agg(F.min("root").alias("low")).select(F.col("node").alias("_n"), F.least("node", "low").alias("_low")))
        large = (
            both.where(F.col("root") > F.col("node"))
            .join(low, F.col("node") == F.col("_n"))
            .select(F.col("root").alias("node"), F.col("_low").alias("root"))
            .distinct()
        )
        large = durable(large)
        least = durable(large.groupBy("node").agg(F.min("root").alias("_low")))
        small = (
            large.join(least.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
            .where(F.col("root") != F.col("_low"))
            .select(F.col("root").alias("node"), F.col("_low").alias("root"))
            .union(least.select("node", "_low"))
            .distinct()
        )
        now = durable(small)
        then, seen = seen, _digest(now)
        if then == seen:
            break
    return now


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def lower_az(column: Column) -> Column:
    """Lower-case A-Z only, unlike ``lower``."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
