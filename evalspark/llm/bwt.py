"""Removing repeated byte strings by merging Burrows-Wheeler transforms.

Whole-text transforms of a corpus cannot be refined 400 times within the limits, so the merge
runs where repeats are decided. ``repeats`` reduces the corpus to runs of windows that share an
anchor with another run; copies among them need no merge. What is left are branchings: the
suffixes that start at equal anchors in different surroundings. Each Spark task is a shard that
sends its anchored suffixes together with the bytes before them, the columns of its transform.
The shards of one anchor are interleaved in one order, which is refined column by column: a
step parts every interval by the next byte and never looks at bytes before it again. The step
at which two suffixes part is their common prefix. Walking the same way through the bytes
before the anchor extends an interval to the left, so the intervals that still hold two
suffixes after d steps left and W - d steps right are the repeated strings of W bytes.

An anchor with more than ``MERGE`` different surroundings is counted window by window instead,
in partial aggregates, so no task holds an unbounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import whole_groups
from evalspark.llm.repeats import Repeats, compare_windows

WINDOW = 400
GRAM = 100
MERGE = 2_000


def refine(interval: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Part every interval by one more byte; -1 in ``column`` stands for no byte there."""
    return np.unique(interval * 257 + column + 1, return_inverse=True)[1].astype(np.int64)


def column_at(buffer: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    there = (place >= lo) & (place < hi)
    return np.where(there, buffer[np.clip(place, 0, len(buffer) - 1)].astype(np.int64), -1)


def merge_shards(group: np.ndarray, spans: list[bytes], off: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Repeated windows among anchored suffixes: a matrix [row, d] for windows that start d
    bytes before the anchor. ``group`` numbers the anchors; ``off`` is the anchor's place in its
    span and ``n`` the number of windows, the first at the span's start."""
    buffer = np.frombuffer(b"".join(spans), np.uint8)
    length = np.fromiter(map(len, spans), np.int64, len(spans))
    hi = np.cumsum(length)
    lo = hi - length
    anchor = lo + off
    nearest, farthest = off - n + 1, off  # d of the last and the first window
    reach = int(farthest.max()) + 1
    left = np.empty((reach, len(spans)), np.int32)  # interval after d steps to the left
    interval = np.unique(group, return_inverse=True)[1].astype(np.int64)
    left[0] = interval
    for d in range(1, reach):
        interval = refine(interval, column_at(buffer, anchor - d, lo, hi))
        left[d] = interval
    out = np.zeros((len(spans), reach), bool)
    live = np.arange(len(spans))
    interval = left[0].astype(np.int64)
    for depth in range(window):
        interval = refine(interval, column_at(buffer, anchor[live] + depth, lo[live], hi[live]))
        many = np.bincount(interval)[interval] > 1
        live, interval = live[many], interval[many]
        d = window - depth - 1
        if not len(live):
            break
        if d < reach:
            inside = np.flatnonzero((nearest[live] <= d) & (d <= farthest[live]))
            _, at, count = np.unique(interval[inside] * (len(spans) + 1) + left[d][live[inside]], return_inverse=True, return_counts=True)
            out[live[inside[count[at] > 1]], d] = True
    return out


def merge_branches(repeats: Repeats, classes: DataFrame, most: int = MERGE) -> DataFrame:
    anchors = repeats.branchings(classes)
    window = repeats.window

    def run(batches):
        for batch in whole_groups(batches, ["mkey"]):
            off, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("off", "n"))
            found = merge_shards(batch.column("mkey").to_numpy(), batch.column("span").to_pylist(), off, n, window)
            row = np.flatnonzero(found.any(axis=1) & (batch.column("total").to_numpy() == 1))
            if len(row):
                ks = [(off[r] - np.flatnonzero(found[r])).astype(np.int32) for r in row]
                yield pa.RecordBatch.from_pydict({"mkey": batch.column("mkey").take(pa.array(row)), "fkey": batch.column("fkey").take(pa.array(row)), "ks": pa.array(ks, pa.list_(pa.int32()))})

    columns = ("mkey", "fkey", "total", "off", "n", "span")
    arrow = pa.schema([(c, pa.binary() if c == "span" else pa.int64()) for c in columns])

    def shard(kinds: list[dict]):
        yield pa.RecordBatch.from_pydict({c: [r[c] for r in kinds] for c in columns}, schema=arrow)

    schema = ", ".join(f"{c} {'binary' if c == 'span' else 'long'}" for c in columns)
    shards = repeats.kinds(classes, anchors.where(F.col("kinds") <= most), shard, schema)
    found = shards.repartition("mkey").sortWithinPartitions("mkey").mapInArrow(run, "mkey long, fkey long, ks array<int>")
    crowded = anchors.where(F.col("kinds") > most)
    return found if crowded.isEmpty() else found.union(compare_windows(repeats, classes, crowded).select("mkey", "fkey", "ks"))


def drop_repeats(docs: DataFrame, *keep: str, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MERGE) -> DataFrame:
    """(_row, n_units, n_removed, kept, spans) per input row: the bytes that stay after every
    byte of a ``window``-byte string that also starts elsewhere is gone.

    ``_row`` holds the columns ``keep``. Null is the empty text. Texts shorter than the window
    lose nothing; of repeated rows all lose everything from that length on. Strings are judged
    on the input and may overlap. Kept bytes may start or end inside a UTF-8 character.
    """
    return Repeats(docs, text_col, window, gram, words=False).cut(lambda r, c: merge_branches(r, c, most), *keep)
