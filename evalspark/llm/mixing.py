"""Mixing sources to target weights with packed blocks.

Each source's words are packed, text after text, into blocks of ``block`` words. A target says
how many words of a source the mix takes, which makes so many slots. Every output shard draws
how many of its slots each source gets: a multinomial draw by the slots that are left, settled to
them, so that over all shards targets are met and no block is used more often than they ask. The slots of a source are numbered through the shards; a keyed
permutation of the block numbers, one per pass over the source, says which block fills a slot.
Slots and blocks then meet in a join on (source, block).

The driver holds one row per source, and up to shards x sources counts. How many sources there are
comes from the data and is not bounded here, so they must be few: a column of hosts or urls is no
source. Slots are cut into ranges of ``RANGE`` before they become rows, so a source may have any
number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_batches
from evalspark.plans.durable import durable, stored
from evalspark.plans.numbering import number_rows

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SHARDS = 64
SEED = 20
RANGE = 1 << 20  # slots listed by one row


def word_count(text: Column) -> Column:
    """Words between blanks (20, 09-0D); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source, in the given order. ``weights`` repeat. A target stops at
    ``most`` times its source; what is over goes to the others by weight until none is above."""
    own = np.array([weights[k % len(weights)] for k in range(len(sizes))])
    size = np.array(sizes, float)
    limit = most * size
    out = np.zeros(len(size))
    open_ = np.ones(len(size), bool)
    left = share * size.sum()
    while open_.any():
        part = left * own / own[open_].sum()
        over = open_ & (part > limit)
        if not over.any():
            out[open_] = part[open_]
            break
        out[over] = limit[over]
        left -= limit[over].sum()
        open_ &= ~over
    return out.tolist()


def permuted(number: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0 .. size-1 at ``number``: a four-round Feistel
    network on the next even power of two, walked until it lands below ``size``."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = number.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        at = np.flatnonzero(todo)
        left, right = out[at] >> half[at], out[at] & low[at]
        for turn in range(4):
            f = (right + key[at] + np.uint64(turn * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & low[at])
        out[at] = (left << half[at]) | right
        todo[at] = out[at] >= size[at].astype(np.uint64)
    return out.astype(np.int64)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, _source, _size, _n, _start) of every row: its number, and the words before it, in
    the order of sources, inside them mixed by a hash. Only these narrow columns are sorted."""
    narrow = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"),
        F.col(source_col).isNull().alias("_none"), F.xxhash64(id_col, text_col).alias("_mixed"),
    )
    # Stored first: numbering reads its input more than once, the texts are counted once.
    numbered = number_rows(stored(narrow, "sizes"), ["_none", "_source", "_mixed", "_id", "_size"], out="_n", weight="_size", weight_out="_start")
    return durable(numbered.select("_id", "_source", "_size", "_n", "_start"))


def plan(numbered: DataFrame, weights: Sequence[float], share: float, most: float) -> list[dict]:
    """Per source, in code point order and null last: its size, target, first word and slots."""
    rows = sorted(((r["_source"], r["size"]) for r in numbered.groupBy("_source").agg(F.sum("_size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    out, begin = [], 0
    for (source, size), target in zip(rows, targets([r[1] for r in rows], weights, share, most)):
        out.append({"source": source, "size": size, "target": target, "begin": begin})
        begin += size
    return out


def pieces(numbered: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(sid, block, _n, _id, first, words): which words of a row lie in which block of its
    source. Rows without words have no piece."""
    own = numbered.where("_size > 0").join(sources, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_from", F.col("_start") - F.col("begin"))
    cut = own.select("*", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("_size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("_from"), F.col("block") * block)
    hi = F.least(F.col("_from") + F.col("_size"), (F.col("block") + 1) * block)
    return cut.select("sid", "block", "_n", "_id", (lo - F.col("_from")).alias("first"), (hi - lo).alias("words"))


def draw(counts: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Slots per shard and source; columns sum to ``counts``, rows are as even as they can be."""
    left = np.array(counts, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    rng = np.random.default_rng(seed)
    for shard in range(shards):
        size = -(-int(left.sum()) // (shards - shard))
        if size:
            out[shard] = settled(rng.multinomial(size, left / left.sum()), left, size)
        left -= out[shard]
    return out


def settled(part: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """A draw cut to the slots that are left, its lack given to the sources with most of them."""
    part = np.minimum(part, left)
    order = np.argsort(-(left - part), kind="stable")
    spare = (left - part)[order]
    upto = np.minimum(np.cumsum(spare), size - part.sum())
    part[order] += np.diff(upto, prepend=0)
    return part


def mixture(numbered: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[list[dict], DataFrame]:
    """The plan per source, and the mix: (shard, slot, sid, block, _n, _id, first, words), a row
    per piece of a row of ``numbered`` (from ``sized``) in a slot."""
    spark = numbered.sparkSession
    sources = plan(numbered, weights, share, most)
    for sid, s in enumerate(sources):
        s["sid"], s["blocks"] = sid, -(-s["size"] // block)
        mean = s["size"] / s["blocks"] if s["blocks"] else 1
        s["slots"] = min(round(s["target"] / mean), int(most) * s["blocks"]) if s["blocks"] else 0
    drawn = draw([s["slots"] for s in sources], shards, seed)
    before = np.cumsum(drawn, axis=0) - drawn
    across = np.cumsum(drawn, axis=1) - drawn
    rows = [(h, s["sid"], s["blocks"], int(before[h, k]), int(drawn[h, k]), int(across[h, k])) for h in range(shards) for k, s in enumerate(sources) if drawn[h, k]]
    counts = spark.createDataFrame(rows, "shard int, sid int, blocks long, number long, n long, at long")
    ranges = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long"))).alias("_lo")).repartition(shards, "shard", "sid", "_lo")
    listed = F.explode(F.sequence(F.col("_lo"), F.least(F.col("n"), F.col("_lo") + RANGE) - 1)).alias("k")
    slots = ranges.select("shard", "sid", "blocks", "number", "at", listed).select("shard", "sid", "blocks", (F.col("number") + F.col("k")).alias("number"), (F.col("at") + F.col("k")).alias("slot"))

    def step(batch: pa.RecordBatch) -> dict:
        sid, size, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("sid", "blocks", "number"))
        turn = number // size
        pairs, which = np.unique(np.stack([sid, turn], axis=1), axis=0, return_inverse=True)
        keys = np.array([xxhash.xxh64_intdigest(b"%d %d" % (a, b), seed) for a, b in pairs.tolist()], np.uint64)
        return {"shard": batch.column("shard"), "slot": batch.column("slot"), "sid": batch.column("sid"), "block": permuted(number % size, size, keys[which.ravel()])}

    filled = map_batches(slots, "shard int, slot long, sid int, block long", step)
    named = spark.createDataFrame([(s["source"], s["sid"], s["begin"]) for s in sources], "source string, sid int, begin long")
    # The planner sizes the slots by the few rows they are made from; without the hint it would
    # broadcast them all.
    return sources, filled.hint("merge").join(pieces(numbered, named, block), ["sid", "block"])


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id, source, size, source_size, target, taken) per input row: how many of its words are in the
    mix, repeats counted.

    Null and blank texts have size 0 and give nothing. Null is a source of its own, the last.
    Equal rows, and rows with a null id, are packed like any other; every row is told apart by
    its number. Texts and ids alone decide the order, so runs agree. No input: no rows.
    """
    numbered = sized(docs, id_col, text_col, source_col)
    sources, mix = mixture(numbered, **how)
    used = durable(mix.groupBy("_n").agg(F.sum("words").alias("taken")))
    named = numbered.sparkSession.createDataFrame([(s["source"], s["size"], s["target"]) for s in sources], "name string, source_size long, target double")
    return (
        numbered.join(named, F.col("_source").eqNullSafe(F.col("name")))
        .join(used, "_n", "left")
        .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
