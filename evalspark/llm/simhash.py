"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint is the bitwise majority of its shingle hashes. Candidate fingerprints
meet in buckets of equal bit blocks: with six blocks and at most four differing bits, two blocks
are equal in every true pair, so fifteen block pairs lose no link. Inside a bucket the table of
Hamming distances to fixed reference fingerprints (pivots) discards pairs: by the triangle
inequality a pair whose distances to any one pivot differ by more than the threshold cannot
link. Survivors are verified on the fingerprints themselves. A bucket gives a spanning forest
of its links, never all pairs.

Buckets above ``CHUNK`` distinct fingerprints are cut into chunks and each pair of chunks is a
group of its own, so no task holds more than two chunks at once and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import components, local_roots, map_batches, trimmed, utf8, whole_groups
from evalspark.plans.durable import durable, stored

BITS = 4
SHINGLE = 4
SEED = 42
PIVOTS = 24
CHUNK = 4096
PAIRS = 1 << 18


def simhash(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint. No words, or null: zero. Fewer words than a shingle: one
    shingle of all of them."""
    parts = utf8(text).lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    span = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - span + 1].tolist()
    stops = (ends[span - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        hashes = [xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: Column | str, text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(_row, fp) with the fingerprint of the whole text as a signed long; one row per input
    row. ``_row`` holds ``keep``."""

    def step(batch: pa.RecordBatch) -> dict:
        found = np.array([simhash(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
        return {"_row": batch.column(0), "fp": pa.array(found.view(np.int64))}

    narrow = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    return map_batches(narrow, f"_row {narrow.schema[0].dataType.simpleString()}, fp long", step)


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks of the block groups of which at least one is equal in any pair within ``bits``."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    block = [sum(1 << k for k in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    return [sum(chosen) for chosen in combinations(block, blocks - bits)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..., the same on every run."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(count)], np.uint64)


def link_buckets(keys: np.ndarray, fps: np.ndarray, bits: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (u, v) of linked rows. ``keys`` are group numbers in order; rows compare only
    within their group."""
    distance = np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)
    order = np.lexsort((distance[:, 0], keys))
    keys, fps, distance = keys[order], fps[order], distance[order]
    # Rows of a group lie in order of their distance to the first pivot, so the partners a row
    # can have end where that distance grows by more than the threshold.
    rank = keys.astype(np.int64) * 256 + distance[:, 0]
    stop = np.searchsorted(rank, rank + bits, side="right")
    count = stop - np.arange(len(keys)) - 1
    us, vs = [], []
    total, at = np.cumsum(count), 0
    while at < len(keys):
        base = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        n = count[at:upto]
        u = np.repeat(np.arange(at, upto), n)
        v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        for k in range(1, len(references)):
            near = np.abs(distance[u, k] - distance[v, k]) <= bits
            u, v = u[near], v[near]
        sure = np.bitwise_count(fps[u] ^ fps[v]) <= bits
        us.append(order[u[sure]])
        vs.append(order[v[sure]])
        at = upto
    return np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])


def links(fps: DataFrame, bits: int = BITS, pivot_count: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints of the column ``fp``."""
    masks = block_masks(bits, bits + 2)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("_k")).select("fp", "_k.kind", "_k.key")
    sizes = durable(keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    cuts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), cuts).cast("int")
    met = (
        keyed.join(sizes, ["kind", "key"])
        .select("kind", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
        .select("kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    names = ["kind", "key", "i", "j"]
    references = pivots(pivot_count)

    def run(batches):
        for batch in whole_groups(batches, names):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            change = np.zeros(len(fp), bool)
            for name in names:
                values = batch.column(name).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            u, v = link_buckets(np.cumsum(change), fp, bits, references)
            root = local_roots(len(fp), u, v)
            child = np.flatnonzero(root != np.arange(len(fp)))
            if len(child):
                yield pa.RecordBatch.from_pydict({"a": fp[child].view(np.int64), "b": fp[root[child]].view(np.int64)})

    return met.repartition(*names).sortWithinPartitions(*names).mapInArrow(trimmed(run), "a long, b long")


def fingerprint_classes(marked: DataFrame, id_col: str, bits: int) -> DataFrame:
    """(fp, component) of every fingerprint: the smallest id of the component, stored."""
    classes = durable(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    joined = components(links(classes.select("fp"), bits), "a", "b")
    labelled = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = durable(labelled.groupBy("root").agg(F.min("low").alias("component")))
    return labelled.join(smallest, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = SHINGLE) -> DataFrame:
    """(id, fp, component): the smallest id reachable over links of at most ``bits`` bits.

    Equal texts share a fingerprint and count as linked. Null and empty texts have fingerprint
    zero and link like any other. Rows with a null id keep their row; they join their component
    and get its smallest id, null if it has none. Repeated rows repeat. No input: no rows.
    """
    marked = durable(fingerprints(docs, id_col, text_col=text_col, words=words).select(F.col(f"_row.{id_col}").alias(id_col), "fp"))
    return marked.join(fingerprint_classes(marked, id_col, bits).select("fp", "component"), "fp").select(id_col, "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that of the smallest id. Where
    several rows have that id, or none has an id, any one of them stays."""
    # Fingerprints are taken once. A row is known again by its id and its text's hash and size.
    print_of = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.coalesce(F.octet_length(text_col), F.lit(-1)).alias("_size")]
    marked = stored(fingerprints(docs, *print_of, text_col=text_col, words=words).select("_row.*", "fp"), "fingerprints")
    classes = stored(fingerprint_classes(marked, "_id", bits), "fingerprint-classes")
    first = marked.join(classes, "fp").where(F.col("_id").eqNullSafe(F.col("component"))).select("_id", "_hash", "_size", "root")
    first = stored(first, "fingerprints-kept")
    tied = not first.groupBy("root").count().where("count > 1").isEmpty()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *print_of).alias("d")
    same = F.col("d._id").eqNullSafe(F.col("f._id")) & (F.col("d._hash") == F.col("f._hash")) & (F.col("d._size") == F.col("f._size"))
    kept = rows.join(first.distinct().alias("f") if tied else first.alias("f"), same)
    # Only tables with repeated or missing ids need the texts dealt out once more.
    return (kept.dropDuplicates(["root"]) if tied else kept).select(*[F.col(f"_row.{c}") for c in docs.columns])
