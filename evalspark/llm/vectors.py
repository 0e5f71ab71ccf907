"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors close to each
other see nearly the same pivots first, so each pivot keeps an inverted list of the vectors that
rank it among their first ``PREFIX``, and two vectors are candidates if they share at least
``SHARED`` of those. Candidates are verified by their cosine in double precision, so no link is
wrong; links are missed only where the prefixes differ too much (see the README for the
measured recall). A pair that shares several pivots is verified in the list of the
smallest one, so it counts once.

Pivots are chosen from at most ``SAMPLE`` vectors of smallest hash; every vector is indexed.
Equal vectors are one class with a count. Lists of more than ``CHUNK`` classes are cut into
chunks and each pair of chunks is a group of its own, so no task holds more than two. A list
gives link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import components, local_roots, map_batches, whole_groups
from evalspark.plans.durable import durable

COSINE = 0.95
SAMPLE = 4096
PREFIX = 12
SHARED = 2
CHUNK = 2048
PIVOTS_FROM, PIVOTS_TO = 32, 2048


def pivot_count(n: int) -> int:
    """Grows with the square root of the rows, so that lists do too."""
    return int(min(PIVOTS_TO, max(PIVOTS_FROM, 4 * np.sqrt(n))))


def unit_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that can link, and their unit vectors in double precision."""
    good, out = [], []
    for k, v in enumerate(lists.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        a = np.array(v, np.float64)
        if len(a) and np.isfinite(a).all():
            top = np.abs(a).max()
            if top > 0:
                a = a / top  # keeps tiny and huge components from under- or overflowing
                good.append(k)
                out.append(a / np.sqrt((a * a).sum()))
    return np.array(good, np.int64), out


def choose_pivots(vectors: list[np.ndarray], count: int) -> dict[int, np.ndarray]:
    """Per dimension up to ``count`` pivots, each the sample vector farthest from those before."""
    out = {}
    for dim in {len(v) for v in vectors}:
        rows = np.stack([v for v in vectors if len(v) == dim])
        nearest = np.full(len(rows), -2.0)
        chosen = [0]
        for _ in range(min(count, len(rows)) - 1):
            nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
            nearest[chosen] = 2
            chosen.append(int(nearest.argmin()))
        out[dim] = rows[chosen]
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component, kept) per input row, whatever its other columns.

    A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing: no links and a component of its own. Only vectors of the same dimension link.
    Repeated rows link with each other. A null id keeps its row and gets its component's
    smallest id; it is never kept. No input: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.withColumn("_bad", F.coalesce(F.size("_v") <= 0, F.lit(True)) | F.coalesce(F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False)))
    # A class is told by its values; -0.0 and 0.0 are one value.
    good = rows.where("not _bad").select("_id", F.transform("_v", lambda x: x + 0.0).alias("_v")).withColumn("_key", F.xxhash64("_v"))
    classes = durable(good.groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    count = pivot_count(classes.count())
    picked = [np.array(r["_v"]) for r in classes.orderBy(F.xxhash64("_key"), "_key").limit(sample).select("_v").collect()]
    picked = [v / np.abs(v).max() for v in picked]
    pivots = spark.sparkContext.broadcast(choose_pivots([v / np.sqrt((v * v).sum()) for v in picked], count))

    def describe(batch: pa.RecordBatch) -> dict:
        _, units = unit_rows(batch.column("_v"))
        # A dimension the sample has not seen gets one list for all its vectors.
        ranks: list = [np.zeros(1, np.int32)] * len(units)
        size = np.array([len(v) for v in units])
        for dim, points in pivots.value.items():
            rows = np.flatnonzero(size == dim)
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                near = np.stack([units[k] for k in part]) @ points.T
                for k, order in zip(part, np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int32)):
                    ranks[k] = order
        return {
            "node": batch.column("node"), "copies": batch.column("copies"),
            "unit": pa.array(units, pa.list_(pa.float64())), "ranks": pa.array(ranks, pa.list_(pa.int32())),
        }

    described = map_batches(classes.select("node", "copies", "_v"), "node long, copies long, unit array<double>, ranks array<int>", describe)
    listed = described.select("*", F.size("unit").alias("dim"), F.explode("ranks").alias("pivot"))
    sizes = durable(described.select(F.size("unit").alias("dim"), F.explode("ranks").alias("pivot")).groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n")))
    cuts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), cuts).cast("int")
    names = ["dim", "pivot", "i", "j"]
    met = (
        listed.join(F.broadcast(sizes), ["dim", "pivot"])
        .select("dim", "pivot", "node", "copies", "unit", "ranks", own.alias("own"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
        .select("dim", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "unit", "ranks")
    )

    def verify(batches):
        for batch in whole_groups(batches, names):
            keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for lo, hi in zip(begin, np.append(begin[1:], len(keys))):
                found = verify_list(batch.slice(lo, hi - lo), int(keys[lo, 1]), keys[lo, 2] != keys[lo, 3], cosine, shared)
                if found is not None:
                    yield found

    found = met.repartition(*names).sortWithinPartitions(*names).mapInArrow(verify, "node long, links long, root long")
    found = durable(found.groupBy("node", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found, "node", "root")
    labelled = classes.select("node", "_key", "_v", "copies", "low").join(joined, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = durable(labelled.groupBy("root").agg(F.min("low").alias("component")))
    by_class = durable(labelled.join(smallest, "root").select("_key", F.col("_v").alias("_w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"))
    linked = good.join(by_class.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col("_v") == F.col("_w"))).select("_id", "n_links", "component")
    alone = rows.where("_bad").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component"))
    out = linked.union(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component", F.coalesce(F.col("_id") == F.col("component"), F.lit(False)).alias("kept"))


def verify_list(batch: pa.RecordBatch, pivot: int, crossing: bool, cosine: float, shared: int) -> pa.RecordBatch | None:
    """Links among the classes of one inverted list (or between two chunks of it)."""
    unit = np.array(batch.column("unit").flatten()).reshape(batch.num_rows, -1)
    ranks = np.array(batch.column("ranks").flatten()).reshape(batch.num_rows, -1)
    node, copies, own = (batch.column(c).to_numpy() for c in ("node", "copies", "own"))
    n = len(node)
    links = np.zeros(n, np.int64)
    us, vs = [], []
    for at in range(0, n, 256):
        part = slice(at, min(n, at + 256))
        # All rows here share this pivot. The cosine is the cheaper test, so it goes first.
        u, v = np.nonzero(unit[part] @ unit.T >= cosine)
        u += at
        apart = (u != v) & (own[u] != own[v] if crossing else True)
        u, v = u[apart], v[apart]
        for k in range(0, len(u), 1 << 16):
            a, b = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
            same = ranks[a][:, :, None] == ranks[b][:, None, :]
            common = np.where(same.any(axis=2), ranks[a], np.iinfo(np.int32).max)
            ok = (same.any(axis=2).sum(axis=1) >= min(shared, ranks.shape[1])) & (common.min(axis=1) == pivot)
            a, b = a[ok], b[ok]
            links += np.bincount(a, copies[b], n).astype(np.int64)
            # A forest is enough, so links of a dense list never pile up.
            root = local_roots(n, a, b)
            child = np.flatnonzero(root != np.arange(n))
            us.append(child)
            vs.append(root[child])
    root = local_roots(n, np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)]))
    hit = np.flatnonzero(links)
    if not len(hit):
        return None
    return pa.RecordBatch.from_pydict({"node": node[hit], "links": links[hit], "root": node[root[hit]]})
