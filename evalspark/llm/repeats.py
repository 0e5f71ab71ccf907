"""Finding every repeated window of W units (bytes or words) without a row per window.

Each window names its anchor: the m-gram in it with the smallest hash, the leftmost of equals.
Equal windows name equal anchors, and neighbouring windows mostly share theirs, so a text falls
into runs of windows with one anchor. A run is one row: its anchor's hash (``mkey``) and the
hash of everything its windows cover (``fkey``).

* An anchor that occurs once cannot be in a repeated window. Those runs, most of any text, are
  dropped after one count.
* Runs equal in ``mkey`` and ``fkey`` are copies: all their windows are repeated.
* Runs that share an anchor but differ elsewhere are where repeats begin, end or branch. One
  run of each kind is compared with the others window by window, by the caller's method.

Everything is counted over whole texts. A run has at most W - m + 1 windows, so no row grows
with the data. Hashes are 64 bits for anchors and another 64 for runs, and rows are tied to
texts by a 64-bit hash and the size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import trimmed, utf8
from evalspark.plans.durable import Scratch, stored

SEGMENT = 1 << 17  # units hashed at once; longer texts are cut with an overlap of a window
PLACE = (1 << 24) - 1  # low bits of a packed minimum hold its place, the others its hash
RUN = "_tkey long, _size long, pos long, mkey long, fkey long"
SHORT = 10  # bits of a run's length and anchor in ``pos``, behind its place
MAP_BITS = 1 << 26  # of the bitmap that spares texts without repeats their shuffle: 8 MB at any scale
OUTPUT = 1 << 20  # bytes of kept text per output batch
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hasher:
    """Polynomial hashes modulo 2**64 of any range of units, from prefix sums."""

    def __init__(self):
        self.power = self.inverse = np.ones(0, np.uint64)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * SEGMENT)
            self.power, self.inverse = np.full((2, n), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
            self.power[0] = self.inverse[0] = 1
            self.power, self.inverse = np.cumprod(self.power), np.cumprod(self.inverse)

    def prefix(self, units: np.ndarray) -> np.ndarray:
        self.grow(len(units) + 1)
        out = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.power[: len(units)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (prefix[hi] - prefix[lo]) * self.inverse[lo]

    def bytes(self, data: bytes) -> np.ndarray:
        return self.byte[np.frombuffer(data, np.uint8)]

    def words(self, data: bytes) -> np.ndarray:
        """Hashes of the words between blanks (20, 09-0D)."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + SEGMENT)
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
            buffer = np.frombuffer(data, np.uint8, end - at, at)
            inside = np.concatenate(([False], (buffer != 32) & ((buffer < 9) | (buffer > 13)), [False]))
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            lo, hi = edge[::2], edge[1::2]
            out.append(mix(self.ranges(self.prefix(self.byte[buffer]), lo, hi) + (hi - lo).astype(np.uint64)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from minima that run to and from block borders."""
    if w == 1:
        return values
    blocks = -(-len(values) // w)
    padded = np.full(blocks * w, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - w + 1
    return np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])


def runs_of(texts: list[np.ndarray], window: int, gram: int, hasher: Hasher) -> Iterator[dict[str, np.ndarray]]:
    """Runs of the unit sequences ``texts``, with ``doc`` the number of the sequence."""
    group: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for doc, units in enumerate(texts):
        for base in range(0, len(units) - window + 1, SEGMENT):
            piece = units[base : base + SEGMENT + window - 1]
            if group and size + len(piece) > SEGMENT:
                yield _runs(group, window, gram, hasher)
                group, size = [], 0
            group.append((doc, base, piece))
            size += len(piece)
    if group:
        yield _runs(group, window, gram, hasher)


def _runs(group: list[tuple[int, int, np.ndarray]], window: int, gram: int, hasher: Hasher) -> dict[str, np.ndarray]:
    units = np.concatenate([g[2] for g in group])
    length = np.array([len(g[2]) for g in group])
    begin = np.cumsum(length) - length
    prefix = hasher.prefix(units)
    place = np.arange(len(units) - gram + 1)
    grams = mix(hasher.ranges(prefix, place, place + gram))
    least = sliding_min((grams & ~np.uint64(PLACE)) | place.astype(np.uint64), window - gram + 1)
    count = length - window + 1
    start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor = (least[start] & np.uint64(PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    n = np.diff(np.append(new, len(start)))
    first, anchor = start[new], anchor[new]
    off = anchor - first
    whole = hasher.ranges(prefix, first, first + n - 1 + window)
    shape = n.astype(np.uint64) * np.uint64(BASE) + off.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    piece = np.searchsorted(begin, first, side="right") - 1
    return {
        "doc": np.array([g[0] for g in group])[piece],
        "at": first - begin[piece] + np.array([g[1] for g in group])[piece],
        "n": n, "off": off, "mkey": grams[anchor].view(np.int64), "fkey": mix(whole + shape).view(np.int64),
    }


def text_key(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


class Repeats:
    """Repeated windows of ``window`` units, bytes or (``words``) words, over the rows of ``docs``.

    ``branches(self, classes)`` finds, among runs that share an anchor, the repeated windows of
    those without a copy: it takes the classes of equal runs (mkey, fkey, total, rep) and
    returns (mkey, fkey, ks) with the numbers of a run's repeated windows.
    """

    def __init__(self, docs: DataFrame, text_col: str, window: int, gram: int, words: bool):
        if not 0 < gram <= window < 1 << SHORT:
            raise ValueError(f"windows hold {gram} to {(1 << SHORT) - 1} units")
        self.docs, self.text_col, self.window, self.gram, self.words = docs, text_col, window, gram, words

    def runs(self) -> DataFrame:
        window, gram, words = self.window, self.gram, self.words

        def run(batches):
            hasher = Hasher()
            units = hasher.words if words else hasher.bytes
            for batch in batches:
                held, size = [], 0
                texts = batch.column(0)
                for row in range(len(texts)):
                    data = utf8(texts[row].as_py())
                    if len(data) >= window:
                        held.append(data)
                        size += len(data)
                    if held and (size >= SEGMENT or row == len(texts) - 1):
                        yield from emit(held, hasher, units)
                        held, size = [], 0
                if held:
                    yield from emit(held, hasher, units)

        def emit(held, hasher, units):
            keys = np.array([text_key(d) for d in held], np.int64)
            sizes = np.array([len(d) for d in held], np.int64)
            for found in runs_of([units(d) for d in held], window, gram, hasher):
                doc = found.pop("doc")
                pos = (found["at"] << 2 * SHORT) | (found["n"] << SHORT) | found["off"]
                yield pa.RecordBatch.from_pydict({"_tkey": keys[doc], "_size": sizes[doc], "pos": pos, "mkey": found["mkey"], "fkey": found["fkey"]})

        return self.docs.select(F.col(self.text_col)).mapInArrow(trimmed(run), RUN)

    def texts(self, *keep: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(True).alias("_"))
        return self.docs.select(row.alias("_row"), F.col(self.text_col).alias("_text"))

    def packed(self, only: Broadcast, *keep: str) -> DataFrame:
        """(_row, _tkey, _size, _z) of the texts in the bitmap: the kept columns, and the text
        compressed for its shuffle."""

        def run(batches):
            press = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                found = [(row, key, data) for row, key, data in keyed(batch) if marked(only.value, key)]
                if found:
                    rows, keys, data = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(keys, pa.int64()), pa.array(list(map(len, data)), pa.int64()), pa.array([press.compress(d) for d in data], pa.binary())],
                        names=["_row", "_tkey", "_size", "_z"],
                    )

        narrow = self.texts(*keep)
        return narrow.mapInArrow(trimmed(run), f"_row {narrow.schema[0].dataType.simpleString()}, _tkey long, _size long, _z binary")

    def branchings(self, classes: DataFrame) -> DataFrame:
        """(mkey, kinds): anchors with several kinds of run, one of them without a copy."""
        counts = classes.groupBy("mkey").agg(F.count(F.lit(1)).alias("kinds"), F.min("total").alias("least"))
        return self.scratch.stored(counts.where("kinds > 1 and least = 1").select("mkey", "kinds"))

    def kinds(self, classes: DataFrame, anchors: DataFrame, read: Callable, schema: str) -> DataFrame:
        """What ``read`` makes of the kinds of run at ``anchors``: it takes lists of dicts (mkey,
        fkey, total, n, off, span), in bounded batches, and yields record batches."""
        wanted = self.scratch.stored(
            classes.join(anchors.select("mkey"), "mkey")
            .groupBy(F.col("rep._tkey").alias("_tkey"), F.col("rep._size").alias("_size"))
            .agg(F.collect_list(F.struct("mkey", "fkey", "total", "rep.pos")).alias("_runs"))
        )
        window, words = self.window, self.words

        def run(batches):
            press = zstandard.ZstdDecompressor()
            held, size = [], 0
            for batch in batches:
                for z, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = press.decompress(z)
                    parts = data.split() if words else None
                    for r in runs:
                        r["at"], r["n"], r["off"] = unpack(r.pop("pos"))
                        lo, hi = r["at"], r["at"] + r["n"] - 1 + window
                        r["span"] = b" ".join(parts[lo:hi]) if words else data[lo:hi]
                        held.append(r)
                        size += len(r["span"])
                        if size >= SEGMENT:
                            yield from read(held)
                            held, size = [], 0
            if held:
                yield from read(held)

        # One copy of each text is enough, and it is chosen before the text travels.
        once = self.packed(bitmap(wanted)).groupBy("_tkey", "_size").agg(F.first("_z").alias("_z"))
        return once.join(wanted, ["_tkey", "_size"]).select("_z", "_runs").mapInArrow(trimmed(run), schema)

    def spans(self, branches: Callable[[Repeats, DataFrame], DataFrame]) -> DataFrame:
        """(_tkey, _size, _runs): per text its runs with repeated windows; ``ks`` null is all."""
        self.scratch = Scratch(self.docs.sparkSession, "repeats")
        runs = self.runs()
        shared = self.scratch.stored(runs.groupBy("mkey").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mkey"))
        # Not grouped by mkey too: the aggregate would then ride on the join's partitioning, and
        # the join could not be split where an anchor is hot.
        kept = self.scratch.stored(
            runs.join(shared, "mkey").groupBy("_tkey", "_size", "pos", "fkey")
            .agg(F.max("mkey").alias("mkey"), F.count(F.lit(1)).alias("c"))
        )
        classes = self.scratch.stored(kept.groupBy("mkey", "fkey").agg(F.sum("c").alias("total"), F.min(F.struct("_tkey", "_size", "pos")).alias("rep")))
        whole = classes.where("total > 1").select("mkey", "fkey", F.lit(None).cast("array<int>").alias("ks"))
        marks = self.scratch.stored(whole.union(branches(self, classes).select("mkey", "fkey", "ks")))
        found = stored(
            kept.join(marks, ["mkey", "fkey"])
            .groupBy("_tkey", "_size").agg(F.collect_list(F.struct("pos", "ks")).alias("_runs")), "repeats-spans"
        )
        self.scratch.drop()
        return found

    def cut(self, branches: Callable[[Repeats, DataFrame], DataFrame], *keep: str, as_is: bool = False) -> DataFrame:
        """(_row, n_units, n_removed, kept, spans): each input row without its repeated units.

        ``kept`` is the text that stays: the bytes in order, or the words joined by one space.
        With ``as_is``, a text that loses nothing stays as it was, blanks included.
        ``spans`` are the maximal removed runs [lo, hi) in units.
        """
        spans = self.spans(branches)
        only = bitmap(spans)
        window, words = self.window, self.words
        narrow = self.texts(*keep)
        schema = f"_row {narrow.schema[0].dataType.simpleString()}, n_units long, n_removed long, kept binary, spans array<struct<lo:long,hi:long>>"
        where = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

        def finish(rows: pa.Array, texts: Iterator[tuple[bytes, list | None]]) -> Iterator[pa.RecordBatch]:
            done, size, at = [], 0, 0
            for data, runs in texts:
                parts = data.split() if words else np.frombuffer(data, np.uint8)
                lo, hi = (x.tolist() for x in covered(len(parts), runs or [], window))
                if as_is and not lo:
                    kept = data
                else:
                    between = list(zip([0, *hi], [*lo, len(parts)]))
                    kept = b" ".join([w for a, b in between for w in parts[a:b]]) if words else b"".join(data[a:b] for a, b in between)
                done.append((len(parts), sum(hi) - sum(lo), kept, [{"lo": a, "hi": b} for a, b in zip(lo, hi)]))
                size += len(kept)
                if size >= OUTPUT:
                    yield flush(rows.slice(at, len(done)), done)
                    at, done, size = at + len(done), [], 0
            if done:
                yield flush(rows.slice(at, len(done)), done)

        def flush(rows: pa.Array, done: list[tuple]) -> pa.RecordBatch:
            total, gone, kept, spans = zip(*done)
            return pa.RecordBatch.from_arrays(
                [rows, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, where)],
                names=["_row", "n_units", "n_removed", "kept", "spans"],
            )

        def untouched(batches):
            for batch in batches:
                found = [(row, data) for row, key, data in keyed(batch) if not marked(only.value, key)]
                yield from finish(batch.column(0).take(pa.array([r for r, _ in found], pa.int64())), ((data, None) for _, data in found))

        def joined(batches):
            press = zstandard.ZstdDecompressor()
            for batch in batches:
                yield from finish(batch.column(0), ((press.decompress(z), runs) for z, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))

        met = self.packed(only, *keep).join(spans, ["_tkey", "_size"], "left").select("_row", "_z", "_runs")
        return narrow.mapInArrow(trimmed(untouched), schema).union(met.mapInArrow(trimmed(joined), schema))


def unpack(pos: int) -> tuple[int, int, int]:
    mask = (1 << SHORT) - 1
    return pos >> 2 * SHORT, pos >> SHORT & mask, pos & mask


def keyed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(row, text key, text) of a batch (_row, _text)."""
    texts = batch.column(1)
    for row in range(len(texts)):
        data = utf8(texts[row].as_py())
        yield row, text_key(data), data


def marked(bits: np.ndarray, key: int) -> bool:
    place = key % MAP_BITS
    return bool(bits[place >> 3] >> (place & 7) & 1)


def bitmap(frame: DataFrame) -> Broadcast:
    """A bitmap of the text keys modulo its size, which does not depend on the data. A text
    whose bit is not set has no row in ``frame``; of the others, the join decides."""
    place = F.pmod("_tkey", F.lit(MAP_BITS)) + 1
    parts = frame.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts:
        at = (r["b"] - 1) * len(r["m"])
        bits[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return frame.sparkSession.sparkContext.broadcast(bits)


def covered(length: int, runs: list[dict], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that repeated windows cover."""
    step = np.zeros(length + 1, np.int64)
    for r in runs:
        at, n, _ = unpack(r["pos"])
        if r["ks"] is None:
            step[at] += 1
            step[at + n - 1 + window] -= 1
        else:
            lo = at + np.array(r["ks"], np.int64)
            np.add.at(step, lo, 1)
            np.add.at(step, lo + window, -1)
    inside = np.concatenate(([False], np.cumsum(step[:length]) > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def compare_windows(repeats: Repeats, classes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(mkey, fkey, ks) by one row per window of each kind of run at ``anchors``. A window is
    repeated if two kinds have it. Counts are partial aggregates, so an anchor may have any
    number of kinds."""
    window, words = repeats.window, repeats.words
    hasher = Hasher()

    def read(kinds: list[dict]) -> Iterator[pa.RecordBatch]:
        units = hasher.words(b" ".join(r["span"] for r in kinds)) if words else hasher.bytes(b"".join(r["span"] for r in kinds))
        n = np.array([r["n"] for r in kinds])
        length = n - 1 + window
        prefix = hasher.prefix(units)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(length) - length, n) + k
        each = lambda c, kind: np.repeat(np.array([r[c] for r in kinds], kind), n)
        yield pa.RecordBatch.from_pydict({
            "mkey": each("mkey", np.int64), "h": mix(hasher.ranges(prefix, start, start + window)).view(np.int64),
            "fkey": each("fkey", np.int64), "k": np.where(each("total", np.int64) == 1, k, -1).astype(np.int32),
        })

    # A window of a run that has a copy is repeated anyway; it counts here, with number -1.
    windows = repeats.scratch.stored(repeats.kinds(classes, anchors, read, "mkey long, h long, fkey long, k int"))
    twice = repeats.scratch.stored(windows.groupBy("mkey", "h").agg(F.min("fkey").alias("lo"), F.max("fkey").alias("hi")).where("lo != hi").select("mkey", "h"))
    return windows.where("k >= 0").join(twice, ["mkey", "h"]).groupBy("mkey", "fkey").agg(F.collect_list("k").alias("ks"))
