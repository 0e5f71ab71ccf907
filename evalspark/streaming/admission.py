"""Sliding-window admission: at most N accepted events per key in any trailing window.

An event is accepted if fewer than N *accepted* events of its key lie less than the
window before it. Decisions depend on earlier decisions, which no window frame expresses.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evalspark.plans.durable import stored
from evalspark.plans.numbering import number_rows

CHUNK = 1 << 14  # distinct times
ROUNDS = 4
SLOT_US = 1_000_000  # events are judged by the second
PIECE = 256  # events, or accepted times, in one entry of the state
OUT_ROWS = 4096

def sliding_admission(events: DataFrame, key: str, ts: str, window: str = "5 minutes", n: int = 10,
                      tie: str = "event_id", chunk: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """Add ``accepted``. Batch form; ``tie`` is the unique event id that orders equal times.

    Decisions of one key are sequential, so as little as possible goes through that scan:
    events are first counted per (key, time), map-side, and only distinct times are
    shuffled, in chunks, whatever share of them one key holds (``_admitted_times``).
    At most N times per window are accepted, so the verdicts are a small table to join
    back, whatever share of the events a hot key holds.
    """
    window_us = int(pd.Timedelta(window).total_seconds() * 1_000_000)
    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    times = timed.where(F.col(key).isNotNull()).groupBy(key, "_us").agg(F.count(F.lit(1)).alias("_events"))
    admitted = _admitted_times(times, key, window_us, n, chunk, rounds)
    # Of equal times the lowest ids go first; rank <= n is pruned per task before the shuffle.
    rank = F.row_number().over(Window.partitionBy(key, "_us").orderBy(tie))
    chosen = (
        timed.select(key, "_us", tie).join(admitted, [key, "_us"]).withColumn("_rank", rank)
        .where(F.col("_rank") <= n).where(F.col("_rank") <= F.col("_room"))
        .select(key, tie, F.lit(True).alias("accepted"))
    )
    joined = events.join(chosen, [key, tie], "left")
    return joined.select(*events.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def scan_chunk(micros: np.ndarray, events_at: np.ndarray, recent: list[int], window_us: int, n: int) -> tuple[list[int], list[int], list[int]]:
    """Positions and numbers of accepted events among distinct times in order, given the accepted
    times ``recent`` before them, and the accepted times still in the window after the last."""
    kept, rooms, i = [], [], 0
    while i < len(micros):
        at = int(micros[i])
        recent = [t for t in recent if at - t < window_us]
        room = min(n - len(recent), int(events_at[i]))
        if room > 0:
            recent += [at] * room
            kept.append(i)
            rooms.append(room)
            i += 1
        else:  # full: nothing is accepted before the oldest accepted time leaves the window
            i = int(micros.searchsorted(recent[0] + window_us))
    return kept, rooms, [t for t in recent if int(micros[-1]) - t < window_us]


def _admitted_times(times: DataFrame, key: str, window_us: int, n: int, chunk: int, rounds: int) -> DataFrame:
    """(key, _us, _room): how many events of a time are accepted, times with none left out.

    The times are cut into chunks of at most ``chunk``, each one row. All chunks are scanned at
    once as if nothing had been accepted before them. That is right after every pause of a window,
    and wherever both courses meet again it does no harm: what leaves a chunk is then the same.
    Chunks that were entered with something else are scanned again, until every chunk was entered
    with what leaves the one before it. A key whose courses do not meet within ``rounds`` rounds (it
    is full all the time) carries its state on through its chunks in one task, which reads
    the chunks from the first wrong one on and steps from accepted time to accepted time.
    """
    kind = times.schema[key].dataType.simpleString()
    dealt = number_rows(times, [key, "_us"], "_nth").withColumn("_chunk", F.floor(F.col("_nth") / chunk))
    listed = F.array_sort(F.collect_list(F.struct("_us", "_events")))
    packed = stored(
        dealt.groupBy(key, "_chunk").agg(listed.alias("_t"))
        .select(key, "_chunk", F.col("_t._us").alias("_us"), F.col("_t._events").alias("_events"), F.get("_t._us", F.lit(0)).alias("_first")), "admission-chunks"
    )
    empty = F.array().cast("array<bigint>")

    def exits(rows: DataFrame) -> DataFrame:
        """(key, _chunk, _exit) of chunks (key, _chunk, _us, _events, _entry)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    scan_chunk(us.values.to_numpy(), at.values.to_numpy(), entry.as_py(), window_us, n)[2]
                    for us, at, entry in zip(batch.column("_us"), batch.column("_events"), batch.column("_entry"))
                ]
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "_chunk": batch.column(1), "_exit": pa.array(out, pa.list_(pa.int64()))})

        return rows.select(key, "_chunk", "_us", "_events", "_entry").mapInArrow(run, f"`{key}` {kind}, _chunk bigint, _exit array<bigint>")

    def carry(rows: DataFrame) -> DataFrame:
        """The same for chunks in their order, each entered with what left the one before; the
        first of a key is entered with its ``_entry``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = None, []
            for batch in batches:
                keys, out = batch.column(0).to_pylist(), []
                for k, us, at, entry in zip(keys, batch.column("_us"), batch.column("_events"), batch.column("_entry")):
                    state = scan_chunk(us.values.to_numpy(), at.values.to_numpy(), state if k == current else entry.as_py(), window_us, n)[2]
                    current = k
                    out.append(state)
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "_chunk": batch.column(1), "_exit": pa.array(out, pa.list_(pa.int64()))})

        ordered = rows.select(key, "_chunk", "_us", "_events", "_entry").repartition(key).sortWithinPartitions(key, "_chunk")
        return ordered.mapInArrow(run, f"`{key}` {kind}, _chunk bigint, _exit array<bigint>")

    before = Window.partitionBy(key).orderBy("_chunk")
    several = packed.groupBy(key).agg(F.count(F.lit(1)).alias("_chunks")).where("_chunks > 1").select(key)
    many = stored(packed.join(several, key), "admission-many")
    entered = packed.select(key, "_chunk", empty.alias("_entry"))
    if not many.isEmpty():
        state = stored(many.select(key, "_chunk", "_first", empty.alias("_entry")).join(exits(many.withColumn("_entry", empty)), [key, "_chunk"]), "admission-state")
        for turn in range(rounds + 2):
            known = F.filter(F.coalesce(F.lag("_exit").over(before), empty), lambda t: F.col("_first") - t < window_us)
            now = stored(state.withColumn("_known", known).withColumn("_wrong", F.col("_known") != F.col("_entry")), "admission-known")
            if now.where("_wrong").isEmpty():
                break
            if turn < rounds:
                todo = now.where("_wrong")
                found = exits(many.join(todo.select(key, "_chunk", F.col("_known").alias("_entry")), [key, "_chunk"]))
            else:
                reach = now.where("_wrong").groupBy(key).agg(F.min("_chunk").alias("_from"))
                todo = now.join(reach, key).where("_chunk >= _from")
                found = carry(many.join(todo.select(key, "_chunk", F.col("_known").alias("_entry")), [key, "_chunk"]))
            again = found.withColumnRenamed("_exit", "_new")
            if turn < rounds:
                state = now.join(again, [key, "_chunk"], "left").select(
                    key, "_chunk", "_first", F.when(F.col("_wrong"), F.col("_known")).otherwise(F.col("_entry")).alias("_entry"), F.coalesce("_new", "_exit").alias("_exit")
                )
            else:  # every exit is right now, and with it every entry
                moved = now.join(again, [key, "_chunk"], "left").withColumn("_exit", F.coalesce("_new", "_exit"))
                state = moved.select(key, "_chunk", "_first", known.alias("_entry"), "_exit")
            state = stored(state, "admission-state")
        right = now.select(key, "_chunk", F.col("_known").alias("_right"))
        entered = entered.join(right, [key, "_chunk"], "left").select(key, "_chunk", F.coalesce("_right", "_entry").alias("_entry"))

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, us, at, entry in zip(range(batch.num_rows), batch.column("_us"), batch.column("_events"), batch.column("_entry")):
                micros = us.values.to_numpy()
                kept, rooms, _ = scan_chunk(micros, at.values.to_numpy(), entry.as_py(), window_us, n)
                if kept:
                    yield pa.RecordBatch.from_pydict({
                        key: batch.column(0).take(pa.array([row] * len(kept))), "_us": pa.array(micros[kept], pa.int64()), "_room": pa.array(rooms, pa.int32()),
                    })

    ready = packed.join(entered, [key, "_chunk"]).select(key, "_us", "_events", "_entry")
    return ready.mapInArrow(accept, f"`{key}` {kind}, _us bigint, _room int")


class Due:
    """Waiting events before ``until``, in order, of the first ``seen`` pieces only those from ``judged``
    on. A piece is read when its first time comes, so that those that lie behind each other are not
    held together. Afterwards ``next_us`` is the first time that still waits."""

    def __init__(self, waiting, pieces: list[tuple], judged: int | None, seen: int, until: int):
        self.waiting, self.pieces, self.judged, self.seen, self.until = waiting, pieces, judged, seen, until
        self.next_us = None

    def __iter__(self) -> Iterator[tuple]:
        open_, coming = [], 0  # a heap of the next event of every piece being read
        while open_ or coming < len(self.pieces):
            first = self.pieces[coming][0] if coming < len(self.pieces) else None
            if not open_ or first is not None and first <= open_[0][0]:
                if first >= self.until:
                    break
                us, ties = self.waiting.getValue(self.pieces[coming])
                nth = self.pieces[coming][2]
                at = bisect_left(us, self.judged) if nth < self.seen else 0
                if at < len(us):
                    heappush(open_, (us[at], ties[at], nth, at, us, ties))
                coming += 1
                continue
            at_us, name, nth, at, us, ties = open_[0]
            if at_us >= self.until:
                break
            if at + 1 < len(us):
                heapreplace(open_, (us[at + 1], ties[at + 1], nth, at + 1, us, ties))
            else:
                heappop(open_)
            yield at_us, name
        left = [open_[0][0]] if open_ else []
        self.next_us = min(left + [p[0] for p in self.pieces[coming : coming + 1]], default=None)


class AcceptedTimes:
    """The accepted times of a key by their number, in entries of ``PIECE``; ``store`` writes the
    entries that changed and removes those that lie before the n-th last time."""

    def __init__(self, ring, count: int, n: int):
        self.ring, self.count, self.n = ring, count, n
        self.held: dict[int, list[int]] = {}
        self.changed: set[int] = set()
        self.there = range(max(0, count - n) // PIECE, -(-count // PIECE))  # entries the state has

    def _entry(self, block: int) -> list[int]:
        if block not in self.held:
            self.held[block] = list(self.ring.getValue((block,))[0]) if block in self.there else []
        return self.held[block]

    def get(self, number: int) -> int:
        return self._entry(number // PIECE)[number % PIECE]

    def append(self, at: int) -> None:
        block = self.count // PIECE
        self._entry(block).append(at)
        self.changed.add(block)
        self.count += 1

    def store(self) -> None:
        first = max(0, self.count - self.n) // PIECE
        for block in self.there:
            if block < first:
                self.ring.removeKey((block,))
        for block in sorted(self.changed):
            if block >= first:
                self.ring.updateValue((block,), (self.held[block],))


class Admit(StatefulProcessor):
    """Verdicts of one key, in event order, once the watermark has passed their events.

    A call to the state costs far more than a verdict, so state comes in pieces, and a batch reads and
    writes only the pieces it needs. ``waiting``: pieces of up to ``PIECE`` events that came together, in
    order, under their first and last time; written once, removed once the watermark has passed the last.
    ``ring``: the accepted times, numbered from 0, ``PIECE`` in an entry, as far back as the n-th last.
    ``head``: how many were accepted, the last of them, up to where the pieces
    seen till then are judged, the next timer, and how many pieces came. An event is accepted iff the n-th accepted time before it has left the window.
    One timer per key fires when the earliest waiting second can get no more events, or, with none
    waiting, when the last accepted time has left the window and all state can go.
    """

    def __init__(self, key: str, tie: str, ts: str, tie_type: str, window_us: int, n: int):
        self.key, self.tie, self.ts, self.tie_type, self.window_us, self.n = key, tie, ts, tie_type, window_us, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first_us bigint, last_us bigint, nth bigint", f"us array<bigint>, tie array<{self.tie_type}>")
        self.ring = handle.getMapState("ring", "block bigint", "us array<bigint>")
        self.head = handle.getValueState("head", "accepted bigint, last_us bigint, judged_us bigint, seen bigint, timer bigint, pieces bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        accepted, last, judged, seen, timer, pieces = self.head.get() or (0, None, None, 0, None, 0)
        before = timer
        for batch in rows:
            micros = batch[self.ts].astype("datetime64[us]").astype("int64")
            events = sorted(zip(micros.tolist(), batch[self.tie].tolist()))
            for at in range(0, len(events), PIECE):
                us, ties = zip(*events[at : at + PIECE])
                self.waiting.updateValue((us[0], us[-1], pieces), (list(us), list(ties)))
                pieces += 1
            due = self._due(events[0][0] // SLOT_US)
            timer = due if timer is None else min(timer, due)
        if timer != before:
            self.handle.registerTimer(timer)
        self.head.update((accepted, last, judged, seen, timer, pieces))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        state = self.head.get()
        if state is None or state[4] != fired:  # an earlier timer has taken its place
            return
        accepted, last, judged, seen, _, pieces = state
        watermark = timerValues.getCurrentWatermarkInMs()
        slot_ms = SLOT_US // 1000
        until = max(fired // slot_ms, -(-watermark // slot_ms) - 1) * SLOT_US  # no events before it can come
        there = sorted(self.waiting.keys())
        due = Due(self.waiting, there, judged, seen, until)
        times = AcceptedTimes(self.ring, accepted, self.n)
        out = []
        for at, name in due:
            oldest = times.get(accepted - self.n) if accepted >= self.n else None
            ok = oldest is None or at - oldest >= self.window_us
            if ok:
                times.append(at)
                accepted, last = accepted + 1, at
            out.append((at, name, ok))
            if len(out) == OUT_ROWS:
                yield self._verdicts(key, out)
                out = []
        if out:
            yield self._verdicts(key, out)
        for piece in there:
            if piece[1] < until:
                self.waiting.removeKey(piece)
        if due.next_us is not None:
            timer = self._due(due.next_us // SLOT_US)
        elif last is None or self._over(last) <= max(fired, watermark):  # nothing accepted can matter any more
            self.ring.clear()
            self.head.clear()
            return
        else:
            timer = self._over(last)
        times.store()
        self.handle.registerTimer(timer)
        self.head.update((accepted, last, until, pieces, timer, pieces))

    def _verdicts(self, key, rows: list[tuple]) -> pd.DataFrame:
        times, names, verdicts = zip(*rows)
        return pd.DataFrame({
            self.key: [key[0]] * len(rows), self.tie: list(names), self.ts: pd.to_datetime(list(times), unit="us"), "accepted": list(verdicts),
        })

    def close(self) -> None:
        pass

    @staticmethod
    def _due(slot: int) -> int:
        """When, in milliseconds, the watermark has passed every time of a slot."""
        return (slot + 1) * SLOT_US // 1000

    def _over(self, last: int) -> int:
        """When the window after an accepted time is over, at the end of a slot, so that the events
        of that slot have been judged before."""
        return self._due((last + self.window_us) // SLOT_US + 1)


def sliding_admission_stream(stream: DataFrame, key: str, ts: str, window: str = "5 minutes", n: int = 10,
                             *, late: str, tie: str = "event_id") -> DataFrame:
    """Streaming form: ``key, tie, ts, accepted`` in append mode.

    Events more than ``late`` behind the newest get no verdict; an anti join of the events with
    the verdicts finds them. ``tie`` may be of any type with an order. Events with a null key get
    none either. Verdicts come when the watermark has passed the second of their event.

    State per key is the last N accepted times, in entries of ``PIECE``, plus the events not yet passed
    by the watermark (``Admit``). It needs the RocksDB state store, which ``configure`` sets.
    """
    window_us = int(pd.Timedelta(window).total_seconds() * 1_000_000)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    watermarked = stream.select(key, tie, ts).where(F.col(key).isNotNull()).withWatermark(ts, late)
    out_schema = f"`{key}` {types[key]}, `{tie}` {types[tie]}, `{ts}` timestamp, accepted boolean"
    return watermarked.groupBy(key).transformWithStateInPandas(Admit(key, tie, ts, types[tie], window_us, n), out_schema, "append", "EventTime")
