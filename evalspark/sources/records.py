"""CSV records with line breaks inside quotes, read in as many tasks as the files have blocks.

A line break ends a record where the quotes before it are even in number. So each block needs one
bit from the blocks before it: whether it begins inside quotes. Quotes are counted per block first,
a prefix sum over the counts (one row per block) gives the bits, and then every block cuts its own
lines into records, as the scan reads them. Only a record that crosses into other blocks has its
pieces brought together, at most two pieces per block. Lines are not shuffled.

The format is strict, as in RFC 4180: a quote opens a field or is doubled inside a quoted one;
records are as wide as the header. Anything else fails the job. Lines end in LF or CRLF; an empty
line is no record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.plans.durable import stored
from evalspark.sources.positions import BLOCK, with_positions


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _file, _block, _line) of all lines, a CR at their end included."""
    return with_positions(spark.read.option("lineSep", "\n").text(path)).drop("_metadata")


def quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, '"', ""))


def block_states(lines: DataFrame) -> DataFrame:
    """(_file, _block, _open): 1 where a block begins inside quotes. A file that ends inside
    quotes fails the job."""
    counts = lines.groupBy(*BLOCK).agg(F.sum(quotes(F.col("value")).cast("long")).alias("_quotes"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_quotes").over(Window.partitionBy("_file")) % 2
    state = F.when(whole == 1, F.raise_error(F.concat(F.lit("quote without an end in "), "_file"))).otherwise(F.coalesce(F.sum("_quotes").over(before) % 2, F.lit(0)))
    return stored(counts.select(*BLOCK, state.cast("int").alias("_open")), "csv-blocks")


def block_pieces(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(_file, _block, _record, text, edge): the records of every block, numbered from 1 in it.
    Number 0 is what a block begins with of an earlier block's record. ``edge`` marks pieces
    whose record goes on in, or comes from, another block."""
    # Sorted behind the join: the optimizer takes a sort before it away.
    return cut_in_order(with_states(lines, states).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "_line"))


def with_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``_open`` of their block to lines, which stay where they are: one row per block is sent to all."""
    return lines.join(F.broadcast(states), BLOCK, "left").select(*BLOCK, "_line", "_open", "value")


def cut_in_order(opened: DataFrame) -> DataFrame:
    """``block_pieces`` of lines that come block after block and in order in their tasks, as a scan
    gives them. The pieces come in the same order. A task holds one batch of lines and the
    record that is not at its end yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            blocks = pa.StructArray.from_arrays(batch.columns[:2], BLOCK)
            at = 0
            while at < batch.num_rows:
                block = blocks[at].as_py()
                here = pc.and_(pc.equal(batch.column(0), block["_file"]), pc.equal(batch.column(1), block["_block"])).to_numpy(zero_copy_only=False)[at:]
                n = len(here) if here.all() else int(here.argmin())
                part = batch.slice(at, n)
                if cutter is None or cutter.block != block:
                    if cutter is not None:
                        yield from cutter.end()
                    cutter = Cutter(block, part.column("_open")[0].as_py())
                yield from cutter.cut(part.column("_line").to_numpy(), part.column("value"))
                at += n
        if cutter is not None:
            yield from cutter.end()

    return opened.mapInArrow(run, "_file string, _block bigint, _record bigint, text string, edge boolean")


class Cutter:
    """Cuts the lines of one block, which come in order, into records."""

    def __init__(self, block: dict, opened: int | None):
        if opened is None:
            raise ValueError("blocks changed between two passes")
        self.block, self.open, self.record, self.last = block, opened, 0, -1
        self.held: list[str] = []  # of the record that goes on

    def cut(self, at: np.ndarray, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if at[0] <= self.last or (np.diff(at) <= 0).any():
            raise ValueError("lines out of order")
        self.last = at[-1]
        odd = pc.count_substring(lines, '"').to_numpy() % 2
        after = (self.open + odd.cumsum()) % 2  # 1: inside quotes behind the line
        ends = np.flatnonzero(after == 0) + 1
        begin = 0
        if self.open and len(ends):  # the record that was open ends here
            begin = int(ends[0])
            text = "\n".join([*self.held, *lines[:begin].to_pylist()])
            self.held = []
            yield self._rows([text], self.record == 0)
        whole = ends[1:] if begin else ends
        if len(whole):
            offsets = pa.array(np.concatenate([[begin], whole]), pa.int32())
            yield self._rows(pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n"), False, int(self.record) + 1)
            self.record += len(whole)
        if after[-1]:
            rest = int(ends[-1]) if len(ends) else 0
            if not self.open or len(ends):
                self.record += 1
            self.held += lines[rest:].to_pylist()
        self.open = int(after[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._rows(["\n".join(self.held)], True)

    def _rows(self, texts, edge: bool, first: int | None = None) -> pa.RecordBatch:
        n, first = len(texts), self.record if first is None else first
        return pa.RecordBatch.from_pydict({
            "_file": pa.array([self.block["_file"]] * n, pa.string()), "_block": pa.array([self.block["_block"]] * n, pa.int64()),
            "_record": pa.array(np.arange(first, first + n), pa.int64()), "text": pa.array(texts, pa.string()) if isinstance(texts, list) else texts,
            "edge": pa.array([edge] * n, pa.bool_()),
        })


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["value"]), "\n")


def stitched(edges: DataFrame) -> DataFrame:
    """(_file, _block, _record, text) of the records that cross blocks, placed where they begin."""
    order = Window.partitionBy("_file").orderBy("_block", "_record").rowsBetween(Window.unboundedPreceding, 0)
    chains = edges.withColumn("_chain", F.sum((F.col("_record") > 0).cast("int")).over(order))
    pieces = chains.groupBy("_file", "_chain").agg(F.min(F.struct("_block", "_record")).alias("_at"), joined(F.collect_list(F.struct("_block", F.col("text").alias("value")))).alias("text"))
    return pieces.select("_file", "_at._block", "_at._record", "text")


def strict(text: Column) -> Column:
    """The text of a record without its CR; a quote out of place fails the job."""
    text = F.regexp_replace(text, "\r$", "")
    # Without doubled quotes, every second stretch between quotes lies outside: it ends and begins at commas.
    outside = F.filter(F.split(F.replace(text, F.lit('""'), F.lit("")), '"'), lambda x, k: k % 2 == 0)
    last = F.size(outside) - 1
    well = F.forall(
        F.transform(outside, lambda x, k: F.struct(x.alias("x"), k.alias("k"))),
        lambda s: ((s["k"] == 0) | (s["x"] == "") & (s["k"] == last) | s["x"].startswith(",")) & ((s["k"] == last) | (s["x"] == "") & (s["k"] == 0) | s["x"].endswith(",")),
    )
    return F.when(text.contains('"') & ~well, F.raise_error(F.concat(F.lit("quote out of place in record: "), F.left(text, F.lit(200))))).otherwise(text)


def with_cells(records: DataFrame, width: int, when: Column | None = None) -> DataFrame:
    """Add ``cells``, the fields of ``text`` as strings, empty ones as ''; another width fails the
    job. Rows that are not meant by ``when`` get null."""
    schema = ", ".join(f"c{k} string" for k in range(width))
    row = F.from_csv("text", schema, {"mode": "FAILFAST", "quote": '"', "escape": '"', "multiLine": "true"})
    # Exploded, so that each text is parsed once, whatever the optimizer moves.
    parsed = records.select("*", F.explode(F.array(row if when is None else F.when(when, row))).alias("_row"))
    cells = F.array(*[F.coalesce(F.col("_row")[f"c{k}"], F.lit("")) for k in range(width)])
    return parsed.withColumn("cells", cells if when is None else F.when(when, cells)).drop("_row")


def is_header() -> Column:
    return (F.col("_block") == 0) & (F.col("_record") == 1)


def positioned_cells(spark: SparkSession, path: str | list[str], width: int, usable: Callable[[Column], Column]) -> DataFrame:
    """(cells, _file, _block, _at) of the usable data records; ``_at`` numbers them within the block they
    begin in, from any number on, without gaps. Headers and empty lines are left out. The lines are
    read twice and never shuffled, the records stored once."""
    lines = text_lines(spark, path)
    pieces = cut_in_order(with_states(lines, block_states(lines)))
    edge = F.col("edge")
    ready = pieces.withColumn("text", F.when(edge, F.col("text")).otherwise(strict(F.col("text")))).where(edge | ~is_header() & (F.col("text") != ""))
    known = with_cells(ready, width, ~edge).where(edge | usable(F.col("cells")))
    # Still in the order of the scan. A block's pieces of other blocks' records are its first and last
    # rows, so the ids of those between them grow by one.
    kept = stored(known.select(*BLOCK, "_record", F.when(edge, F.col("text")).alias("text"), "cells", "edge", F.monotonically_increasing_id().alias("_at")), "csv-records")
    whole = kept.where(~edge).select("cells", *BLOCK, "_at")
    counts = kept.where(~edge).groupBy(*BLOCK).agg((F.max("_at") + 1).alias("_at"))
    crossing = stitched(kept.where(edge)).withColumn("text", strict(F.col("text"))).where(~is_header() & (F.col("text") != ""))
    # One such record at most begins in a block, after all others.
    more = with_cells(crossing, width).where(usable(F.col("cells"))).join(counts, BLOCK, "left")
    return whole.unionByName(more.select("cells", *BLOCK, F.coalesce("_at", F.lit(0).cast("long")).alias("_at")))


def first_records(spark: SparkSession, file: str, lines: int) -> tuple[DataFrame, bool]:
    """((_record, text) of the records that end within the first ``lines`` lines of one file, whether
    that is all of it). Only the blocks that hold these lines are read; they pass through the driver."""
    head = [r.value for r in spark.read.option("lineSep", "\n").text(file).take(lines)]
    done = len(head) < lines
    numbered = spark.createDataFrame([(file, 0, k, v) for k, v in enumerate(head)], "_file string, _block long, _line long, value string")
    state = spark.createDataFrame([(file, 0, 0)], "_file string, _block long, _open int")
    pieces = block_pieces(numbered, state)
    if done and pieces.where("edge").count():
        raise ValueError(f"quote without an end in {file}")
    return pieces.where("not edge").select("_record", strict(F.col("text")).alias("text")), done
