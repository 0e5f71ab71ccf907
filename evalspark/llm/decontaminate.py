"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

The automaton works on word numbers, so a match ends at a word and maps straight back to the
words, and by them to the characters, of the original text. A pattern is a window of
consecutive item words; an item shorter than the window is one pattern.

The automaton is sent to every task, so its size is checked: a benchmark of more than
``shard_words`` words is cut into shards of that size, each with an automaton of its own, and
the documents pass through one after the other. Windows are cut before the shards are, so the
result does not depend on the number of shards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import row_and_text, trimmed, utf8
from evalspark.plans.durable import durable

WINDOW = 13
SHARD_WORDS = 2_000_000
# A word is a run of digits, letters and anything beyond ASCII, in lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in utf8(text).translate(WORD_BYTES).split(b" ") if w]


class Matcher:
    """The automaton of one shard: ``items`` are (item id, first word, words) pieces."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in pieces:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            for at in range(max(1, len(ids) - window + 1)):
                owners.setdefault(ids[at : at + window], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, items in owners.items():
            self.automaton.add_word(ids, (len(ids), items))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [from, to) inside any occurrence, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return spans, items
        get = self.number.get
        for end, (length, owned) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            spans.append((end + 1 - length, end + 1))
            items |= owned
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def shards(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Pieces of the items in shards of bounded size; pieces of one item overlap by all words
    of a window but one, so every window lies in one piece."""
    shard, size = [], 0
    for item, text in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        words = words_of(text)
        step = max(1, shard_words - window + 1)
        for at in range(0, max(0, len(words) - window) + 1, step):
            piece = words[at : at + step + window - 1]
            if item is not None and piece:
                shard.append((item, piece))
                size += len(piece)
            if size >= shard_words:
                yield shard
                shard, size = [], 0
    yield shard


def find_passages(docs: DataFrame, items: DataFrame, *keep: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(_row, n_words, n_hit, n_items, items_sha256, items, spans) per document row.

    ``_row`` holds the columns ``keep``. ``spans`` are the hit passages as [from, to) characters
    of the original text; ``items`` the occurring item ids as sorted strings. Null and empty
    texts have no words. Items without words, or with a null id, match nothing. Items of equal
    text all occur together. Repeated rows keep their rows. No input: no rows.
    """
    narrow, texts = row_and_text(docs, keep, text_col)
    found = narrow.withColumns({"_spans": F.lit(None).cast("array<struct<lo:long,hi:long>>"), "_items": F.lit(None).cast("array<string>")})
    kind = found.schema[0].dataType.simpleString()
    passes = shards(items, item_col, item_text, window, shard_words)
    shard = next(passes)
    while True:
        following = next(passes, None)
        if following is None:
            break
        found = durable(found.mapInArrow(trimmed(_pass(docs.sparkSession, shard, window, texts)), found.schema))
        shard = following
    schema = f"_row {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<struct<lo:long,hi:long>>"
    return found.mapInArrow(trimmed(_last(docs.sparkSession, shard, window, texts)), schema)


def _scan(batch: pa.RecordBatch, texts: pa.Array, matcher: Matcher):
    """Each row's words, text, and its spans and items with those of earlier shards."""
    for text, spans, items in zip(texts, batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()):
        text = text.as_py()
        words = words_of(text)
        more, new = matcher.scan(words)
        spans = merge([(s["lo"], s["hi"]) for s in spans or []] + more) if more or spans else []
        yield text, words, spans, new | set(items or [])


SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _pass(spark, shard, window, texts):
    sent = spark.sparkContext.broadcast(shard)

    def run(batches):
        matcher = Matcher(sent.value, window)
        for batch in batches:
            rows = [r[2:] for r in _scan(batch, texts(batch), matcher)]
            new = [pa.array([[{"lo": a, "hi": b} for a, b in spans] for spans, _ in rows], SPANS), pa.array([sorted(items) for _, items in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=batch.schema.names)

    return run


def _last(spark, shard, window, texts):
    sent = spark.sparkContext.broadcast(shard)

    def run(batches):
        matcher = Matcher(sent.value, window)
        for batch in batches:
            n_words, n_hit, items, chars = [], [], [], []
            for text, words, spans, owned in _scan(batch, texts(batch), matcher):
                n_words.append(len(words))
                n_hit.append(sum(hi - lo for lo, hi in spans))
                items.append(sorted(owned))
                at = [m.span() for m in WORD_SPAN.finditer(text)] if spans else []
                chars.append([{"lo": at[lo][0], "hi": at[hi - 1][1]} for lo, hi in spans])
            yield pa.RecordBatch.from_pydict({
                "_row": batch.column(0),
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array(list(map(len, items)), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                "items": pa.array(items, pa.list_(pa.string())),
                "spans": pa.array(chars, SPANS),
            })

    return run


def contaminated(found: DataFrame) -> DataFrame:
    """Add the decision: hit words are at least a twentieth of all words."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
