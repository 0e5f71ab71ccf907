"""Token counts with a public tokenizer, in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_batches, utf8

BATCH_BYTES = 1 << 20
PIECES = 1 << 20
# Safe boundaries of a byte-level tokenizer, so that counts of the parts add up. It starts a
# pre-token at one blank between two characters that no white-space class holds; a lone line
# feed between two such characters is a pre-token; a run of letters ends at a mark. No special
# token holds any of them.
SAFE = re.compile(r"(?<=\S) (?=\S)")
RARE_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
MARKS = frozenset(".,;:!?")
LAST_LATIN = "\u024f"


def pieces(text: str) -> list[str]:
    """Cut a text at every safe blank. All but the first piece had a blank before them."""
    lone = not (text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text)
    return text.split(" ") if lone and not any(c in text for c in RARE_BLANKS) else SAFE.split(text)


def atoms(piece: str) -> list[str]:
    """Cut a piece further, at lone line feeds and before closing marks."""
    lines = piece.split("\n")
    if len(lines) > 1 and any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
        return [piece]
    out: list[str] = []
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        stem = line.rstrip(".,;:!?")
        if len(stem) < len(line) and stem.isalpha() and max(stem) <= LAST_LATIN:
            out += [stem, line[len(stem) :]]
        else:
            out.append(line)
    return out


class Counter:
    """Counts tokens per text. Each distinct piece is encoded once while it is remembered; the
    memory is emptied at ``keep`` pieces, so it stays bounded for any vocabulary."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, keep: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.batch_bytes, self.keep = batch_bytes, keep
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}  # with a blank before

    def _learn(self, new: set[str], blank: str) -> None:
        into = self.later if blank else self.first
        plain, cut, rest = [], [], set()
        for piece in new:
            if piece[-1:] in MARKS or "\n" in piece:
                parts = atoms(piece)
                if len(parts) > 1:
                    cut.append((piece, parts))
                    rest.update(parts[1:])
                    continue
            plain.append(piece)
        heads = {parts[0] for _, parts in cut}
        self._encode(list(heads.union(plain) - into.keys()), blank, into)
        self._encode(list(rest - self.first.keys()), "", self.first)
        for piece, parts in cut:
            into[piece] = into[parts[0]] + sum(map(self.first.__getitem__, parts[1:]))

    def _encode(self, new: list[str], blank: str, into: dict[str, int]) -> None:
        at = 0
        while at < len(new):
            begin, size = at, 0
            while at < len(new) and (at == begin or size < self.batch_bytes):
                size += len(new[at]) + 16
                at += 1
            batch = new[begin:at]
            encoded = self.encoder.encode_batch_fast([blank + p for p in batch] if blank else batch, add_special_tokens=False)
            into.update(zip(batch, map(len, encoded)))

    def count(self, texts: list[str | None]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            # A batch is as many texts as hold batch_bytes, one at least.
            begin, size = at, 0
            while at < len(texts) and (at == begin or size < self.batch_bytes):
                size += len(texts[at] or "")
                at += 1
            if len(self.first) + len(self.later) > self.keep:
                self.first.clear()
                self.later.clear()
            cut = [pieces(t or "") for t in texts[begin:at]]
            heads = [p.pop(0) for p in cut]
            self._learn(set(heads) - self.first.keys(), "")
            self._learn(set().union(*cut) - self.later.keys(), " ")
            out += [self.first[h] + sum(map(self.later.__getitem__, p)) for h, p in zip(heads, cut)]
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, in whole texts and without a shuffle.

    ``path`` is the tokenizer file, which every worker must reach. Null counts as the empty
    text: no bytes and no tokens. Repeated rows and null ids keep their rows.
    """

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_pydict({
                    id_col: batch.column(0),
                    "n_bytes": pa.array([len(utf8(t)) for t in texts], pa.int64()),
                    "n_tokens": pa.array(counter.count(texts), pa.int64()),
                })

    narrow = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
