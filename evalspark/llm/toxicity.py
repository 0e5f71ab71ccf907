"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of the word itself and of its character n-grams,
a text's the mean over its words. Embeddings and softmax are trained together in numpy on the
driver, on at most ``SAMPLE`` labelled rows whose texts hold at most ``SAMPLE_WORDS`` words in
total; the model has a fixed size, whatever the corpus. Because a misspelt word shares most
n-grams with the right one, it lands near it.

Averaging and softmax are linear, so a trained model is one number per bucket, and a text's
score comes from sums of them over its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import row_and_text, trimmed
from evalspark.llm.decontaminate import WORD_BYTES
from evalspark.llm.repeats import Hasher, mix, text_key

BUCKETS = 1 << 20
DIM = 8
GRAMS = (3, 4, 5)
SAMPLE = 4000
SAMPLE_WORDS = 1_000_000
THRESHOLD = 0.5
EPOCHS = 16
RATE = 1.0
SEGMENT = 16  # words
WEIGHT = {"toxic": 0.3, "clean": 0.25, "segment": 0.45}
PART = 1 << 17  # bytes of text worked on at once


def clean(text: str | None) -> bytes:
    """Lower-case words of a text (digits, letters, anything beyond ASCII) between blanks."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES)


def parts_of(data: bytes):
    """A long text in pieces that end at blanks."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data) and data[end] != 32:
            end += 1
        yield data[at:end]
        at = end


class Subwords:
    """Buckets of the character n-grams (in bytes, with the blank on either side) and of the
    whole of every word in a buffer that begins and ends with a blank."""

    def __init__(self, buffer: bytes, hasher: Hasher):
        raw = np.frombuffer(buffer, np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.lo, self.hi = edge[::2], edge[1::2]
        prefix = hasher.prefix(hasher.byte[raw])
        mask = np.uint64(BUCKETS - 1)
        self.whole = (mix(hasher.ranges(prefix, self.lo, self.hi)) & mask).astype(np.int64)
        self.gram = {}
        for n in GRAMS:
            i = np.arange(max(0, len(raw) - n + 1))
            self.gram[n] = (mix(hasher.ranges(prefix, i, i + n) + np.uint64(n)) & mask).astype(np.int64)
        length = self.hi - self.lo
        self.count = {n: np.maximum(0, length + 3 - n) for n in GRAMS}
        self.total = 1 + sum(self.count.values())

    def means(self, value: np.ndarray) -> np.ndarray:
        """Per word, the mean of ``value`` over its buckets."""
        total = value[self.whole].astype(np.float64)
        for n, bucket in self.gram.items():
            upto = np.concatenate(([0.0], np.cumsum(value[bucket], dtype=np.float64)))
            first = np.minimum(self.lo - 1, len(bucket))  # a short last word has no n-gram to start at
            total += upto[first + self.count[n]] - upto[first]
        return total / self.total

    def bag(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of all words and their weights in the mean over the words."""
        if not len(self.lo):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        each = 1 / self.total / len(self.lo)
        place, weight = [self.whole], [each]
        for n, bucket in self.gram.items():
            count = self.count[n]
            at = np.repeat(self.lo - 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place.append(bucket[at])
            weight.append(np.repeat(each, count))
        found, inverse = np.unique(np.concatenate(place), return_inverse=True)
        return found.astype(np.int32), np.bincount(inverse, np.concatenate(weight)).astype(np.float32)


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
        self.softmax = rng.normal(0, 1, (2, DIM)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 256, seed: int = 7) -> Model:
        """Adagrad on the weighted cross entropy of both layers together. Bags are dealt into
        batches once, and each epoch takes the batches in another order; so the places of a batch are
        sorted once, and sums over bags and over buckets are sums of neighbours. ``bags`` is
        emptied on the way."""
        rng = np.random.default_rng(seed)
        seen_e = np.full(BUCKETS, 1e-6, np.float32)
        seen_w, seen_b = np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        order, batches = rng.permutation(len(bags)), []
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            batches.append((rows, *self._dealt([bags[r] for r in rows])))
            for r in rows:
                bags[r] = None
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                rows, share_of, size, by_bucket, touched, runs = batches[k]
                starts, place = np.cumsum(size) - size, np.empty(len(by_bucket), np.int32)
                place[by_bucket] = np.repeat(touched, np.diff(np.append(runs, len(by_bucket))))
                hidden = np.add.reduceat(self.embedding[place] * share_of[:, None], starts, axis=0)
                logits = hidden @ self.softmax.T + self.bias
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(axis=1, keepdims=True)
                error = p.copy()
                error[np.arange(len(rows)), labels[rows]] -= 1
                error *= (weight[rows] / len(rows))[:, None]
                back = (error @ self.softmax).astype(np.float32)
                grad_w, grad_b = error.T @ hidden, error.sum(axis=0)
                owner = np.repeat(np.arange(len(rows)), size)[by_bucket]
                grad_e = np.add.reduceat(back[owner] * share_of[by_bucket, None], runs, axis=0)
                seen_e[touched] += (grad_e**2).mean(axis=1)
                seen_w += grad_w**2
                seen_b += grad_b**2
                self.embedding[touched] -= rate * 0.2 * grad_e / np.sqrt(seen_e[touched])[:, None]
                self.softmax -= rate * grad_w / np.sqrt(seen_w)
                self.bias -= rate * 0.2 * grad_b / np.sqrt(seen_b)
        return self

    @staticmethod
    def _dealt(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Weights of a batch, sizes of its bags, the order of its places by bucket, the buckets, and
        where the run of each begins in that order: enough to tell the places."""
        place, share_of = (np.concatenate(parts) for parts in zip(*bags))
        by_bucket = np.argsort(place, kind="stable").astype(np.int32)
        ordered = place[by_bucket]
        runs = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        return share_of, np.array([len(b[0]) for b in bags]), by_bucket, ordered[runs], runs.astype(np.int32)

    def prior(self, toxic: int, clean: int) -> Model:
        """Without both kinds, every text gets the share of toxic rows, smoothed towards clean."""
        self.embedding[:] = 0
        self.bias[:] = 0, np.log((toxic + 0.5) / (clean + 1.5))
        return self

    def scorer(self) -> Scorer:
        return Scorer(self.embedding @ (self.softmax[1] - self.softmax[0]), float(self.bias[1] - self.bias[0]))


class Scorer:
    """What a fitted model adds to the log odds per bucket, and its bias: all that scoring needs."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), bias

    def score(self, texts: pa.Array, hasher: Hasher) -> np.ndarray:
        """Probability of label 1; a text without words gets the bias alone."""
        total, words = np.zeros(len(texts)), np.zeros(len(texts))
        held: list[bytes] = []
        owner: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            for part in parts_of(clean(text.as_py())):
                if held and size + len(part) > PART:
                    self._add(held, owner, total, words, hasher)
                    held, owner, size = [], [], 0
                held.append(part)
                owner.append(k)
                size += len(part)
        if held:
            self._add(held, owner, total, words, hasher)
        odds = total / np.maximum(words, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def _add(self, held, owner, total, words, hasher):
        found = Subwords(b" " + b" ".join(held) + b" ", hasher)
        begin = np.cumsum([1, *[len(p) + 1 for p in held[:-1]]])
        text = np.array(owner)[np.searchsorted(begin, found.lo, side="right") - 1]
        total += np.bincount(text, found.means(self.value), len(total))
        words += np.bincount(text, minlength=len(total))


def held_out(id_col: Column) -> Column:
    """A fifth of all rows, by their id; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Model:
    """Fit on the labelled rows of smallest id hash that are not held out, at most ``sample``,
    a quarter of them toxic; the driver never holds more than ``sample_words`` words of them. Null labels and ids
    and labels other than 0 and 1 do not count. Without labels of both kinds
    every text gets the share of toxic rows as its score, a quarter if there are none."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col).agg(F.max(label_col).alias("_label"))
    )
    first = [
        known.where(F.col("_label") == label).orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(part)
        for label, part in ((1, sample // 4), (0, sample - sample // 4))
    ]
    chosen = first[0].union(first[1])
    rows = (
        docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), id_col).select(id_col, "_text", "_label")
    )
    bags, kinds, total, hasher = [], [], 0, Hasher()
    # Every distinct text once: copies would outweigh the rest.
    seen: set[int] = set()
    for r in rows.repartition(32, F.xxhash64(id_col)).sortWithinPartitions(F.xxhash64(id_col, F.lit(12)), id_col).toLocalIterator():
        data = clean(r["_text"])
        key, words = text_key(data), data.split()
        if total + len(words) <= sample_words and words and key not in seen:
            seen.add(key)
            total += len(words)
            bags.append(Subwords(b" " + data + b" ", hasher).bag())
            kinds.append("toxic" if r["_label"] == 1 else "clean")
            # Short segments of clean texts are clean too. They keep the words of short texts,
            # where each counts for much, from looking like evidence.
            if kinds[-1] == "clean" and len(words) > SEGMENT:
                for at in range(0, len(words), SEGMENT):
                    bags.append(Subwords(b" " + b" ".join(words[at : at + SEGMENT]) + b" ", hasher).bag())
                    kinds.append("segment")
    model = Model()
    kinds = np.array(kinds)
    counts = {k: int((kinds == k).sum()) for k in WEIGHT}
    if not counts["toxic"] or not counts["clean"]:
        return model.prior(counts["toxic"], counts["clean"])
    each = {k: WEIGHT[k] / max(1, counts[k]) * len(bags) for k in WEIGHT}
    return model.fit(bags, (kinds == "toxic").astype(np.int64), np.array([each[k] for k in kinds]))


def with_scores(docs: DataFrame, model: Model, *keep: str, text_col: str = "text") -> DataFrame:
    """(_row, score) per input row, in whole texts; ``_row`` holds the columns ``keep``.

    Null and blank texts get the score of the bias. Repeated rows repeat. No input: no rows.
    """
    scorer = model.scorer()
    # Plain values: a broadcast object of this class would need the package on every executor.
    sent = docs.sparkSession.sparkContext.broadcast((scorer.value, scorer.bias))
    narrow, texts = row_and_text(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"_row": batch.column(0), "score": pa.array(Scorer(*sent.value).score(texts(batch), hasher), pa.float64())})

    return narrow.mapInArrow(trimmed(run), f"_row {narrow.schema[0].dataType.simpleString()}, score double")


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) per input row; see ``with_scores``."""
    scored = with_scores(docs, model, id_col, text_col=text_col).select(f"_row.{id_col}", "score")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
