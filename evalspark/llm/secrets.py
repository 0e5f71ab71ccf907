"""Secret scans: pattern rules, and a token-efficiency test for strings that no rule knows.

A subword vocabulary spells ordinary words, names and even long compounds in few tokens, while
a random string falls apart into pieces of one or two characters. So a run of key characters
with fewer than ``RATIO`` characters per token is reported, unless it is a known kind of harmless
string: a digest (hex of a digest's length), a UUID, a time stamp, or an identifier, whose parts
between separators are words, numbers or a word with a number. Of 4,000 random strings of 20 or
more characters over letters and digits, 99 in 100 have fewer than 2 characters per token.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Every access key and hex string lies inside one run of key characters.
RUN_LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN_LEAST)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
RATIO = 2.0
# Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512; layouts of UUIDs and time stamps.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
STAMP = re.compile(r"\d{4}-?\d\d-?\d\d[T_-]?\d\d-?\d\d(-?\d\d)?Z?")
PART = re.compile(r"[A-Za-z]*[0-9]*|[0-9]+[A-Za-z]+")
SEPARATORS = re.compile(r"[-+/_]")
SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("kind", pa.string())]))


def harmless(run: str) -> bool:
    """Known digests and identifiers."""
    body = run.rstrip("=")
    if len(body) in DIGESTS and ALL_HEX.fullmatch(body) or UUID.fullmatch(body) or STAMP.fullmatch(body):
        return True
    return all(PART.fullmatch(p) for p in SEPARATORS.split(body))


def encoder(path: str, pattern: str):
    """The vocabulary, read once per task."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def find(text: str | None, encode, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    odd: list[tuple[int, int]] = []
    for m in RUN.finditer(text):
        run, at = m.group(), m.start()
        spans += [(at + a.start(), at + a.end(), "access") for a in ACCESS.finditer(run) if len(a.group()) >= ACCESS_LEAST]
        spans += [(at + h.start(), at + h.end(), "hex") for h in HEX.finditer(run)]
        if not harmless(run) and len(run) < ratio * len(encode(run)):
            odd.append(m.span())
    if odd:
        # The rules' spans are reported already; a run that meets one of them is the same find.
        spans += [(lo, hi, "random") for lo, hi in odd if not any(a < hi and lo < b for a, b, _ in spans)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, vocabulary: str, pattern: str, *keep: str, text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """(_row, spans) per input row, in whole texts and without a shuffle; ``_row`` holds the columns
    ``keep``, ``spans`` (lo, hi, kind) in code points, by start, then kind.

    ``vocabulary`` is a rank file that every worker must reach, ``pattern`` how its tokenizer
    splits words. Null and empty texts have no spans. Repeated rows and null ids keep their rows.
    """
    narrow = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            texts = batch.column(1)
            found = [find(texts[k].as_py(), encode, ratio) for k in range(len(texts))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([[{"lo": lo, "hi": hi, "kind": kind} for lo, hi, kind in f] for f in found], SPANS)], names=["_row", "spans"]
                )

    return narrow.mapInArrow(run, f"_row {narrow.schema[0].dataType.simpleString()}, spans array<struct<lo:long,hi:long,kind:string>>")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
