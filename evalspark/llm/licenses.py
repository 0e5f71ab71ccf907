"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates,
in DataFrame operations only.

A block is ``BLOCK`` consecutive words, wherever it starts, so a label does not depend on where
in the text a notice stands. A block matches a template if it holds at least ``THRESHOLD`` of the
template's distinct words. The templates are few and known, so the join runs in the row of the
document: nothing is shuffled, and equal ids or hot documents do not matter.

Blocks are judged inside stretches of two blocks, one starting at every block, so each block lies
in one. A stretch is searched for a template only if it passes the filters itself, and there only
the blocks that start with a template word (or end the text) are compared: a block that starts
with another word holds no more than the next one that does.

Three filters spare most comparisons and lose none. All template words have one global order,
rarest first by the number of documents with them, counted over the whole corpus. A template of
n words that must share a of them shares one of its first n - a + 1 (prefix); a stretch must hold
a template words (length); and after the first shared word, both sides must have a - 1 left
(position).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences of the licences' public texts.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "this work is licensed under the gnu general public license version",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial international license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
}
BLOCK = 64
THRESHOLD = 0.8


def phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<!{WORD})" + rf"{SEPARATORS}+".join(phrase.split()) + rf"(?!{WORD})"


def normal(text: Column) -> Column:
    """The words of a text in lower case, joined by one space. The Kelvin sign, whose lower case
    is an ASCII letter, becomes another letter first: only A-Z turn into a-z."""
    return F.trim(F.lower(F.replace(F.regexp_replace(text, SEPARATORS + "+", " "), F.lit("\u212a"), F.lit("\u0138"))))


def word_order(words: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """``vocabulary`` from the rarest to the most frequent by documents; one small row each."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    found = words.select(F.explode(F.array_intersect(known, "_words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    count = {r["word"]: r["n"] for r in found.collect()}
    return sorted(vocabulary, key=lambda v: (count.get(v, 0), v))


def shared_words(stretch: Column, template: list[str], need: int) -> Column:
    """How many words of ``template`` the stretch holds, 0 where the filters rule out ``need``.
    Both are in the global order."""
    whole = F.array(*[F.lit(w) for w in template])
    prefix = F.array(*[F.lit(w) for w in template[: len(template) - need + 1]])
    first = F.get(F.array_intersect(prefix, stretch), F.lit(0))
    left = F.least(F.lit(len(template) + 1) - F.array_position(whole, first), F.size(stretch) + 1 - F.array_position(stretch, first))
    return F.when(first.isNotNull() & (left >= need), F.size(F.array_intersect(whole, stretch))).otherwise(F.lit(0))


def last_start(words: str, block: int) -> Column:
    """Where the last whole block of a text starts, from 1; later ones hold no more."""
    return F.greatest(F.lit(1), F.size(words) - block + 1)


def best_share(stretches: str, words: str, template: list[str], need: int, block: int) -> Column:
    """The most words of ``template`` in any block of a stretch that has ``need``, else 0."""
    whole = F.array(*[F.lit(w) for w in template])
    last = last_start(words, block)
    near = F.filter(stretches, lambda b: shared_words(b["words"], template, need) >= need)
    starts = F.flatten(F.transform(near, lambda b: F.sequence(b["at"], F.least(b["at"] + block - 1, last))))
    kept = F.filter(starts, lambda s: (s == last) | F.array_contains(whole, F.element_at(words, s)))
    return F.coalesce(F.array_max(F.transform(kept, lambda s: F.size(F.array_intersect(whole, F.slice(words, s, F.lit(block)))))), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per input row.

    ``score`` is 1 with a phrase, else the largest share of a matching template, else 0. Null
    is the empty text: no words and no labels. Repeated rows and null ids keep their rows.
    """
    text = F.col("_text")
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    read = read.withColumn("_norm", normal(text)).withColumn("_words", F.split("_norm", " "))
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    rank = {w: k for k, w in enumerate(word_order(read.select("_words"), sorted(set().union(*sets.values()))))}
    ordered = {label: sorted(s, key=rank.__getitem__) for label, s in sets.items()}
    need = {label: math.ceil(threshold * len(s)) for label, s in sets.items()}
    prefixes = sorted({w for label, s in ordered.items() for w in s[: len(s) - need[label] + 1]})
    known = F.array(*[F.lit(w) for w in sorted(rank, key=rank.__getitem__)])

    counted = read.select(
        "_id", "_text", "_words", F.when(F.col("_norm") == "", 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
        # The plain search spares most texts the pattern, which alone tells A-Z from other capitals.
        *[F.when(F.contains("_norm", F.lit(p)), F.regexp_count(text, F.lit(phrase_pattern(p)))).otherwise(0).cast("long").alias(f"_n{k}") for k, p in enumerate(phrases)],
    )
    starts = F.sequence(F.lit(1), last_start("_words", block), F.lit(block))
    in_order = F.transform(starts, lambda s: F.struct(s.alias("at"), F.array_intersect(known, F.slice(F.col("_words"), s, F.lit(2 * block))).alias("words")))
    stretches = F.filter(in_order, lambda b: F.size(b["words"]) >= min(need.values()))
    places = counted.select(
        "_id", "_words", "n_words", *[f"_n{k}" for k in range(len(phrases))],
        *[F.when(F.col(f"_n{k}") > 0, words_before(text, rf"(?s)^(.*?){phrase_pattern(p)}")).alias(f"_first{k}") for k, p in enumerate(phrases)],
        *[F.when(F.col(f"_n{k}") > 0, words_before(text, rf"(?s)^(.*){phrase_pattern(p)}")).alias(f"_last{k}") for k, p in enumerate(phrases)],
        F.when(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in prefixes])), stretches).alias("_stretches"),
    )
    shared = places.select("*", *[best_share("_stretches", "_words", ordered[label], need[label], block).alias(f"_t{k}") for k, label in enumerate(templates)])
    base = F.array(*[F.when(F.col(f"_n{k}") > 0, label) for k, label in enumerate(phrases.values())])
    more = F.array(*[F.when(F.col(f"_t{k}") >= need[label], label) for k, label in enumerate(templates)])
    share = F.greatest(F.lit(0.0), *[F.when(F.col(f"_t{k}") >= need[label], F.col(f"_t{k}") / float(len(sets[label]))).otherwise(0.0) for k, label in enumerate(templates)])
    n_base = sum((F.col(f"_n{k}") for k in range(len(phrases))), F.lit(0)).cast("long")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(F.array_compact(labels))), ",")
    return shared.select(
        F.col("_id").alias(id_col), "n_words", n_base.alias("n_base"),
        F.array_min(F.array(*[f"_first{k}" for k in range(len(phrases))])).alias("first_word"),
        F.array_max(F.array(*[f"_last{k}" for k in range(len(phrases))])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def words_before(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.regexp_extract(text, pattern, 1), F.lit(WORD + "+")).cast("long")


def oracle() -> str:
    lists = {label: sorted(set(t.split())) for label, t in TEMPLATES.items()}
    sql_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    at = {label: f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {sql_list(p.split())})" for p, label in PHRASES.items()}
    hit = lambda k, label: f"t{k} >= {math.ceil(THRESHOLD * len(lists[label]))}"
    labels = lambda parts: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ','), '')"
    base = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(at)]
    more = [f"CASE WHEN {hit(k, label)} THEN '{label}' END" for k, label in enumerate(lists)]
    best = ", ".join(f"CASE WHEN {hit(k, label)} THEN t{k} / {float(len(words))} ELSE 0.0 END" for k, (label, words) in enumerate(lists.items()))
    known = ", ".join(f"({k}, '{word}')" for k, words in enumerate(lists.values()) for word in words)
    best_of = ", ".join(f"coalesce(max(n) FILTER (k = {k}), 0) AS t{k}" for k in range(len(lists)))
    # The best block may as well start at a word of the template, or is the last one of its text.
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
v(k, word) AS (VALUES {known}),
hits AS (SELECT r, k, i, word, last FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i, greatest(0, len(w) - {BLOCK}) AS last FROM d) JOIN v USING (word)),
starts AS (SELECT DISTINCT r, k, least(i, last) AS s FROM hits),
blocks AS (SELECT r, k, s, count(DISTINCT word) AS n FROM starts JOIN hits USING (r, k) WHERE i BETWEEN s AND s + {BLOCK - 1} GROUP BY ALL),
best AS (SELECT r, {best_of} FROM blocks GROUP BY r),
e AS (SELECT *, {', '.join(f'{x} AS p{k}' for k, x in enumerate(at.values()))} FROM d),
f AS (SELECT e.*, {', '.join(f'coalesce(t{k}, 0) AS t{k}' for k in range(len(lists)))}, list_sort(list_concat({', '.join(f'p{k}' for k in range(len(at)))})) AS p FROM e LEFT JOIN best USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, p[1]::BIGINT AS first_word, p[-1]::BIGINT AS last_word,
  {labels(base)} AS base_labels, {labels(base + more)} AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE greatest(0.0, {best}) END::DOUBLE AS score
FROM f
"""
