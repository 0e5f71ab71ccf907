"""ROUGE-1, ROUGE-2 and ROUGE-L F-measures.

Both texts of a case are in one row, so all three are a narrow map: one Arrow batch step counts
shared n-grams and the longest common subsequence of the token arrays. Nothing is shuffled and
rows need no key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.staged import Stages
from evalspark.functions.text import rouge_tokens
from evalspark.operators.scoring import Case, outcome, register_scorer


def _lcs(left: Sequence[str], right: Sequence[str]) -> int:
    """Length of the longest common subsequence, one bit per left token.

    Bit-parallel recurrence (Hyyrö 2004): linear in ``right`` with word-parallel
    integer operations, so long texts need no quadratic table.
    """
    width = len(left)
    masks: dict[str, int] = {}
    for i, token in enumerate(left):
        masks[token] = masks.get(token, 0) | (1 << i)
    full = (1 << width) - 1
    row = full
    for token in right:
        hit = masks.get(token)
        if hit:
            keep = row & hit
            row = ((row + keep) | (row - keep)) & full
    return width - row.bit_count()


def _shared(left: Sequence[str], right: Sequence[str], n: int) -> int:
    """Common n-grams, each counted as often as both sides have it."""
    grams = [Counter(zip(*(tokens[i:] for i in range(n)))) for tokens in (left, right)]
    return (grams[0] & grams[1]).total()


def overlaps(left: Column, right: Column) -> Column:
    """Struct of shared unigrams ``one``, shared bigrams ``two`` and subsequence length ``lcs``."""
    # Built per call: a module-level pandas_udf would need a running session at import.
    @F.pandas_udf("one long, two long, lcs long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lefts, rights in batches:
            pairs = [(list(a), list(b)) for a, b in zip(lefts, rights)]
            rows = [(_shared(a, b, 1), _shared(a, b, 2), _lcs(a, b)) for a, b in pairs]
            yield pd.DataFrame(rows, columns=["one", "two", "lcs"], dtype="int64")

    return run(left, right)


def f_measure(overlap: Column, predicted: Column, target: Column) -> Column:
    precision = overlap / F.greatest(predicted, F.lit(1))
    recall = overlap / F.greatest(target, F.lit(1))
    return F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))


def measures(reference: Column, output: Column, let: Stages) -> dict[str, Column]:
    """``rouge1``, ``rouge2`` and ``rougeL``; 0 where a side has no such grams."""
    want, got = let(rouge_tokens(F.coalesce(reference, F.lit("")))), let(rouge_tokens(F.coalesce(output, F.lit(""))))
    found = let(overlaps(want, got))
    pairs = lambda tokens: F.greatest(F.size(tokens) - 1, F.lit(0))
    return {
        "rouge1": f_measure(found["one"], F.size(got), F.size(want)),
        "rouge2": f_measure(found["two"], pairs(got), pairs(want)),
        "rougeL": f_measure(found["lcs"], F.size(got), F.size(want)),
    }


def with_rouge(df: DataFrame) -> DataFrame:
    """Add the three measures of ``model_output`` against ``reference_output``."""
    let = Stages.for_frame(df)
    found = measures(F.col("reference_output"), F.col("model_output"), let)
    return let.add_to(df).withColumns(found).drop(*let.names)


@register_scorer("rouge", "ROUGE-1, -2 and -L F-measures; the score is ROUGE-L")
def rouge(case: Case) -> Column:
    found = measures(case.reference_output, case.model_output, case.let)
    return outcome(found["rougeL"], F.lit(0), F.struct(*[c.alias(name) for name, c in found.items()]))
