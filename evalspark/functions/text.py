"""Text building blocks. All return Columns and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace and word classes the reference results depend on,
# written out because Java's \s and \w cover other characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Single characters below 256 are one table to Java, and one comparison tells that a letter is none of the rest.
S = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"

# Fixed value: sentence boundary (whitespace after . or ?, not after abbreviations).
# The whitespace comes first and the look-behinds reach over it, so that other characters fail at once.
SENTENCE_BREAK = rf"{S}(?<=[.?]{S})(?<!{W}\.{W}[^\n]{S})(?<![A-Z][a-z]\.{S})"
# Whitespace that is not one blank already.
LOOSE = rf" {S}+|[{S}&&[^ ]]{S}*"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(strip(text), LOOSE, " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{W}+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({W}+)"), F.lit(1))


def first_word(text: Column) -> Column:
    """First word or the empty string; stops at the first match."""
    return F.regexp_extract(text, f"({W}+)", 1)


def sentences(text: Column) -> Column:
    return _pieces(F.split(text, SENTENCE_BREAK, -1))


def paragraphs(text: Column) -> Column:
    return _pieces(F.split(text, "\n\n", -1))


def lines(text: Column) -> Column:
    return _pieces(F.split(text, "\n", -1))


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda piece: piece != "")


def count_substr(text: Column, needle: Column) -> Column:
    """Case-insensitive count of non-overlapping occurrences."""
    return count_low(F.lower(text), F.lower(needle))


def count_low(hay: Column, pin: Column) -> Column:
    """The same of texts that are in lower case already."""
    removed = F.length(hay) - F.length(F.replace(hay, pin, F.lit("")))
    per_hit = F.nullif(F.length(pin), F.lit(0))
    return F.coalesce((removed / per_hit).cast("int"), F.length(hay) + 1)


# Relation names of the comparison arguments.
def relation_cmp(actual: Column, target: Column, relation: Column) -> Column:
    """Compare a number with a textual target; anything that is not a number fails."""
    left, right = actual.try_cast("double"), target.try_cast("double")
    return F.coalesce(
        F.when(relation == "less than", left < right)
        .when(relation == "greater than", left > right)
        .when(relation == "at least", left >= right)
        .when(relation == "at most", left <= right)
        .when((relation == "equal") | (relation == "") | relation.isNull(), left == right),
        F.lit(False),
    )


def rouge_tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
