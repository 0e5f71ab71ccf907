"""Strict JSON checks and comparisons on text columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.staged import Stages, bind
from evalspark.functions.text import S, strip

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}

# Fixed patterns: fenced blocks.
JSON_FENCE = rf"(?s)```json{S}*(.*?){S}*```"
BARE_FENCE = rf"(?s)```{S}*(.*?){S}*```"


def json_valid(text: Column) -> Column:
    """One complete JSON value and nothing after it.

    ``from_json`` ignores text after the first value. Wrapped once as a list item and
    once as an object member, only a single complete value satisfies both.
    """
    item = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    member = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))  # skips values, so cheaper
    return F.coalesce(item.isNotNull() & member.isNotNull(), F.lit(False))


def json_kind(text: Column) -> Column:
    """object, array, string, scalar; null when the text is not valid JSON."""
    head = F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)
    return F.when(
        json_valid(text),
        F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").otherwise("scalar"),
    )


def json_map(text: Column) -> Column:
    """Object members as text: scalars bare, nested values as JSON text, null as null."""
    return last_wins(F.from_json(text, "map<string,string>", STRICT))


def last_wins(members: Column) -> Column:
    """Of a repeated member name keep the last; a parsed map would be read by its first."""

    def dedup(m: Column) -> Column:
        entries = F.map_entries(m)

        def is_last(entry: Column, i: Column) -> Column:
            later = F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0)))
            return ~F.exists(later, lambda other: other["key"] == entry["key"])

        repeated = F.size(F.array_distinct(F.map_keys(m))) < F.size(m)
        return F.when(repeated, F.map_from_entries(F.filter(entries, is_last))).otherwise(m)

    return bind(members, dedup)


def set_member(text: Column, key: str, member: Column) -> Column:
    """JSON object text with one member (given as JSON text) replaced or added; the others stay.

    Numbers keep their spelling (1.0, 1e2): they pass the variant as marked strings.
    """
    members = last_wins(F.from_json(_mark_numbers(text), "map<string,variant>", STRICT))
    new = F.parse_json(_mark_numbers(member))

    def put(m: Column) -> Column:
        replaced = F.transform_values(m, lambda k, v: F.when(k == key, new).otherwise(v))
        return F.when(F.map_contains_key(m, F.lit(key)), replaced).otherwise(F.map_concat(m, F.create_map(F.lit(key), new)))

    return _unmark_numbers(F.to_json(bind(F.coalesce(members, F.create_map().cast("map<string,variant>")), put)))


def json_string(text: Column) -> Column:
    """Value of a JSON string."""
    return F.element_at(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT), 1)


def json_member_raw(text: Column, key: str) -> Column:
    """Member of a top-level object as JSON text that keeps its type (strings quoted)."""
    return _unmark_numbers(_marked_member(text, key))


def json_items_raw(text: Column, key: str) -> Column:
    """Items of an array member as JSON texts whose numbers are marked, for ``set_member``, which
    takes them back; null if the member is no array."""
    return F.from_json(_marked_member(text, key), "array<string>", STRICT)


def _marked_member(text: Column, key: str) -> Column:
    members = last_wins(F.from_json(_mark_numbers(text), "map<string,variant>", STRICT))
    return F.to_json(F.try_element_at(members, F.lit(key)))


# A private-use character marks a number that travels as a string.
_MARK = "\ue0f1"


def _mark_numbers(text: Column) -> Column:
    return _rewrite(text, lambda t: F.when(t.rlike("^-?[0-9]"), F.concat(F.lit(f'"{_MARK}'), t, F.lit('"'))).otherwise(t))


def _unmark_numbers(text: Column) -> Column:
    return F.regexp_replace(text, f'"{_MARK}([-+.0-9eE]+)"', "$1")


# Tokens of valid JSON text: a string, a number, or anything between them.
_TOKEN = r'("(?:[^"\\]|\\.)*+"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+)'


def canonical_json(text: Column) -> Column:
    """Text that is equal for equal values whatever the key order and spacing.

    A variant sorts keys but folds 1.0 into 1, which must stay different here, so
    numbers are first rewritten to tagged strings.
    """
    def tag(token: Column) -> Column:
        is_number = token.rlike("^-?[0-9]")
        real = token.rlike("[.eE]")
        number = F.when(real, F.concat(F.lit('"#f'), token.try_cast("double").cast("string"), F.lit('"'))).otherwise(
            F.concat(F.lit('"#i'), F.when(token == "-0", "0").otherwise(token), F.lit('"'))
        )
        return F.when(is_number, number).otherwise(token)

    tagged = _rewrite(text, tag)
    # Duplicate keys make a variant null; from_json keeps the last one and yields plain text.
    return F.coalesce(
        F.to_json(F.try_parse_json(tagged)),
        F.element_at(F.from_json(F.concat(F.lit("["), tagged, F.lit("]")), "array<string>", STRICT), 1),
    )


def _rewrite(text: Column, token_map) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), token_map), "")


def fold_booleans(text: Column) -> Column:
    """Valid JSON text with true and false outside strings, at any depth, as 1 and 0."""
    folded = lambda t: F.replace(F.replace(t, F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0"))
    return _rewrite(text, lambda t: F.when(t.startswith('"'), t).otherwise(folded(t)))


def dumped_json(text: Column) -> Column:
    """Valid JSON re-printed with one space after each comma and colon outside strings."""
    compact = F.element_at(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT), 1)

    def space(token: Column) -> Column:
        wide = F.replace(F.replace(token, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        return F.when(token.startswith('"'), token).otherwise(wide)

    return _rewrite(compact, space)


def fenced_json(text: Column, let: Stages) -> Column:
    """Content of the first ```json block; null when there is none."""
    block = let(_first_match(text, JSON_FENCE, "```json"))
    return F.when(block != "", F.regexp_extract(block, JSON_FENCE, 1))


def _first_match(text: Column, pattern: str, must_hold: str) -> Column:
    """First match or empty; the plain substring test spares most rows the pattern."""
    return F.when(F.contains(text, F.lit(must_hold)), F.regexp_extract(text, pattern, 0)).otherwise("")


def extract_json_text(text: Column, let: Stages) -> Column:
    """```json block, else bare block holding JSON, else trimmed JSON, else the text itself."""
    fenced = fenced_json(text, let)
    bare = let(strip(F.regexp_extract(_first_match(text, BARE_FENCE, "```"), BARE_FENCE, 1)))
    trimmed = let(strip(text))
    return let(F.coalesce(strip(fenced), F.when(_opens_json(bare), bare), F.when(_opens_json(trimmed), trimmed), text))


def _opens_json(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")
