"""Dataset curation: search, batch edits, guarded edits, delete, append."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.jsons import canonical_json, json_items_raw, json_kind, json_map, json_member_raw, set_member
from evalspark.plans.bitmaps import BROADCAST_BYTES, RANGE, ROW_BYTES, bitmaps, directory, has, range_of, rank
from evalspark.plans.durable import stored
from evalspark.plans.generators import explode_computed
from evalspark.plans.numbering import number_rows
from evalspark.schemas import SAMPLE


def search_samples(samples: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over the JSON text of the whole item; blank matches all."""
    if not text.strip():
        return samples
    return samples.where(F.contains(F.lower("raw"), F.lower(F.lit(text))))


def distinct_roles(samples: DataFrame) -> DataFrame:
    """Non-empty roles in first-seen order, with the sample and turn that showed each first."""
    seen = explode_computed(samples, F.col("turns"), "pos", "t", "original_index")
    return first_seen(seen.select(F.col("t.role").alias("role"), "original_index", "pos"), "role", ["original_index", "pos"])


def first_seen(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    first = df.where(F.col(column) != "").groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return first.orderBy("_first").select(column, "_first.*")


def edit_meta(samples: DataFrame, value: str) -> DataFrame:
    """Set ``meta_description`` on every item; ``raw`` follows and keeps its other members."""
    if not value.strip():
        raise ValueError("meta_description must not be blank")
    edited = samples.withColumn("meta", F.struct(F.lit(value).alias("meta_description")))
    if "raw" not in samples.columns:
        return edited
    meta = F.coalesce(json_member_raw(F.col("raw"), "meta"), F.lit("{}"))
    return edited.withColumn("raw", set_member(F.col("raw"), "meta", set_member(meta, "meta_description", F.lit(json.dumps(value)))))


def edit_turn_text(samples: DataFrame, role: str, value: str) -> DataFrame:
    """Set the text of every turn with exactly this role; ``raw`` follows and keeps its other members."""
    if not role:
        raise ValueError("a role is required")

    def edit(turn: Column) -> Column:
        return F.when(turn["role"] == role, turn.withField("text", F.lit(value))).otherwise(turn)

    def edit_raw(turn: Column) -> Column:
        same_role = F.try_element_at(json_map(turn), F.lit("role")) == role
        return F.when(same_role, set_member(turn, "text", F.lit(json.dumps(value)))).otherwise(turn)

    edited = samples.withColumn("turns", F.transform("turns", edit))
    if "raw" not in samples.columns:
        return edited
    turns = json_items_raw(F.col("raw"), "turns")
    joined = F.concat(F.lit("["), F.array_join(F.transform(turns, edit_raw), ","), F.lit("]"))
    return edited.withColumn("raw", F.when(turns.isNull(), F.col("raw")).otherwise(set_member(F.col("raw"), "turns", joined)))


def reindex(samples: DataFrame, index: str = "original_index") -> DataFrame:
    """Close the gaps in ``index``. Only the index column is renumbered."""
    fresh = number_rows(samples.select(index), [index], "_fresh")
    return samples.join(fresh, index).withColumn(index, F.col("_fresh")).drop("_fresh")


def delete_items(samples: DataFrame, victims: DataFrame, index: str = "original_index") -> DataFrame:
    """Drop items by index and number the survivors densely.

    The victims become a directory: a bitmap per range of indexes, with the number of victims
    before it. An item's new index is its old one less the victims before it, so items are neither
    numbered again nor shuffled, unless the directory outgrows a broadcast. Items
    that are not numbered 0, 1, 2, ... are.
    """
    known = samples.agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if not known.n:
        return samples
    fits = (known.n // RANGE + 1) * ROW_BYTES <= BROADCAST_BYTES
    dense = fits and (known.lo, known.hi) == (0, known.n - 1) and bitmaps(samples, index).agg(F.sum("_count")).first()[0] == known.n
    if not dense:
        return reindex(samples.join(victims.select(index), index, "left_anti"), index)
    gone = directory(victims.where(F.col(index).between(0, known.hi)), index)
    ranges = samples.sparkSession.range(known.hi // RANGE + 1).withColumnRenamed("id", "_range").join(gone, "_range", "left")
    upto = F.last(F.col("_before") + F.col("_count"), True).over(Window.orderBy("_range"))
    shifts = stored(ranges.select(F.col("_range").alias("_in"), "_bits", F.coalesce("_before", upto, F.lit(0).cast("long")).alias("_before")), "directory")
    met = samples.join(F.broadcast(shifts), range_of(F.col(index)) == F.col("_in")).where(~has(F.col(index)))
    fresh = F.col(index) - F.col("_before") - rank(F.col(index))
    return met.select(*[fresh.cast(samples.schema[c].dataType).alias(c) if c == index else c for c in samples.columns])


def append_items(samples: DataFrame, new: DataFrame, index: str = "original_index") -> DataFrame:
    """Append items after the last index; ``new`` carries its own 0-based index."""
    size = samples.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("n"))
    shifted = new.withColumn(index, F.col(index) + size.scalar())
    return samples.unionByName(shifted, allowMissingColumns=True)


def append_counts(samples: DataFrame, new: DataFrame) -> DataFrame:
    """``added_count`` and ``total_count`` of an append."""
    added = new.agg(F.count(F.lit(1)).alias("added_count"))
    return added.withColumn(
        "total_count", F.col("added_count") + samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    )


def _same_keys(left: Column, right: Column) -> Column:
    return F.sort_array(F.json_object_keys(left)).eqNullSafe(F.sort_array(F.json_object_keys(right)))


def _turn_texts(members: Column) -> Column:
    return F.from_json(members["turns"], "array<string>")


def apply_edits(samples: DataFrame, edits: DataFrame, index: str = "original_index") -> DataFrame:
    """Replace items by edited JSON text; all items after the edit, with ``edited`` and ``reason``.

    ``samples`` and ``edits`` carry ``(index, raw)``. An edit may change only
    ``meta_description`` and turn texts, and must change one of them; otherwise the item
    stays as it was and ``reason`` says why.
    """
    both = samples.join(edits.select(index, F.col("raw").alias("_edit")), index, "left")
    staged = (
        both.withColumn("_kind", json_kind(F.col("_edit")))
        .withColumns({"_old": json_map(F.col("raw")), "_new": json_map(F.col("_edit"))})
        .withColumns({"_old_turns": _turn_texts(F.col("_old")), "_new_turns": _turn_texts(F.col("_new"))})
        .withColumn("reason", F.when(F.col("_edit").isNotNull(), _edit_problem()))
        .withColumn("edited", F.col("_edit").isNotNull() & F.col("reason").isNull())
        .withColumn("raw", F.when(F.col("edited"), F.col("_edit")).otherwise(F.col("raw")))
        .withColumn("_p", F.from_json("raw", SAMPLE))
    )
    return staged.select(index, "_p.meta", "_p.turns", "raw", "edited", "reason")


def _edit_problem() -> Column:
    """First violated rule, null for an acceptable edit."""
    old, new = F.col("_old"), F.col("_new")
    old_turns, new_turns = F.col("_old_turns"), F.col("_new_turns")
    pairs = F.arrays_zip(old_turns.alias("o"), new_turns.alias("n"))

    def member(text: Column, key: str) -> Column:
        return F.try_element_at(json_map(text), F.lit(key))

    def truthy(text: Column) -> Column:
        return F.coalesce(~text.isin("", "false", "0", "null"), F.lit(False))

    meta_both = truthy(old["meta"]) & truthy(new["meta"])
    turns_both = truthy(old["turns"]) & truthy(new["turns"])
    others = lambda m: F.map_filter(m, lambda k, _: ~k.isin("meta", "turns"))
    other_changed = F.exists(
        F.map_keys(others(old)),
        lambda k: ~canonical_json(F.to_json(F.array(F.try_element_at(old, k)))).eqNullSafe(
            canonical_json(F.to_json(F.array(F.try_element_at(new, k))))
        ),
    )
    meta_changed = ~member(old["meta"], "meta_description").eqNullSafe(member(new["meta"], "meta_description"))
    text_changed = turns_both & F.exists(pairs, lambda p: ~member(p["o"], "text").eqNullSafe(member(p["n"], "text")))
    return (
        F.when(F.coalesce(F.col("_kind") != "object", F.lit(True)), "not a JSON object")
        .when(~F.sort_array(F.map_keys(old)).eqNullSafe(F.sort_array(F.map_keys(new))), "structure changed")
        .when(meta_both & ~_same_keys(old["meta"], new["meta"]), "meta structure changed")
        .when(~meta_both & ~old["meta"].eqNullSafe(new["meta"]), "meta structure changed")
        .when(turns_both & (new_turns.isNull() | (F.size(new_turns) != F.size(old_turns))), "turns length changed")
        .when(turns_both & F.exists(pairs, lambda p: ~_same_keys(p["o"], p["n"])), "turn structure changed")
        .when(turns_both & F.exists(pairs, lambda p: ~member(p["o"], "role").eqNullSafe(member(p["n"], "role"))), "role changed")
        .when(~turns_both & ~old["turns"].eqNullSafe(new["turns"]), "turns structure changed")
        .when(other_changed, "another field changed")
        .when(~(meta_changed | text_changed), "no allowed change")
    )
