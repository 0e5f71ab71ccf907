"""Turn tables (one row per turn) to and from samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.numbering import number_rows


def group_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                meta: str | None = None) -> DataFrame:
    """One row per conversation, without a sample number.

    A sample holds its turns as one array by definition, so a conversation must fit a row.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    described = F.max(meta) if meta else F.lit(None).cast("string")
    return turns.groupBy(conv).agg(packed.alias("_turns"), described.alias("_meta")).select(
        conv,
        F.struct(F.col("_meta").alias("meta_description")).alias("meta"),
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def samples_from_turns(turns: DataFrame, conv: str = "conv_id", **columns: str) -> DataFrame:
    """Samples numbered densely in the order of the conversation key."""
    numbers = number_rows(turns.select(conv).distinct(), [conv], "original_index")
    samples = group_turns(turns, conv, **columns).join(numbers, conv)
    return samples.withColumn("raw", F.to_json(F.struct("meta", "turns")))


def turns_from_samples(samples: DataFrame, key: str = "original_index") -> DataFrame:
    return samples.select(key, F.posexplode("turns").alias("turn", "_t")).select(
        key, F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text"
    )
