"""Case expansion: every turn of the tested role becomes one evaluation case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.generators import explode_computed
from evalspark.plans.numbering import number_rows
from evalspark.schemas import MESSAGE, TURN


def normalize_role(role: Column, role_test: str = "assistant") -> Column:
    """``human`` in any case becomes ``user``; the tested role takes its given spelling."""
    low = F.lower(role)
    return F.when(low == "human", "user").when(low == role_test, role_test).otherwise(role)


def is_target(role: Column, role_test: str = "assistant") -> Column:
    low = F.lower(role)
    return F.coalesce((low == role_test) & (low != "human"), F.lit(False))


def _turns() -> Column:
    return F.coalesce(F.col("turns"), F.array().cast(f"array<{TURN.simpleString()}>"))


def message_array(role_test: str = "assistant") -> Column:
    """System message first (blank when the sample has none), then one message per turn."""
    system = F.struct(
        F.lit("system").alias("role"),
        F.coalesce(F.col("meta.meta_description"), F.lit("")).alias("content"),
    )
    spoken = F.transform(
        _turns(),
        lambda t: F.struct(
            normalize_role(F.coalesce(t["role"], F.lit("")), role_test).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("content"),
        ),
    )
    return F.concat(F.array(system), spoken).cast(f"array<{MESSAGE.simpleString()}>")


def target_positions(role_test: str = "assistant") -> Column:
    """1-based turn positions of the tested role."""
    return F.array_compact(F.transform(_turns(), lambda t, i: F.when(is_target(t["role"], role_test), i + 1)))


def expand_cases(samples: DataFrame, role_test: str = "assistant") -> DataFrame:
    """One row per tested turn; ``messages`` ends with the reference turn.

    A narrow map: no shuffle, the ordinal comes from the turn array itself.
    """
    kept = [c for c in samples.columns if c not in ("meta", "turns", "raw")]
    staged = samples.select(*kept, message_array(role_test).alias("_messages"), target_positions(role_test).alias("_targets"))
    return explode_computed(staged, F.col("_targets"), "_nth", "_turn", *kept, "_messages").select(
        *kept,
        F.col("_nth").cast("long").alias("expanded_index"),
        F.slice("_messages", F.lit(1), F.col("_turn") + 1).alias("messages"),
        F.element_at("_messages", F.col("_turn") + 1)["content"].alias("reference_output"),
    )


def index_cases(samples: DataFrame, role_test: str = "assistant") -> DataFrame:
    """``expand_cases`` plus the global dense ``index`` in (original, expanded) order.

    Only (sample index, case count) pairs are numbered; the samples are then shuffled once to
    meet their first index. From a turn table use ``cases_from_turns``, which saves that.
    """
    counts = samples.select("original_index", F.size(target_positions(role_test)).cast("long").alias("_cases"))
    starts = number_rows(counts, ["original_index"], "_seq", "_cases", "_start").select("original_index", "_start")
    cases = expand_cases(samples.join(starts, "original_index"), role_test)
    return cases.withColumn("index", F.col("_start") + F.col("expanded_index")).drop("_start")


def turn_case_index(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", role_test: str = "assistant"
) -> DataFrame:
    """Case numbers straight from a turn table, without building conversation arrays.

    A conversation with very many turns is numbered by several tasks: ranges are cut on
    (conversation, turn), and the ordinal inside a conversation is a subtraction.
    """
    per_conv = turns.groupBy(conv).agg(F.count_if(is_target(F.col(role), role_test)).alias("_cases"))
    starts = number_rows(per_conv, [conv], "original_index", "_cases", "_start").drop("_cases")
    cases = turns.where(is_target(F.col(role), role_test)).select(conv, turn)
    return (
        number_rows(cases, [conv, turn], "index")
        .join(starts, conv)
        .select(conv, turn, "original_index", (F.col("index") - F.col("_start")).alias("expanded_index"), "index")
    )


def cases_from_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", role_test: str = "assistant"
) -> DataFrame:
    """``expand_cases`` with all indexes, from a turn table.

    Cases are counted on the narrow turn columns, so the texts move once, to be grouped, and
    meet their numbers on that partitioning.
    """
    from evalspark.sources.turns import group_turns

    per_conv = turns.groupBy(conv).agg(F.count_if(is_target(F.col(role), role_test)).alias("_cases"))
    starts = number_rows(per_conv, [conv], "original_index", "_cases", "_start").select(conv, "original_index", "_start")
    cases = expand_cases(group_turns(turns, conv, turn, role, text).join(starts, conv), role_test)
    return cases.withColumn("index", F.col("_start") + F.col("expanded_index")).drop("_start")


def split_reference(cases: DataFrame) -> DataFrame:
    """Prompt = all messages but the last; reference = content of the last."""
    return cases.withColumns({
        "user_input": F.slice("messages", F.lit(1), F.size("messages") - 1),
        "reference_output": F.element_at("messages", -1)["content"],
    })


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            role_test: str = "assistant") -> DataFrame:
    """All messages of a conversation up to each turn, from a turn table.

    The conversation is gathered once and sliced per turn, so the window state is not
    rebuilt row by row; the output itself is a full prefix per turn by definition.
    """
    message = F.struct(
        F.col(turn).alias("turn"),
        normalize_role(F.col(role), role_test).alias("role"),
        F.col(text).alias("content"),
    )
    ordered = turns.groupBy(conv).agg(F.array_sort(F.collect_list(message)).alias("_all"))
    return explode_computed(ordered, F.col("_all"), "_pos", "_this", conv, "_all").select(
        conv,
        F.col("_this.turn").alias(turn),
        F.transform(
            F.slice("_all", F.lit(1), F.col("_pos") + 1),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages"),
    )


def limit_samples(samples: DataFrame, n: int) -> DataFrame:
    """First ``n`` samples by index, before expansion; 0 keeps all."""
    return samples.where(F.col("original_index") < n) if n > 0 else samples


def smoke_cap(pending: DataFrame, test_mode: bool = False, cap: int | None = None) -> DataFrame:
    """For a trial run: in test mode keep only the first ``cap`` pending cases by index.

    Nothing is dropped unless ``test_mode`` asks for it, and then ``cap`` must be given. The
    output column ``test_mode`` is cleared for a capped run, as its results are real ones.
    """
    if test_mode and cap is None:
        raise ValueError("test mode needs a cap")
    if not test_mode:
        return pending.withColumn("test_mode", F.lit(False))
    head = pending.orderBy("index").limit(cap + 1)  # top-k, not a full sort
    size = head.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") > cap).alias("capped"))
    return (
        head.withColumn("_capped", size.scalar())
        .orderBy("index")
        .limit(cap)
        .withColumn("test_mode", ~F.col("_capped"))
        .drop("_capped")
    )


def assign_endpoint(cases: DataFrame, urls: Sequence[str]) -> DataFrame:
    """Round-robin: case ``index`` gets ``urls[index % n]``."""
    if isinstance(urls, str) or not urls:
        raise ValueError("urls must be a non-empty list")
    slot = F.pmod(F.col("index"), F.lit(len(urls))).cast("int") + 1
    return cases.withColumn("endpoint", F.element_at(F.array(*[F.lit(u) for u in urls]), slot))
