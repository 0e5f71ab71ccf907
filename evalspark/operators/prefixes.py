"""Cases that share the messages of their conversation.

``expand_cases`` gives every case its whole prefix, so a conversation of n turns takes n squared
messages. Here messages are stored once, (conversation, place), and a case is (conversation, upto):
linear in the turns. Texts join in only where they are needed: a reference is one message,
a context window of k messages is k, and the whole prefix only for the cases that ask for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.cases import normalize_role, turn_case_index
from evalspark.plans.numbering import number_rows


def turn_places(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, at): the 1-based place of each turn in its conversation. Conversations of any
    length are numbered by many tasks: ranges are cut by (conversation, turn)."""
    numbered = number_rows(turns.select(conv, turn), [conv, turn], "_nth")
    firsts = numbered.groupBy(conv).agg(F.min("_nth").alias("_zero"))
    return numbered.join(firsts, conv).select(conv, turn, (F.col("_nth") - F.col("_zero") + 1).alias("at"))


def shared_messages(turns: DataFrame, places: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                    role_test: str = "assistant", meta: str | None = None) -> DataFrame:
    """(conv, at, role, content), each message once; at 0 is the system message."""
    spoken = turns.join(places, [conv, turn]).select(
        conv, "at", normalize_role(F.coalesce(F.col(role), F.lit("")), role_test).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    described = F.max(meta) if meta else F.lit(None).cast("string")
    system = turns.groupBy(conv).agg(F.coalesce(described, F.lit("")).alias("content"))
    return spoken.unionByName(system.select(conv, F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), "content"))


def shared_cases(turns: DataFrame, places: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 role_test: str = "assistant") -> DataFrame:
    """(conv, upto, original_index, expanded_index, index): a case's messages are those at 0 to
    ``upto``, the last of them the reference."""
    numbers = turn_case_index(turns, conv, turn, role, role_test)
    return numbers.join(places, [conv, turn]).select(conv, F.col("at").alias("upto"), "original_index", "expanded_index", "index")


def shared_form(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                role_test: str = "assistant", meta: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, messages) of a turn table. Write both: each is linear in the turns."""
    places = turn_places(turns, conv, turn)
    return shared_cases(turns, places, conv, turn, role, role_test), shared_messages(turns, places, conv, turn, role, text, role_test, meta)


def with_reference(cases: DataFrame, messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Add ``reference_output``: one message per case."""
    last = messages.select(conv, F.col("at").alias("upto"), F.col("content").alias("reference_output"))
    return cases.join(last, [conv, "upto"])


def with_last_messages(cases: DataFrame, messages: DataFrame, k: int, conv: str = "conv_id", system: bool = True) -> DataFrame:
    """Add ``messages``: the last ``k`` of each case, the reference included, after the system
    message (``system``): k rows per case, whatever the length of its conversation."""
    first = F.greatest(F.lit(1), F.col("upto") - k + 1)
    places = F.sequence(first, F.col("upto"))
    asked = cases.select(conv, "index", F.explode(F.concat(F.array(F.lit(0).cast("long")), places) if system else places).alias("at"))
    return cases.join(_gathered(asked.join(messages, [conv, "at"])), "index")


def with_messages(cases: DataFrame, messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Add ``messages``, the whole prefix, as ``expand_cases`` has it. Select the cases first: this
    writes the square of a conversation's length if all are asked."""
    asked = cases.select(F.col(conv).alias("_conv"), "index", "upto")
    met = asked.join(messages, (F.col("_conv") == F.col(conv)) & (F.col("at") <= F.col("upto")))
    return cases.join(_gathered(met), "index")


def _gathered(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("at", "role", "content")))
    return rows.groupBy("index").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))

