"""Chat formatting: turns of a conversation become one training text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOINER, NO_ROLE = "<|im_start|>", "<|im_end|>", "\n\n", "unknown"


def format_chats(conversations: DataFrame, opening: str = OPEN, closing: str = CLOSE, joiner: str = JOINER) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, n_messages, text).

    Turns are collected as structs and sorted; adjacent turns of one role are
    merged by array aggregation, their texts joined by ``joiner``; messages are
    concatenated as ``opening role newline text closing newline``.  Only Spark
    expressions are used, one shuffle on conv_id, and each turn is looked at a
    fixed number of times, so a conversation costs in proportion to its length.

    Defined cases: a null role reads "unknown"; a null text is empty and its
    turn stays; a null turn number sorts first; turns with equal numbers sort by
    role, then text; repeated rows are separate turns (and merge, being of one
    role); null conv_ids form one conversation; "<|" inside a role or a text
    becomes "< |" so that content can't close or open a message.  Other columns
    are ignored.  An empty table gives no rows.
    """

    def plain(c, instead):
        return F.replace(F.coalesce(F.col(c), F.lit(instead)), F.lit("<|"), F.lit("< |"))

    turns = conversations.select("conv_id", F.struct(F.col("turn"), plain("role", NO_ROLE).alias("role"), plain("text", "").alias("text")).alias("one"))
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    at = lambda i: F.element_at("turns", (i + 1).cast("int"))
    got = got.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i)["role"] != F.element_at("turns", F.greatest(i, F.lit(1)).cast("int"))["role"])),
    )
    # A message reaches from its start to the next message's start.
    got = got.withColumn(
        "messages",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                at(s)["role"].alias("role"),
                F.array_join(F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: t["text"]), joiner).alias("text"),
            ),
        ),
    )
    return got.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.concat(F.lit(opening), m["role"], F.lit("\n"), m["text"], F.lit(closing + "\n"))), "").alias("text"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM t
), b AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY rn) THEN 0 ELSE 1 END AS first FROM o
), m AS (
  SELECT *, sum(first) OVER (PARTITION BY conv_id ORDER BY rn) AS msg FROM b
), g AS (
  SELECT conv_id, msg, count(*) AS n, min(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS text FROM m GROUP BY conv_id, msg
)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY msg) AS text
FROM g GROUP BY conv_id
"""
