"""Chat formatting: each assistant turn is an example of its own, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm.common import read

OPEN, MIDDLE, CLOSE = "<turn>", "\n", "\n</turn>"
TRAINED_ROLE = "assistant"
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def escaped(text: Column, line_ends: bool = False) -> Column:
    r"""Text without any `<`, so that no marker can stand in it: `\` becomes `\s`, `<` becomes `\l`, and in roles an end of line `\n`."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_ends else out


def unescaped(text: Column, line_ends: bool = False) -> Column:
    r"""Undoes `escaped`. Each `\` of escaped text belongs to the letter behind it, so the order of the others is free and `\s` comes last."""
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if line_ends else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start and loss_end: one row per assistant turn, numbered in order.

    formatted holds the conversation from its first turn to that reply; loss_start..loss_end are the code points of the reply's
    escaped text, the only trainable part. Turns behind the last reply, or a conversation without one, give a closing example
    whose bounds are null, so no turn is lost. Turns stand by turn number, role and text, nulls first; repeated turns stay.
    Null roles and texts are empty; rows with a null conv_id are one conversation; an empty table gives no row; other columns are not read.
    A conversation is one document, so its turns are gathered in one row; the number of examples times their context is what the format asks for.
    """
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE)))
    ends = F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == TRAINED_ROLE) | (i == F.size("turns") - 1), i + 1)), lambda i: i.isNotNull())
    rows = turns.select("conv_id", "turns", pieces.alias("pieces"), F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("turns", F.col("upto"))
    rows = rows.select("conv_id", F.col("example").cast("long").alias("example"), F.array_join(F.slice("pieces", 1, F.col("upto")), "").alias("formatted"),
                       F.when(last["role"] == TRAINED_ROLE, F.length(escaped(last["text"]))).alias("trained"))
    end = F.length("formatted") - len(CLOSE)
    return rows.select("conv_id", "example", "formatted", (end - F.col("trained")).cast("long").alias("loss_start"),
                       F.when(F.col("trained").isNotNull(), end).cast("long").alias("loss_end"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>, with their own strings."""
    bodies = F.transform(F.filter(F.split(formatted, CLOSE), lambda p: p != ""), lambda p: F.substring(p, len(OPEN) + 1, F.length(p)))
    role = lambda b: F.substring_index(b, MIDDLE, 1)        # noqa: E731  a role has no end of line of its own
    return F.transform(bodies, lambda b: F.struct(unescaped(role(b), True).alias("role"), unescaped(F.substring(b, F.length(role(b)) + 2, F.length(b))).alias("text")))


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one whose texts hold the template's own control strings."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    read_back = examples(with_probe(read(spark, sf_dir, "conversations"))).groupBy("conv_id").agg(
        turns_of(F.max_by("formatted", "example")).alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss_end").isNotNull(), F.struct("example", reply.alias("reply"))))), lambda e: e["reply"]), "").alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                            F.length("replies").cast("long").alias("loss_chars"), F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, role = 'assistant' AS trained, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS k,
             sum(6 + 1 + 8 + length(role) + length(text) + 2 * length(role) - length(replace(replace(role, '\', ''), '<', '')) - length(replace(role, chr(10), ''))
                 + length(text) - length(replace(replace(text, '\', ''), '<', ''))) OVER w AS upto
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(CASE WHEN trained THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE trained), '')) AS loss_sha256,
       sum(CASE WHEN trained OR i = k THEN upto END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
