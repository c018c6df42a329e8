"""Conversation shaping: recent history, complete pairs, cited pages, admission of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import first_match, strip
from prospectra.operators.ordered import id_bucket, position


def recent_history(turns: DataFrame, last: int = V.HISTORY_TURNS, chars: int = V.HISTORY_CHARS) -> DataFrame:
    """One history text per conversation from its last turns (the ranking is cut before the shuffle)."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= last)
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    text = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit(V.TRIMMED_SUFFIX))).otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(speaker, text).alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(lines["line"], "\n\n").alias("history"))


def complete_pairs(messages: DataFrame) -> DataFrame:
    """Question/answer pairs whose answer is present, finished and free of errors.

    messages: conv_id, turn, text, error, stopped. Messages come in pairs by position.
    """
    placed = position(messages, ["conv_id"], [id_bucket(F.col("turn"))], [F.col("turn")], "pos")
    first = F.col("pos") % 2 == 1
    pairs = placed.groupBy("conv_id", F.floor((F.col("pos") - 1) / 2).alias("pair")).agg(
        F.max(F.when(first, F.col("text"))).alias("question"), F.max(F.when(~first, F.col("text"))).alias("answer"),
        F.bool_or(~first & (F.col("error").isNotNull() | F.coalesce("stopped", F.lit(False)))).alias("unusable"))
    return pairs.where((F.coalesce("answer", F.lit("")) != "") & ~F.col("unusable")).drop("unusable")


def non_empty_turns(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("error").isNull() & (strip(F.col("text")) != "")).select("conv_id", "turn", "role", "text")


def source_pages(sources: DataFrame) -> DataFrame:
    """Distinct cited pages of every message, ascending."""
    return sources.groupBy("message_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def validate_questions(questions: DataFrame) -> DataFrame:
    """Adds why a question is refused: blank, too long, unknown domain, too much history; null when accepted."""
    return questions.withColumn("reject_reason", first_match([
        (strip(F.col("question")) == "", "empty question"),
        (F.length("question") > V.MAX_QUESTION_CHARS, "question too long"),
        (~F.col("domain").isin(*V.DOMAINS), "unknown domain"),
        (F.col("history_turns") > V.MAX_HISTORY_TURNS, "history too long")]))
