"""The risk register: headings joined with answers, ranked, counted, and cut into call-sized batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import exact_round, first_match, strip
from prospectra.functions.text import estimate_tokens, preview, shorten
from prospectra.operators.grounding import unsupported_figures
from prospectra.operators.ordered import id_bucket, position, running_before


def severity(score: Column) -> Column:
    return first_match([(score >= 4, "high"), (score == 3, "medium"), (score.isNotNull(), "low")])


def restored_headline(headline: Column, heading: Column) -> Column:
    """The headline, or the heading's own words when it states a figure the heading lacks."""
    return F.when(F.size(unsupported_figures(headline, heading)) > 0, shorten(heading)).otherwise(headline)


def build_register(headings: DataFrame, answers: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every heading with its answer; unanswered headings keep their shortened text and nulls."""
    joined = headings.join(answers.select(*on, "headline", "category", "score"), list(on), "left")
    headline = F.when(F.col("score").isNull(), shorten(F.col("text"))).otherwise(
        restored_headline(strip(F.col("headline")), F.col("text")))
    return joined.withColumns({"headline": headline, "severity": severity(F.col("score"))})


def rank_register(register: DataFrame) -> DataFrame:
    """Adds `rank`: highest score first, the document's own order within a score, unscored last."""
    score = F.coalesce("score", F.lit(0))
    return position(register, ["doc_id"], [F.negative(score), id_bucket(F.col("number"))], [F.col("number")], "rank")


def risk_counts(register: DataFrame) -> DataFrame:
    """One row per document: totals by score, severity and category (zero-filled) and the average score."""
    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    return register.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        *[n(F.col("score") == s).alias(f"score_{s}") for s in (5, 4, 3, 2, 1)],
        *[n(F.col("severity") == s).alias(f"severity_{s}") for s in ("high", "medium", "low")],
        *[n(F.col("category") == c).alias(f"category_{c}") for c in V.RISK_CATEGORIES],
        exact_round(F.try_divide(F.sum("score"), F.count("score")), 2).alias("average_score"))


def filter_register(register: DataFrame, severity_is: str | None = None, category_is: str | None = None) -> DataFrame:
    if severity_is:
        register = register.where(F.col("severity") == severity_is)
    return register.where(F.col("category") == category_is) if category_is else register


def top_risks(register: DataFrame, n: int, min_score: int = 4) -> DataFrame:
    """The n most serious risks per document; the limit applies before the shuffle."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "number")
    return register.where(F.col("score") >= min_score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def unanswered(asked: DataFrame, answers: DataFrame, on: Sequence[str]) -> DataFrame:
    """Items nobody answered."""
    return asked.join(answers.select(*on).distinct(), list(on), "left_anti")


def wanted_answers(answers: DataFrame, asked: DataFrame, on: Sequence[str]) -> DataFrame:
    """Answers to items that were asked; others are ignored."""
    return answers.join(asked.select(*on).distinct(), list(on), "left_semi")


def _with_running(headings: DataFrame) -> DataFrame:
    """Adds length, the running length before each heading, and the total length of its document."""
    sized = headings.withColumn("size", F.length("text").cast("long"))
    running = running_before(sized, ["doc_id"], [id_bucket(F.col("number"))], [F.col("number")], F.col("size"), "running")
    totals = headings.groupBy("doc_id").agg(F.sum(F.length("text").cast("long")).alias("total"))
    return running.join(totals, "doc_id")


def _batch(parts: Column) -> Column:
    """Batch number when a document is cut into `parts` of similar length."""
    return F.least(F.floor(F.col("running") / (F.col("total") / parts)), parts - 1)


def balanced_split(headings: DataFrame, parts: int) -> DataFrame:
    """Adds `batch`: headings in order, in `parts` batches of similar length."""
    return _with_running(headings).withColumn("batch", _batch(F.lit(parts).cast("long"))).drop("size", "running", "total")


def fewest_batches(headings: DataFrame, limit: int = V.CALL_TOKEN_LIMIT) -> DataFrame:
    """(doc_id, parts, reason): the smallest number of balanced batches that each fit the token limit; null with a reason where
    one heading alone does not fit. Headings are priced whole.

    A batch costs its headings' tokens and answers plus a fixed allowance. Fewer than
    total / limit batches can never fit, so trying starts there; nearly every document is
    settled within the first stretch of candidates, and only the others try the rest.
    """
    cost = estimate_tokens(F.col("text")) + V.ANSWER_TOKENS_PER_RISK
    priced = _with_running(headings).withColumn("cost", cost).select("doc_id", "running", "total", "cost")
    room = limit - V.REASONING_TOKENS
    sums = priced.groupBy("doc_id").agg(F.sum("cost").alias("sum"), F.count("*").alias("high"), F.max("cost").alias("most"))
    unfit = sums.where(F.col("most") > room).select("doc_id", F.lit(None).cast("long").alias("parts"), F.lit("heading too long").alias("reason"))
    bounds = (sums.where(F.col("most") <= room)
              .select("doc_id", "high", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("sum") / room)).alias("low"))
              .withColumn("middle", F.least("high", F.col("low") + F.ceil(F.col("low") / 8) + 1)))

    def smallest(candidates: DataFrame) -> DataFrame:
        tried = priced.join(candidates, "doc_id")
        batches = tried.groupBy("doc_id", "parts", _batch(F.col("parts")).alias("batch")).agg(F.sum("cost").alias("used"))
        fits = batches.groupBy("doc_id", "parts").agg(F.max("used").alias("worst")).where(F.col("worst") <= room)
        return fits.groupBy("doc_id").agg(F.min("parts").alias("parts"))

    near = smallest(bounds.select("doc_id", F.explode(F.sequence("low", "middle")).alias("parts")))
    open_ = bounds.join(near, "doc_id", "left_anti").where("middle < high")
    far = smallest(open_.select("doc_id", F.explode(F.sequence(F.col("middle") + 1, F.col("high"))).alias("parts")))
    return near.unionByName(far).withColumn("reason", F.lit(None).cast("string")).unionByName(unfit)
