"""Evidence for a question: excerpts in order of importance, cut to a token budget, batched by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.text import estimate_tokens
from prospectra.operators.ordered import spread_join


def collect_evidence(excerpts: DataFrame) -> DataFrame:
    """Excerpts (doc_id, prio, kind, page, chunk_id, text) without repeats.

    A page counts once; a search hit goes when its page was taken earlier as a page, or its
    chunk earlier as a hit. Firsts are found by partial aggregation, not by sorting a document.
    """
    first_page = F.struct("chunk_id", "text", "prio")
    pages = (excerpts.where("kind = 'page'").groupBy("doc_id", "page").agg(F.min_by(first_page, F.col("prio")).alias("f"))
             .select("doc_id", "page", "f.*"))
    hits = spread_join(excerpts.where("kind = 'hit'"), pages.select("doc_id", "page", F.col("prio").alias("taken")),
                       ["doc_id", "page"], ["prio"], "left")
    free = hits.where(F.col("taken").isNull() | (F.col("taken") > F.col("prio")))
    firsts = (free.groupBy("doc_id", "chunk_id").agg(F.min_by(F.struct("page", "text", "prio"), F.col("prio")).alias("f"))
              .select("doc_id", "chunk_id", "f.*"))
    columns = ["doc_id", "prio", "kind", "page", "chunk_id", "text"]
    return (pages.withColumn("kind", F.lit("page")).select(*columns)
            .unionByName(firsts.withColumn("kind", F.lit("hit")).select(*columns)))


def pack_budget(excerpts: Column, max_tokens: int) -> Column:
    """Excerpts (page, text), most important first, that fit the budget, in page order.

    One that does not fit is skipped, and a smaller later one may still fit, so this is a fold
    over the few excerpts of one call and not a running sum.
    """
    def step(s: Column, e: Column) -> Column:
        cost = estimate_tokens(e["text"]) + V.EXCERPT_OVERHEAD_TOKENS
        return F.when(s["used"] + cost <= max_tokens, F.struct(
            F.concat(s["kept"], F.array(e)).alias("kept"), (s["used"] + cost).alias("used"))).otherwise(s)

    start = F.struct(F.filter(excerpts, lambda e: F.lit(False)).alias("kept"), F.lit(0).cast("long").alias("used"))
    kept = F.aggregate(excerpts, start, step, lambda s: s["kept"])
    return F.array_sort(kept, lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0))


def page_batches(pages: Column, max_tokens: int = V.BATCH_TOKENS) -> Column:
    """Batch number (from 0) of each page (page, text): consecutive pages, a new batch when over budget."""
    def step(s: Column, p: Column) -> Column:
        cost = estimate_tokens(p["text"])
        over = (s["used"] > 0) & (s["used"] + cost > max_tokens)
        batch = F.when(over, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.concat(s["out"], F.array(F.struct(p["page"].alias("page"), batch.alias("batch")))).alias("out"), batch.alias("batch"),
                        F.when(over, cost).otherwise(s["used"] + cost).alias("used"))

    start = F.struct(F.array().cast("array<struct<page:int,batch:int>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"))
    return F.aggregate(pages, start, step, lambda s: s["out"])


def select_pages(pages: Column) -> Column:
    """The first page, and later ones that speak of approvals still to come."""
    return F.filter(pages, lambda p, i: (i == 0) | p["text"].rlike(V.PENDING_WORDING))


RISK_ANSWER = "number INT, headline STRING, category STRING, score INT, note STRING, _corrupt STRING"


def validate_answers(replies: DataFrame, column: str = "json") -> DataFrame:
    """Parses replies to the answer schema; `reject_reason` names why a row must be asked again, null when valid."""
    parsed = replies.withColumn("a", F.from_json(F.col(column), RISK_ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = (F.when(F.col("a._corrupt").isNotNull() | F.col("a").isNull(), "not valid JSON")
              .when(F.col("a.number").isNull() | F.col("a.headline").isNull() | F.col("a.category").isNull() | F.col("a.score").isNull(), "missing field")
              .when(~F.col("a.category").isin(*V.RISK_CATEGORIES), "unknown category")
              .when(~F.col("a.score").between(1, 5), "score out of range"))
    keep = [c for c in replies.columns if c != column]
    return parsed.select(*keep, "a.number", "a.headline", "a.category", "a.score", F.coalesce("a.note", F.lit("")).alias("note"),
                         reason.alias("reject_reason"))
