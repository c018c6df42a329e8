"""Facts, citations, digests and catalogue views assembled from the finished parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import fill, strip
from prospectra.functions.text import strip_inline_ids

# Order and letter of the fact sources, and how a fact is worded.
PREFIXES = "FRBOL"
FACT_TEXT = {
    "description": "What it does: {text}",
    "strength": "Strength: {text}",
    "weakness": "Weakness: {text}",
    "market_position": "Market position: {text}",
    "governance": "Governance: {text}",
    "related_party": "Related parties: {text}",
    "sellers": "Offer for sale by {names}",
    "peers": "Listed peers' P/E: {low} to {high}, average {mean}",
    "pending": "Approval pending: {item}",
    "signal": "{dimension}: {signal}. {reason}",
    "flag": "{severity} flag: {message}",
    "risks": "{total} risk factors, average score {average} out of 5 ({high} scored 4-5)",
    "risk": "Risk factor {number} ({category}, score {score}): {headline}",
    "promoters": "Promoters: {names}. {reason}",
    "not_pledged": "No promoter shares are pledged",
    "pledged": "Some promoter shares are pledged",
    "fresh_issue": "Fresh issue of ₹{amount} m",
    "fresh_shares": "Fresh issue of {shares} shares (price not yet fixed)",
    "use": "Use of proceeds: {purpose}{amount}",
    "cases": "Cases against the company, promoters and directors: {cases}. Claims total ₹{amount} m{share}",
}
DIGEST_TEXT = {
    "score": "Rubric score {score}/100: {rating} ({quadrant}). {parts}.",
    "knockout": "Rating capped at Neutral: {reason}.",
    "scorecard": "Financial scorecard: {signals}",
    "flags": "Financial flags: {flags}",
    "summary": "Financial summary: {text}",
    "risks": "{total} risk factors, average score {average}/5.",
    "risk": "Risk {number} (score {score}, p. {page}): {headline}",
    "promoters": "Promoters: {names}. {reason}, {pledged}.",
    "pledged": "some shares pledged",
    "not_pledged": "no shares pledged",
    "pledge_unknown": "pledging not stated",
    "offer": "Offer: fresh issue {fresh} ({unit}), offer for sale {sold} shares. Money for: {uses}.",
    "cases": "Cases against the company, promoters and directors: {cases}; claims ₹{amount} m{share}.",
    "report": "Report summary: {text}",
}


def fact(prefix: str, source: int, order: Column, text: Column, pages: Column | None = None) -> list[Column]:
    """Columns of one fact source: its letter, its place among the sources, the order inside it, text and pages."""
    none = F.array().cast("array<int>")
    return [F.lit(prefix).alias("prefix"), F.lit(source).alias("source"), order.cast("long").alias("ord"), strip(text).alias("text"),
            (none if pages is None else F.array_sort(F.array_distinct(pages))).alias("pages")]


def collect_facts(sources: list[DataFrame]) -> DataFrame:
    """(doc_id, fact_id, text, pages): all sources in fixed order, empty ones skipped, numbered per letter.

    A document has at most a few dozen facts, so numbering happens on one small array per document and letter.
    """
    rows = reduce(DataFrame.unionByName, sources).where("text IS NOT NULL AND text <> ''")
    packed = rows.groupBy("doc_id", "prefix").agg(F.array_sort(F.collect_list(F.struct("source", "ord", "text", "pages"))).alias("f"))
    return packed.select("doc_id", "prefix", F.posexplode("f").alias("i", "x")).select(
        "doc_id", F.concat("prefix", (F.col("i") + 1).cast("string")).alias("fact_id"), "x.text", "x.pages")


def cite_points(points: DataFrame, facts: DataFrame, at_most: int = 3) -> DataFrame:
    """Points (doc_id, point_no, text, fact_ids) with known facts only, the union of their pages, and what was dropped."""
    used = points.where(F.col("point_no") <= at_most)
    cited = used.select("doc_id", "point_no", F.posexplode("fact_ids").alias("i", "fact_id")).join(
        facts.select("doc_id", "fact_id", "pages", F.lit(True).alias("known")), ["doc_id", "fact_id"], "left")
    resolved = cited.groupBy("doc_id", "point_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("i", "fact_id"))))["fact_id"].alias("facts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("fact_id")))).alias("dropped"))
    return used.select("doc_id", "point_no", strip_inline_ids(F.col("text")).alias("text")).join(resolved, ["doc_id", "point_no"], "left")


def joined(rows: DataFrame, key: str, order: str, text: Column, separator: str) -> DataFrame:
    """(doc_id, <key>): the texts of a document's rows in order, as one; a document has at most a few dozen."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy("doc_id").agg(F.array_join(packed["t"], separator).alias(key))


def analysis_digest(lines: list[DataFrame]) -> DataFrame:
    """One summary text per document from lines (doc_id, source, ord, text), in source order."""
    rows = reduce(DataFrame.unionByName, lines).where("text IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("source", "ord", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(ordered["text"], "\n").alias("digest"))


def list_analyses(results: DataFrame) -> DataFrame:
    """Per document when it finished and the latest status of every agent as a map, newest first."""
    latest = results.groupBy("doc_id", "agent").agg(F.max_by("status", F.struct("saved_at", "result_id")).alias("status"), F.max("saved_at").alias("at"))
    return (latest.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "status")))).alias("agents"),
                                         F.max("at").alias("finished_at"))
            .orderBy(F.desc("finished_at"), "doc_id"))


def analysis_view(documents: DataFrame, results: DataFrame, agents: Sequence[str]) -> DataFrame:
    """A document with its sections in order (null if it has none) and, as a column each, every agent's latest status (doc_id, agent, result_id, status)."""
    ordered = F.array_sort(F.transform("sections", lambda s: F.struct(*[s[c].alias(c) for c in ("pos", "title", "key", "start_page", "end_page")])))
    states = results.groupBy("doc_id").agg(*[F.max_by("status", F.when(F.col("agent") == a, F.col("result_id"))).alias(a) for a in agents])
    return documents.withColumn("sections", F.when(F.size("sections") > 0, ordered)).join(states, "doc_id", "left")


def warnings_rollup(warnings: DataFrame) -> DataFrame:
    """(doc_id, agent, warnings): every agent's warnings in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "warning")))
    return warnings.where("warning IS NOT NULL").groupBy("doc_id", "agent").agg(ordered["warning"].alias("warnings"))


def readable(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))
