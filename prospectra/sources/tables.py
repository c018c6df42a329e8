"""Maintenance of the stored tables: replace, delete, list, reuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_KEY = ["domain", "filename"]


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: Sequence[str] = tuple(DOCUMENT_KEY)) -> DataFrame:
    """Stored rows with every incoming document replacing its earlier rows."""
    return stored.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming)


def delete_documents(stored: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that remain; apply to each child table with the same keys to cascade."""
    return stored.join(keys.select(*key).distinct(), list(key), "left_anti")


def delete_counts(stored: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows removed per requested key (0: no such document)."""
    asked = keys.select(*key).distinct()
    counts = stored.groupBy(*key).agg(F.count("*").alias("removed"))
    return asked.join(counts, list(key), "left").select(*key, F.coalesce("removed", F.lit(0).cast("long")).alias("removed"))


def list_documents(chunks: DataFrame, domain_order: Column) -> DataFrame:
    """Chunk and page count per stored document; domains in declared order, then by name."""
    return (chunks.groupBy("domain", "filename").agg(F.count("*").alias("chunks"), F.max("page").alias("pages"))
            .orderBy(domain_order, F.lower("filename")))


def latest_results(results: DataFrame) -> DataFrame:
    """The result saved last for every (doc_id, agent)."""
    return results.groupBy("doc_id", "agent").agg(
        F.max_by("status", F.struct("saved_at", "result_id")).alias("status"),
        F.max("saved_at").alias("saved_at"))


def work_left(items: DataFrame, results: DataFrame) -> DataFrame:
    """Work items whose latest saved result is not 'done'."""
    done = latest_results(results).where("status = 'done'").select("doc_id", "agent")
    return items.join(done, ["doc_id", "agent"], "left_anti")


def stale_reports(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Saved reports whose score or rating no longer matches the current one."""
    now = current.select("doc_id", F.col("score").alias("new_score"), F.col("rating").alias("new_rating"))
    return (saved.join(now, "doc_id").where(
        ~(F.col("score").eqNullSafe(F.col("new_score")) & F.col("rating").eqNullSafe(F.col("new_rating")))))
