"""Job progress and token usage, as batch queries and as their streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import lookup
from prospectra.operators.ordered import id_bucket, position, running_before

WINDOW_SECONDS = 60


def event_status(event: Column) -> Column:
    return F.coalesce(lookup(event, V.STEP_STATUS), F.lit("running"))


def latest_steps(events: DataFrame) -> DataFrame:
    """Latest status of every (job_id, step) seen; also valid on a stream in update mode."""
    return events.groupBy("job_id", "step").agg(
        F.max_by(event_status(F.col("event")), F.struct("ts", "event_id")).alias("status"))


def step_status(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, step, status) for every step of every job: unseen steps wait, running steps of a failed job failed.

    jobs: job_id, job_status.
    """
    steps = jobs.select("job_id", "job_status", F.explode(F.array(*[F.lit(s) for s in V.STEPS])).alias("step"))
    seen = F.coalesce("status", F.lit("waiting"))
    return steps.join(latest_steps(events), ["job_id", "step"], "left").select("job_id", "step", F.when(
        (F.col("job_status") == "failed") & (seen == "running"), "failed").otherwise(seen).alias("status"))


def events_after(events: DataFrame, after: int) -> DataFrame:
    """Events of every job beyond its first `after`, with the job's total. Jobs of any size are numbered in buckets."""
    numbered = position(events, ["job_id"], [id_bucket(F.col("event_id"))], [F.col("event_id")], "n")
    totals = events.groupBy("job_id").agg(F.count("*").alias("event_count"))
    return numbered.where(F.col("n") > after).join(totals, "job_id")


def _seconds(ts: Column) -> Column:
    """Exact epoch seconds of a zone-free timestamp."""
    return (ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)")


def trailing_usage(calls: DataFrame) -> DataFrame:
    """Adds tokens and output tokens of the same model over the last 60 seconds, the call itself included.

    A call exactly 60 seconds old has left. Calls are cut into minutes, and each minute also
    receives the previous one, so a busy model is spread over its minutes instead of one task.
    """
    timed = calls.withColumn("__s", _seconds(F.col("ts")))
    minute = F.floor(F.col("__s") / WINDOW_SECONDS)
    copies = timed.withColumn("__m", F.explode(F.array(minute, minute + 1))).withColumn("__own", F.col("__m") == minute)
    micros = (F.col("__s") * 1000000).cast("long")
    frame = Window.partitionBy("model", "__m").orderBy("__us").rangeBetween(-(WINDOW_SECONDS * 1000000 - 1), 0)
    summed = copies.withColumn("__us", micros).withColumns({
        "used": F.sum("tokens").over(frame), "used_output": F.sum("output_tokens").over(frame)})
    return summed.where("__own").drop("__s", "__m", "__us", "__own")


def budget_breaches(calls: DataFrame, tokens: int = V.TOKENS_PER_MINUTE, output: int = V.OUTPUT_TOKENS_PER_MINUTE) -> DataFrame:
    """Calls that would push their model over a per-minute budget."""
    return trailing_usage(calls).where((F.col("used") > tokens) | (F.col("used_output") > output))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Adds how many queued jobs were created before each job (created_id is unique and follows creation)."""
    queued = (F.col("job_status") == "queued").cast("long")
    return running_before(jobs, [], [id_bucket(F.col("created_id"))], [F.col("created_id")], queued, "queue_position")


# ------------------------------------------------------------------ streams
def stream_step_status(events: DataFrame) -> DataFrame:
    """Streaming latest_steps: write with outputMode('update')."""
    return latest_steps(events)


def stream_usage(calls: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Tokens per model in sliding minutes (10-second steps): the streaming approximation of trailing_usage."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", f"{WINDOW_SECONDS} seconds", "10 seconds"), "model").agg(
        F.sum("tokens").alias("used"), F.sum("output_tokens").alias("used_output"))


def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Admits a document's submissions in order of arrival; state: when its last admitted job ends, in microseconds."""
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    until = state.get[0] if state.exists else None
    kept = []
    for at, length in zip(rows["at"].tolist(), rows["length"].tolist()):
        kept.append(until is None or at >= until)
        if kept[-1]:
            until = at + length
    state.update((until,))
    yield rows.loc[kept, ["doc_id", "event_id"]]


def dedupe_submissions(submissions: DataFrame) -> DataFrame:
    """(doc_id, event_id) of the submissions that start a job: one that comes while an earlier job of its document has not ended is
    not queued again. submissions: doc_id, event_id, ts and seconds, how long its job would take. One number per document is
    kept as state; files that arrive in the order of time give the same rows however they fall into micro-batches.
    """
    micros = (_seconds(F.col("ts")) * 1000000).cast("long")
    timed = submissions.select("doc_id", "event_id", micros.alias("at"), (F.col("seconds") * 1000000).cast("long").alias("length"))
    return timed.groupBy("doc_id").applyInPandasWithState(admit, "doc_id long, event_id long", "until long", "append", GroupStateTimeout.NoTimeout)
