"""Jobs, token usage, accuracy checks, and streams replayed to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import fixed
from prospectra.operators import accuracy as A
from prospectra.plans.inputs import check_sql, derived, table
from prospectra.plans.registry import Registry
from prospectra.plans.structure_queries import packed_sql
from prospectra.streaming import ingest, jobs as J
from prospectra.streaming.replay import file_stream, replay, work_dir, replay_updates

STATUS_SQL = "CASE event WHEN 'started' THEN 'running' WHEN 'progress' THEN 'running' WHEN 'waiting' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'running' END"


def job_rows(spark, sf):
    """One job per user: its status follows the user number, its creation the first event."""
    e = derived(spark, sf, "job_events")
    status = F.when(F.col("job_id") % 5 == 0, "failed").when(F.col("job_id") % 3 == 0, "queued").otherwise("running")
    return e.groupBy("job_id").agg(F.min("event_id").alias("created_id")).withColumn("job_status", status)


def register(r: Registry) -> None:
    jobs_sql = """jobs AS (SELECT job_id, min(event_id) AS created_id, CASE WHEN job_id % 5 = 0 THEN 'failed' WHEN job_id % 3 = 0 THEN 'queued' ELSE 'running' END AS job_status
       FROM job_events GROUP BY job_id)"""
    r.add("step_status", lambda spark, sf: J.step_status(derived(spark, sf, "job_events"), job_rows(spark, sf)), f"""
        WITH {check_sql('job_events')}, {jobs_sql}, l AS (SELECT job_id, step, arg_max({STATUS_SQL}, event_id) AS status FROM job_events GROUP BY ALL),
        s(step) AS (VALUES {', '.join(f"('{x}')" for x in V.STEPS)})
        SELECT j.job_id, s.step, CASE WHEN job_status = 'failed' AND status = 'running' THEN 'failed' ELSE coalesce(status, 'waiting') END AS status
        FROM jobs j, s LEFT JOIN l ON l.job_id = j.job_id AND l.step = s.step""")
    r.add("events_after", lambda spark, sf: J.events_after(derived(spark, sf, "job_events"), 40).select("job_id", "event_id", "n", "event_count", "message"), f"""
        WITH {check_sql('job_events')} SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY job_id) AS event_count, message
        FROM job_events QUALIFY n > 40""")
    usage = f"""WITH {check_sql('job_events')}, u AS (SELECT event_id, model, CAST(sum(tokens) OVER w AS BIGINT) AS used, CAST(sum(output_tokens) OVER w AS BIGINT) AS used_output FROM job_events
        WINDOW w AS (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW))"""
    r.add("trailing_usage", lambda spark, sf: J.trailing_usage(derived(spark, sf, "job_events")).select("event_id", "model", "used", "used_output"),
          f"{usage} SELECT event_id, model, used, used_output FROM u")
    r.add("budget_breaches", lambda spark, sf: J.budget_breaches(derived(spark, sf, "job_events"), 5000, 700).select("event_id", "model", "used", "used_output"),
          f"{usage} SELECT event_id, model, used, used_output FROM u WHERE used > 5000 OR used_output > 700")
    r.add("queue_position", lambda spark, sf: J.queue_positions(job_rows(spark, sf)).select("job_id", "queue_position"), f"""
        WITH {check_sql('job_events')}, {jobs_sql}
        SELECT job_id, coalesce(count(*) FILTER (job_status = 'queued') OVER (ORDER BY created_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queue_position FROM jobs""")

    # streams replayed over the stored files
    def submissions(spark, sf):
        events = file_stream(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "ts", "event_id", F.floor(F.col("value") * 600).alias("seconds"))
        return replay(J.dedupe_submissions(events))

    r.add("dedupe_submissions", submissions, """
        WITH RECURSIVE o AS (SELECT user_id AS doc_id, event_id, epoch_us(ts) AS at_us, CAST(floor(value * 600) AS BIGINT) * 1000000 AS length_us,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        jobs AS (SELECT doc_id, event_id, n, at_us + length_us AS until_us FROM o WHERE n = 1
          UNION ALL SELECT doc_id, event_id, n, until_us FROM (SELECT o.doc_id, o.event_id, o.n, o.at_us + o.length_us AS until_us, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.n) AS k
            FROM jobs JOIN o ON o.doc_id = jobs.doc_id AND o.n > jobs.n AND o.at_us >= jobs.until_us) WHERE k = 1)
        SELECT doc_id, event_id FROM jobs""")

    def usage_stream(spark, sf):
        events = file_stream(spark, sf, "events").select("ts", F.col("event_type").alias("model"), F.floor(F.col("value") * 60).cast("long").alias("tokens"),
                                                         F.floor(F.col("value") * 8).cast("long").alias("output_tokens"))
        flat = J.stream_usage(events).select(F.col("window.start").alias("start"), "model", "used", "used_output")
        return replay_updates(flat, ["start", "model"]).select("model", F.unix_seconds("start").alias("start"), "used", "used_output")

    r.add("stream_usage", usage_stream, """
        WITH c AS (SELECT event_type AS model, CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 AS tick, CAST(floor(value * 60) AS BIGINT) AS tokens, CAST(floor(value * 8) AS BIGINT) AS output_tokens FROM events),
        w AS (SELECT model, tick - 10 * unnest(range(6)) AS start, tokens, output_tokens FROM c)
        SELECT model, start, CAST(sum(tokens) AS BIGINT) AS used, CAST(sum(output_tokens) AS BIGINT) AS used_output FROM w GROUP BY model, start""")

    # every document arrives, the labelled ones again in capitals; the later arrival replaces the earlier
    def arrivals(documents, labels):
        d = documents.select(F.col("source").alias("domain"), F.col("doc_id").cast("string").alias("filename"), "doc_id", "text")
        again = d.join(labels.select("doc_id"), "doc_id", "left_semi").withColumn("text", F.upper("text"))
        return (d.withColumn("arrival", F.lit(1).cast("long")).unionByName(again.withColumn("arrival", F.lit(2).cast("long")))
                .drop("doc_id"))

    def ingested(spark, sf):
        folder = work_dir(spark)
        stream = arrivals(file_stream(spark, sf, "documents"), table(spark, sf, "labels"))
        ingest.stream_ingest(stream, f"{folder}/chunks", f"{folder}/state").awaitTermination()
        return ingest.current_chunks(spark, f"{folder}/chunks").select("domain", "filename", "chunk_id", F.length("text").alias("chars"))

    final = f"""WITH docs AS (SELECT source AS domain, CAST(doc_id AS VARCHAR) AS filename, CASE WHEN doc_id IN (SELECT doc_id FROM labels)
          THEN replace(upper(text), 'ẞ', 'SS') ELSE text END AS text FROM documents), {packed_sql('docs', *V.GENERAL_CHUNKS)},
        fl AS (SELECT domain, filename, unnest(range(len(out))) AS i, regexp_replace(unnest(out), '^\\s+|\\s+$', '', 'g') AS text FROM pk)
        SELECT domain, filename, CAST(row_number() OVER (PARTITION BY domain, filename ORDER BY i) - 1 AS INT) AS chunk_id, CAST(length(text) AS INT) AS chars FROM fl WHERE text <> ''"""
    r.add("ingest_chunks", lambda spark, sf: ingest.ingest_chunks(arrivals(table(spark, sf, "documents"), table(spark, sf, "labels"))).select(
        "domain", "filename", "chunk_id", F.length("text").alias("chars")), final)
    r.add("stream_ingest", ingested, final)

    # accuracy: expected revenue per nation against saved values that drift by up to 0.4 %
    def facts(spark, sf):
        c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
        o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
        per = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey", "c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
        n = F.col("c_custkey")
        actual = F.col("v") * (1 + (n % 7) / 1000)
        payload = F.format_string('{"financial":{"metrics":[{"revenue":%s}],"listed":%s}}', F.when(n % 13 == 5, "null").otherwise(fixed(actual, 2)), (n % 2 == 0).cast("string"))
        path = F.when(n % 11 == 3, "financial.metrics[1].revenue").when(n % 4 == 0, "financial.listed").otherwise("financial.metrics[0].revenue")
        flag = n % 4 == 0
        return per.select(F.col("c_nationkey").alias("doc_id"), n.alias("fact_id"), payload.alias("payload"), path.alias("path"),
                          F.when(flag, "bool").otherwise("number").alias("kind"),
                          F.when(flag, (n % 8 == 0).cast("string")).otherwise(F.col("v").cast("decimal(20,2)").cast("string")).alias("expected"))

    def checked(spark, sf):
        got = facts(spark, sf).withColumn("actual", A.resolve_path(F.col("payload"), F.col("path")))
        return got.withColumn("ok", A.matches(F.col("kind"), F.col("expected"), F.col("actual")))

    acc = """WITH per AS (SELECT c_custkey AS n, c_nationkey, round(sum(o_totalprice), 2) AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
        k AS (SELECT c_nationkey AS doc_id, n AS fact_id, CASE WHEN n % 11 = 3 THEN 'MISSING' WHEN n % 4 = 0 THEN CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END
            WHEN n % 13 = 5 THEN NULL ELSE CAST(CAST(round(v * (1 + (n % 7) / 1000.0E0), 2) AS DECIMAL(20,2)) AS VARCHAR) END AS actual, n % 4 = 0 AS flag, v FROM per),
        q AS (SELECT *, coalesce(CASE WHEN flag THEN CASE WHEN fact_id % 8 = 0 THEN 'true' ELSE 'false' END = actual
            ELSE actual <> 'MISSING' AND abs(TRY_CAST(actual AS DOUBLE) - v) <= greatest(v * 0.005, 0.01) END, FALSE) AS ok FROM k)"""
    r.add("resolve_path", lambda spark, sf: checked(spark, sf).select(
        "fact_id", F.col("actual").try_cast("double").alias("value"), F.when(F.col("actual").try_cast("double").isNull(), F.col("actual")).alias("other"), F.coalesce(F.col("actual") == A.MISSING, F.lit(False)).alias("missing")),
          f"{acc} SELECT fact_id, TRY_CAST(actual AS DOUBLE) AS value, CASE WHEN TRY_CAST(actual AS DOUBLE) IS NULL THEN actual END AS other, coalesce(actual = 'MISSING', FALSE) AS missing FROM q")
    r.add("accuracy_matches", lambda spark, sf: checked(spark, sf).select("doc_id", "fact_id", "ok"), f"{acc} SELECT doc_id, fact_id, ok FROM q")
    r.add("accuracy_report", lambda spark, sf: A.accuracy_report(checked(spark, sf)),
          f"{acc} SELECT doc_id, count(*) FILTER (ok) AS passed, count(*) AS total FROM q GROUP BY ROLLUP (doc_id)")
