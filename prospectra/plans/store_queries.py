"""Sources, stored tables and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prospectra.operators import conversation as C
from prospectra.plans.inputs import check_sql, derived, table
from prospectra.plans.registry import Registry
from prospectra.sources import layout, store, tables, text_files
from prospectra.sources.folders import shared_folder


def register(r: Registry) -> None:
    def decoded(spark, sf):
        # three encodings of the same texts: plain UTF-8, UTF-8 with mark and CRLF, single-byte where it can hold the text
        text, latin = F.col("text"), F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
        content = (F.when(F.col("doc_id") % 3 == 0, F.encode(text, "UTF-8"))
                   .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.replace(text, F.lit("\n"), F.lit("\r\n")), "UTF-8")))
                   .otherwise(F.concat(F.encode(latin, "ISO-8859-1"), F.unhex(F.lit("93E980200D")))))
        return table(spark, sf, "documents").select("doc_id", text_files.decode_text(content).alias("text")).where("text <> ''")

    r.add("decode_text", decoded, r"""
        SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 2 THEN regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') || '“é€ ' ELSE text END,
          '^\s+|\s+$', '', 'g') AS text FROM documents WHERE trim(text) <> ''""")
    r.add("admit_files", lambda spark, sf: text_files.with_reject_reason(
        derived(spark, sf, "files")).select("doc_id", "name", "reject_reason"), f"""
        WITH {check_sql('files')} SELECT doc_id, name, CASE WHEN NOT regexp_matches(lower(name), '\\.(pdf|docx|txt)$') THEN 'unsupported type'
          WHEN size = 0 THEN 'empty' WHEN size > 52428800 THEN 'too large' END AS reject_reason FROM files""")
    r.add("document_key", lambda spark, sf: derived(spark, sf, "files").select(
        "doc_id", text_files.document_key(F.col("name"), F.col("text").cast("binary")).alias("key")), f"""
        WITH {check_sql('files')}, stems AS (SELECT doc_id, text, lower(CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END) AS stem FROM files)
        SELECT doc_id, left(trim(regexp_replace(stem, '[^a-z0-9]+', '-', 'g'), '-'), 40) || '-' || left(sha256(text), 10) AS key FROM stems""")
    r.add("render_tables", lambda spark, sf: layout.render_tables(derived(spark, sf, "cells")), f"""
        WITH {check_sql('cells')}, rows_ AS (SELECT doc_id, page, table_no, row_no, string_agg(coalesce(text, ''), ' | ' ORDER BY col) AS line
          FROM cells GROUP BY ALL)
        SELECT doc_id, page, table_no, '[TABLE]' || chr(10) || string_agg(line, chr(10) ORDER BY row_no) || chr(10) || '[/TABLE]' AS text
        FROM rows_ GROUP BY ALL""")
    r.add("merge_page_blocks", lambda spark, sf: layout.merge_page_blocks(
        derived(spark, sf, "blocks"), derived(spark, sf, "boxes")), f"""
        WITH {check_sql('boxes')}, held AS (SELECT b.*, (SELECT min(t.table_no) FROM boxes t WHERE t.doc_id = b.doc_id AND t.page = b.page
             AND (b.x0 + b.x1) / 2 >= t.x0 AND (b.x0 + b.x1) / 2 < t.x1 AND (b.y0 + b.y1) / 2 >= t.y0 AND (b.y0 + b.y1) / 2 < t.y1) AS tab
          FROM blocks b WHERE block_type = 0),
        firsts AS (SELECT doc_id, page, tab, min(block_no) AS first_at FROM held WHERE tab IS NOT NULL GROUP BY ALL),
        pieces AS (SELECT doc_id, page, 0 AS late, block_no AS place, text FROM held WHERE tab IS NULL
          UNION ALL SELECT t.doc_id, t.page, CASE WHEN first_at IS NULL THEN 1 ELSE 0 END, coalesce(first_at, table_no), chr(10) || text || chr(10)
          FROM boxes t LEFT JOIN firsts f ON f.doc_id = t.doc_id AND f.page = t.page AND f.tab = t.table_no)
        SELECT doc_id, page, regexp_replace(string_agg(text, '' ORDER BY late, place), '^\\s+|\\s+$', '', 'g') AS text FROM pieces GROUP BY ALL""")

    def incoming(spark, sf):
        labelled = table(spark, sf, "labels").select("doc_id")
        return derived(spark, sf, "stored_chunks").join(labelled, "doc_id", "left_semi").where("chunk_id % 2 = 0").withColumn("text", F.upper("text"))

    r.add("upsert_documents", lambda spark, sf: tables.upsert_documents(
        derived(spark, sf, "stored_chunks"), incoming(spark, sf)).select("domain", "filename", "chunk_id", "page", "text"), f"""
        WITH {check_sql('stored_chunks')}
        SELECT domain, filename, chunk_id, page, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN replace(upper(text), 'ẞ', 'SS') ELSE text END AS text
        FROM stored_chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR chunk_id % 2 = 0""")

    def doomed(spark, sf):
        return table(spark, sf, "labels").where("toxic = 1").select(
            F.concat(F.lit("src"), F.col("doc_id") % 20).alias("domain"), F.col("doc_id").cast("string").alias("filename"))

    keys_sql = "doomed AS (SELECT 'src' || (doc_id % 20) AS domain, CAST(doc_id AS VARCHAR) AS filename FROM labels WHERE toxic = 1)"
    r.add("delete_documents", lambda spark, sf: tables.delete_documents(
        derived(spark, sf, "stored_chunks"), doomed(spark, sf), tables.DOCUMENT_KEY).select("domain", "filename", "chunk_id", "text"), f"""
        WITH {check_sql('stored_chunks')}, {keys_sql}
        SELECT domain, filename, chunk_id, text FROM stored_chunks WHERE (domain, filename) NOT IN (SELECT domain, filename FROM doomed)""")
    r.add("delete_counts", lambda spark, sf: tables.delete_counts(
        derived(spark, sf, "stored_chunks"), doomed(spark, sf), tables.DOCUMENT_KEY), f"""
        WITH {check_sql('stored_chunks')}, {keys_sql}
        SELECT d.domain, d.filename, count(c.chunk_id) AS removed FROM (SELECT DISTINCT * FROM doomed) d
        LEFT JOIN stored_chunks c ON c.domain = d.domain AND c.filename = d.filename GROUP BY ALL""")
    def updated_store(spark, sf):
        """Every document with its chunks and results, the labelled ones replaced, the toxic ones deleted."""
        chunks = derived(spark, sf, "stored_chunks")
        kept = {"documents": "domain string, filename string, n_chars long", "chunks": "domain string, filename string, chunk_id long, page long, text string",
                "results": "domain string, filename string, agent string, value string"}
        documents = table(spark, sf, "documents").select(F.concat(F.lit("src"), F.col("doc_id") % 20).alias("domain"), F.col("doc_id").cast("string").alias("filename"),
                                                         "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "lang", "source")
        results = documents.select("domain", "filename", F.inline(F.array(*(F.struct(F.lit(c).alias("agent"), F.col(c).alias("value")) for c in ("lang", "source")))))
        as_long = lambda df: df.select("domain", "filename", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("page").cast("long").alias("page"), "text")
        held = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", kept, buckets=16)
        held.replace({"documents": documents.drop("doc_id", "lang", "source"), "chunks": as_long(chunks), "results": results})
        labelled = documents.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
        held.replace({"documents": labelled.select("domain", "filename", (F.col("n_chars") + 1).alias("n_chars")), "chunks": as_long(incoming(spark, sf))})
        before = held.snapshot()
        held.delete(doomed(spark, sf))
        return held, before

    def store_updates(spark, sf):
        now = updated_store(spark, sf)[0].snapshot()
        count = lambda name, total: now.read(name).groupBy("domain", "filename").agg(       # noqa: E731
            F.count("*").alias("rows"), F.sum(total).alias("total")).withColumn("part_of", F.lit(name))
        return count("documents", "n_chars").unionByName(count("chunks", "chunk_id")).unionByName(count("results", F.length("value").cast("long")))

    r.add("store_updates", store_updates, f"""
        WITH {check_sql('stored_chunks')}, labelled AS (SELECT doc_id FROM labels), {keys_sql},
        docs AS (SELECT 'src' || (doc_id % 20) AS domain, CAST(doc_id AS VARCHAR) AS filename, * FROM documents),
        left_docs AS (SELECT * FROM docs WHERE (domain, filename) NOT IN (SELECT domain, filename FROM doomed))
        SELECT domain, filename, count(*) AS rows, CAST(sum(n_chars + CASE WHEN doc_id IN (FROM labelled) THEN 1 ELSE 0 END) AS BIGINT) AS total, 'documents' AS part_of FROM left_docs GROUP BY ALL
        UNION ALL SELECT domain, filename, count(*), CAST(sum(chunk_id) AS BIGINT), 'chunks' FROM stored_chunks
          WHERE (domain, filename) NOT IN (SELECT domain, filename FROM doomed) AND (doc_id NOT IN (FROM labelled) OR chunk_id % 2 = 0) GROUP BY ALL
        UNION ALL SELECT domain, filename, 2, length(lang) + length(source), 'results' FROM left_docs WHERE doc_id NOT IN (FROM labelled)""")

    def store_removals(spark, sf):
        held, before = updated_store(spark, sf)
        return held.removed(doomed(spark, sf), before)

    r.add("store_removals", store_removals, f"""
        WITH {check_sql('stored_chunks')}, {keys_sql}, asked AS (SELECT DISTINCT * FROM doomed),
        chunks AS (SELECT domain, filename, count(*) AS n FROM stored_chunks WHERE chunk_id % 2 = 0 GROUP BY ALL),
        docs AS (SELECT 'src' || (doc_id % 20) AS domain, CAST(doc_id AS VARCHAR) AS filename, count(*) AS n FROM documents GROUP BY ALL)
        SELECT domain, filename, 'documents' AS "table", coalesce(n, 0) AS removed FROM asked LEFT JOIN docs USING (domain, filename)
        UNION ALL SELECT domain, filename, 'chunks', coalesce(n, 0) FROM asked LEFT JOIN chunks USING (domain, filename)
        UNION ALL SELECT domain, filename, 'results', 0 FROM asked""")
    r.add("list_documents", lambda spark, sf: tables.list_documents(
        derived(spark, sf, "stored_chunks"), F.substring("domain", F.lit(4), F.lit(9)).cast("int")), f"""
        WITH {check_sql('stored_chunks')} SELECT domain, filename, count(*) AS chunks, max(page) AS pages FROM stored_chunks GROUP BY ALL""")
    r.add("latest_results", lambda spark, sf: tables.latest_results(derived(spark, sf, "agent_results")), f"""
        WITH {check_sql('agent_results')} SELECT doc_id, agent, arg_max(status, result_id) AS status, max(saved_at) AS saved_at
        FROM agent_results GROUP BY ALL""")
    r.add("reuse_results", lambda spark, sf: tables.work_left(table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("doc_id"), F.explode(F.array(*[F.lit(a) for a in ("risk", "financial", "business", "legal", "offer")])).alias("agent")),
        derived(spark, sf, "agent_results")), f"""
        WITH {check_sql('agent_results')}, latest AS (SELECT doc_id, agent, arg_max(status, result_id) AS status FROM agent_results GROUP BY ALL)
        SELECT s_suppkey AS doc_id, a AS agent FROM supplier, (VALUES ('risk'), ('financial'), ('business'), ('legal'), ('offer')) v(a)
        WHERE (s_suppkey, a) NOT IN (SELECT doc_id, agent FROM latest WHERE status = 'done')""")

    def reports(spark, sf):
        s = table(spark, sf, "supplier")
        score = F.when(F.col("s_suppkey") % 10 != 9, F.round("s_acctbal", 1))
        rating = F.when(F.col("s_acctbal") > 5000, "Neutral").otherwise("Leans Avoid")
        saved = s.select(F.col("s_suppkey").alias("doc_id"), score.alias("score"), rating.alias("rating"))
        now = s.select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 3 == 0, score + 0.5).otherwise(score).alias("score"),
                       F.when(F.col("s_suppkey") % 4 == 0, "Neutral").otherwise(rating).alias("rating"))
        return tables.stale_reports(saved, now).select("doc_id", "rating", "new_rating")

    r.add("stale_reports", reports, """
        WITH b AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 <> 9 THEN round(s_acctbal, 1) END AS score,
            CASE WHEN s_acctbal > 5000 THEN 'Neutral' ELSE 'Leans Avoid' END AS rating FROM supplier),
        n AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN score + 0.5 ELSE score END AS new_score, CASE WHEN doc_id % 4 = 0 THEN 'Neutral' ELSE rating END AS new_rating FROM b)
        SELECT doc_id, rating, new_rating FROM n WHERE score IS DISTINCT FROM new_score OR rating IS DISTINCT FROM new_rating""")

    # conversations
    r.add("recent_history", lambda spark, sf: C.recent_history(table(spark, sf, "conversations").where("role <> 'system'")), """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system')
        SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END
          || CASE WHEN length(text) > 1500 THEN left(text, 1500) || ' [...]' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS history
        FROM t WHERE r <= 6 GROUP BY conv_id""")
    r.add("complete_pairs", lambda spark, sf: C.complete_pairs(derived(spark, sf, "messages")), f"""
        WITH {check_sql('messages')}, p AS (SELECT *, row_number() OVER w AS pos, lead(text) OVER w AS answer, lead(error) OVER w AS e2, lead(stopped) OVER w AS s2
           FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, (pos - 1) // 2 AS pair, text AS question, answer FROM p WHERE pos % 2 = 1 AND coalesce(answer, '') <> '' AND e2 IS NULL AND NOT s2""")
    r.add("non_empty_turns", lambda spark, sf: C.non_empty_turns(derived(spark, sf, "messages")), f"""
        WITH {check_sql('messages')} SELECT conv_id, turn, role, text FROM messages WHERE error IS NULL AND trim(text) <> ''""")
    r.add("source_pages", lambda spark, sf: C.source_pages(derived(spark, sf, "blocks").select(
        F.col("doc_id").alias("message_id"), F.col("page"))).select("message_id", F.array_join("pages", ",").alias("pages")), f"""
        WITH {check_sql('blocks')} SELECT doc_id AS message_id, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM blocks GROUP BY doc_id""")
    r.add("validate_questions", lambda spark, sf: C.validate_questions(
        table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(
            F.col("conv_id") % 9 == 0, F.lit(" \n ")).when(F.col("conv_id") % 9 == 1, F.rpad(F.col("text"), 2001, "x")).otherwise(F.col("text")).alias("question"),
            F.get(F.array(*[F.lit(d) for d in ("legal", "finance", "healthcare", "enterprise", "sports")]), (F.col("conv_id") % 5).cast("int")).alias("domain"),
            (F.col("turn") * 12).alias("history_turns"))).select("conv_id", "turn", "domain", "reject_reason"), """
        WITH q AS (SELECT conv_id, turn, CASE conv_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN rpad(text, 2001, 'x') ELSE text END AS question,
            ['legal', 'finance', 'healthcare', 'enterprise', 'sports'][conv_id % 5 + 1] AS domain, turn * 12 AS h FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, domain, CASE WHEN trim(question) = '' THEN 'empty question' WHEN length(question) > 2000 THEN 'question too long'
          WHEN domain = 'sports' THEN 'unknown domain' WHEN h > 50 THEN 'history too long' END AS reject_reason FROM q""")
