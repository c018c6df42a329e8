"""Retrieval over the whole corpus: questions are the benchmark passages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.operators import retrieval as R
from prospectra.operators.search_index import LAYOUT, SearchIndex
from prospectra.plans.chunk_queries import chunks_sql, document_chunks
from prospectra.plans.inputs import table
from prospectra.plans.registry import Registry, shared
from prospectra.plans.text_queries import TOKENS_SQL
from prospectra.sources.folders import shared_folder, state_of
from prospectra.sources.versions import CommitConflict


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@shared
def passages(spark, sf):
    return document_chunks(spark, sf)


@shared
def vector_questions(spark, sf):
    return questions(spark, sf).join(vectors(spark, sf).select(
        F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("section")), "query_id", "left")


@shared
def vector_index(spark, sf):
    """All documents, with a vector and its label as the section where they have one."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text").join(
        vectors(spark, sf).select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("section")), "item_id", "left")


PASSAGE = ["doc_id", "chunk_id"]


def open_index(spark, folder):
    return SearchIndex(spark, f"{shared_folder(spark)}/{folder}-{LAYOUT}", PASSAGE, payload=["page"])


def built(index, rows):
    """An index that holds rows, built now unless it has been before."""
    if not index.version:
        try:
            index.append(rows)
        except CommitConflict:
            index.refresh()
    return index


@shared
def corpus_index(spark, sf):
    """The stored index of the passages of `documents`, built by the first query that needs it and found by the state of the table's files."""
    index = open_index(spark, f"index-{state_of(spark, f'{sf}/documents.parquet')[:32]}")
    return built(index, passages(spark, sf).select(*PASSAGE, "page", "text"))


@shared
def document_index(spark, sf):
    """The stored index of whole documents, by section."""
    state = "".join(state_of(spark, f"{sf}/{name}.parquet")[:16] for name in ("documents", "embeddings"))
    index = SearchIndex(spark, f"{shared_folder(spark)}/index-documents-{state}-{LAYOUT}", ["item_id"], groups=["section"])
    return built(index, vector_index(spark, sf).select("item_id", "section", "text"))


def updated_index(spark, sf):
    """An index that has grown in batches, lost documents, had some replaced, and was merged."""
    index = open_index(spark, f"index-{uuid.uuid4().hex}")
    rows = passages(spark, sf).select(*PASSAGE, "page", "text")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    index.append(rows.where("doc_id % 10 < 8").withColumn("text", F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("outdated "), "text")).otherwise(F.col("text"))))
    index.append(rows.where("doc_id % 10 = 8"))
    index.delete(toxic)
    index.append(rows.where("doc_id % 10 = 9").join(toxic, "doc_id", "left_anti"))
    index.replace(rows.where("doc_id % 10 = 7").join(toxic, "doc_id", "left_anti"))
    index.merge(index.totals()[0] // 2)
    return index


def bm25_hits(spark, sf, k=V.CANDIDATES_PER_LIST):
    return corpus_index(spark, sf).search(questions(spark, sf), k)


def knn_hits(spark, sf):
    v = vectors(spark, sf)
    return R.knn_l2(v.where(ASKED).select(F.col("vec_id").alias("query_id"), "embedding"),
                    v.select(F.col("vec_id").alias("item_id"), "embedding"))


# The stated query set of the vector searches: every vector whose id is divisible by 50, against all vectors.
ASKED = "vec_id % 50 = 0"
VEC_SQL = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
KNN_SQL = f"""{VEC_SQL}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_distance(a.e, b.e) ** 2, 9) AS distance FROM vec a, vec b WHERE a.vec_id % 50 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM pairs QUALIFY rank <= 5)"""


def bm25_sql(passage_source: str, ids: str, question_source: str, group: str = "") -> str:
    """Term statistics and scores of the checking engine. passage_source: ids, [group,] text."""
    g = f", {group}" if group else ""
    match = f" AND (p.{group} = q.{group} OR q.{group} IS NULL)" if group else ""
    return f"""tok AS (SELECT {ids}{g}, {TOKENS_SQL.format(text='text')} AS terms FROM {passage_source}),
corpus AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM tok),
post AS (SELECT {ids}{g}, dl, term, count(*) AS tf FROM (SELECT {ids}{g}, len(terms) AS dl, unnest(terms) AS term FROM tok) GROUP BY ALL),
rawidf AS (SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf),
qterm AS (SELECT query_id{g}, term, count(*) AS qtf FROM (SELECT query_id{g}, unnest({TOKENS_SQL.format(text='text')}) AS term FROM {question_source}) GROUP BY ALL),
scored AS (SELECT query_id, {', '.join('p.' + i.strip() for i in ids.split(','))}, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM corpus))))), 9) AS score
  FROM qterm q JOIN post p ON p.term = q.term{match} JOIN idf ON idf.term = q.term GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ids}) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 50)"""


QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"
CHUNK_BM25_SQL = f"{chunks_sql('chunks', *V.GENERAL_CHUNKS)}, {QUESTIONS_SQL}, {bm25_sql('chunks', 'doc_id, chunk_id', 'questions')}"
HYBRID_BASE_SQL = f"""{VEC_SQL}, vq AS (SELECT b.item_id AS query_id, text, e, label AS section FROM benchmark b LEFT JOIN vec ON vec_id = b.item_id),
vi AS (SELECT doc_id AS item_id, text, e, label AS section FROM documents LEFT JOIN vec ON vec_id = doc_id)"""


def hybrid_sql(group: bool, k: int) -> str:
    on = "vq.section = vi.section" if group else "TRUE"
    return f"""{HYBRID_BASE_SQL}, {bm25_sql('vi', 'item_id', 'vq', 'section' if group else '')},
dense AS (SELECT query_id, item_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank
  FROM (SELECT query_id, item_id, round(list_inner_product(vq.e, vi.e), 9) AS similarity FROM vq JOIN vi ON {on} WHERE vi.e IS NOT NULL AND vq.e IS NOT NULL) QUALIFY rank <= 50),
lists AS (SELECT query_id, item_id, rank, similarity, 0 AS l FROM dense UNION ALL SELECT query_id, item_id, rank, NULL, 1 FROM bm25),
fusedraw AS (SELECT query_id, item_id, sum(1.0 / (60 + rank)::DOUBLE) AS fused, max(similarity) AS similarity, min(l * 100 + rank) AS first FROM lists GROUP BY ALL),
fused AS (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first) AS INT) AS rank,
   round(fused, 4) AS score, round(similarity, 3) AS similarity FROM fusedraw QUALIFY rank <= {k})"""


def register(r: Registry) -> None:
    r.add("l2_normalise", lambda spark, sf: vectors(spark, sf).select("vec_id", F.posexplode(R.l2_normalise(
        F.transform("embedding", lambda x: x.cast("double") * 3))).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x")), f"""
        WITH {VEC_SQL}, scaled AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings)
        SELECT vec_id, CAST(dim AS INT) AS dim, round(v / norm, 6) AS x FROM (
          SELECT vec_id, unnest(e) AS v, unnest(range(len(e))) AS dim, sqrt(list_inner_product(e, e)) AS norm FROM scaled)""")
    r.add("knn_l2", lambda spark, sf: knn_hits(spark, sf).withColumn("distance", F.round("distance", 6)),
          f"WITH {KNN_SQL} SELECT query_id, item_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM knn")
    r.add("knn_ip_in_section", lambda spark, sf: R.knn_ip(
        vectors(spark, sf).where(ASKED).select(F.col("vec_id").alias("query_id"), "embedding",
                                  F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("section")),
        vectors(spark, sf).select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("section")),
        V.CANDIDATES_PER_LIST, "section").withColumn("similarity", F.round("similarity", 6)), f"""
        WITH {VEC_SQL}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.e, b.e), 9) AS s
           FROM vec a JOIN vec b ON b.label IN (a.label, (a.label + 1) % 10) WHERE a.vec_id % 50 = 0)
        SELECT query_id, item_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS INT) AS rank
        FROM pairs QUALIFY rank <= 50""")
    r.add("bm25_index", lambda spark, sf: corpus_index(spark, sf).terms().select("term", "df", F.round("idf", 8).alias("idf")), f"WITH {CHUNK_BM25_SQL} SELECT term, df, round(idf, 8) AS idf FROM idf")
    r.add("bm25_search", lambda spark, sf: bm25_hits(spark, sf).withColumn("score", F.round("score", 6)),
          f"WITH {CHUNK_BM25_SQL} SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm25")
    r.add("index_updates", lambda spark, sf: updated_index(spark, sf).search(questions(spark, sf)).withColumn("score", F.round("score", 6)), f"""
        WITH documents AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {CHUNK_BM25_SQL}
        SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm25""")
    r.add("rrf_fuse", lambda spark, sf: R.hybrid_search(vector_questions(spark, sf), vector_index(spark, sf).drop("text"), document_index(spark, sf), V.CANDIDATES_PER_LIST),
          f"WITH {hybrid_sql(False, 50)} SELECT query_id, item_id, rank, score, similarity FROM fused")
    r.add("hybrid_search", lambda spark, sf: R.hybrid_search(
        vector_questions(spark, sf), vector_index(spark, sf).drop("text"), document_index(spark, sf), V.TOP_K_OFFER, "section"),
          f"WITH {hybrid_sql(True, 6)} SELECT query_id, item_id, rank, score, similarity FROM fused")

    def cited(spark, sf):
        hits = bm25_hits(spark, sf, V.TOP_K_GENERAL)
        return R.citations(corpus_index(spark, sf).with_passages(hits)).select(
            "query_id", "rank", F.col("doc_id").cast("string").alias("filename"), "page", "chunk_id", "text_preview",
            F.round("score", 6).alias("score"))

    r.add("answer_citations", cited, f"""
        WITH {CHUNK_BM25_SQL} SELECT query_id, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS filename, page, chunk_id,
          left(text, 200) AS text_preview, round(score, 6) AS score FROM bm25 JOIN chunks USING (doc_id, chunk_id) WHERE rank <= 5""")
    r.add("context_block", lambda spark, sf: R.context_block(
        corpus_index(spark, sf).with_passages(bm25_hits(spark, sf, V.TOP_K_GENERAL))), f"""
        WITH {CHUNK_BM25_SQL}, top AS (SELECT * FROM bm25 JOIN chunks USING (doc_id, chunk_id) WHERE rank <= 5)
        SELECT query_id, string_agg('[Source ' || rank || ': ' || doc_id || ', Page ' || page || ']' || chr(10) || text,
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
          string_agg('[p. ' || page || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS excerpts FROM top GROUP BY query_id""")
    r.add("split_matches", lambda spark, sf: R.split_matches(knn_hits(spark, sf)).select(
        "query_id", "item_id", F.round("similarity", 6).alias("similarity"), "match", "low_confidence"), f"""
        WITH {KNN_SQL}, s AS (SELECT *, least(1, greatest(0, 1 - distance / 2)) AS similarity FROM knn),
        b AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM s)
        SELECT query_id, item_id, round(similarity, 6) AS similarity, CASE WHEN similarity >= best - 0.1 THEN 'strong' ELSE 'weaker' END AS match,
               best < 0.5 AS low_confidence FROM b""")
    r.add("follow_up_queries", lambda spark, sf: R.follow_up_queries(table(spark, sf, "conversations")), """
        SELECT conv_id, turn, coalesce(previous || chr(10), '') || text AS search_text FROM (
          SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER
             (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations)
        WHERE role = 'user'""")
