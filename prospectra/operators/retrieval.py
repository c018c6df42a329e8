"""Exact vector search, keyword ranking, rank fusion and citations for batches of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.text import preview, similarity_from_distance, tokenise
from prospectra.operators.cells import Cells
from prospectra.operators.ordered import last_before, id_bucket, spread_join
from prospectra.operators.search_index import SearchIndex

def l2_normalise(vector: Column) -> Column:
    """The vector scaled to unit length (a zero vector stays as it is)."""
    values = F.transform(vector, lambda x: x.cast("double"))
    squares = F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x, F.sqrt)
    return F.element_at(F.transform(F.array(squares), lambda length: F.transform(
        values, lambda x: F.when(length > 0, x / length).otherwise(x))), 1)


# ------------------------------------------------------------------ vectors
def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str, group: str | None = None) -> DataFrame:
    """Exact k nearest items of every query: (query_id, item_id, rank, value).

    `queries` has query_id, embedding; `corpus` has item_id, embedding; with `group`, the allowed section, a query meets the items of its
    sections only (one row for each). Items are dealt into cells, and a query looks only into those that can hold one of its best.
    """
    grp = F.col(group).cast("long") if group else F.lit(0).cast("long")
    vector = F.col("embedding").cast("array<float>").alias("e")
    cells = Cells(corpus.select(F.col("item_id").cast("long").alias("item_id"), grp.alias("grp"), vector), metric)
    best = cells.nearest(queries.select(F.col("query_id").cast("long").alias("query_id"), grp.alias("grp"), vector), k)
    order = Window.partitionBy("query_id").orderBy("value", "item_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("value", F.col("value") if metric == "l2" else 0.0 - F.col("value"))


def knn_l2(queries: DataFrame, corpus: DataFrame, k: int = V.TOP_K_GENERAL) -> DataFrame:
    """Squared Euclidean distance, ascending."""
    return nearest(queries, corpus, k, "l2").withColumnRenamed("value", "distance")


def knn_ip(queries: DataFrame, corpus: DataFrame, k: int = V.CANDIDATES_PER_LIST, group: str | None = None) -> DataFrame:
    """Inner product, descending, optionally only among items of the query's allowed groups."""
    return nearest(queries, corpus, k, "ip", group).withColumnRenamed("value", "similarity")


# ------------------------------------------------------------------ keywords
def passage_terms(passages: DataFrame, text: str = "text") -> DataFrame:
    """Adds the words of each passage and their number."""
    return passages.withColumn("terms", tokenise(F.col(text))).drop(text).withColumn("dl", F.size("terms"))


PASSAGES, WORDS = "", " "   # keys of the two corpus totals; no word is empty or blank


def bm25_statistics(passages: DataFrame) -> DataFrame:
    """(term, v): passages containing each term, plus one row each for the number of passages and of words.

    One pass and one aggregate, so every use below shares the same shuffle.
    """
    def entry(term: Column, v: Column) -> Column:
        return F.struct(term.alias("term"), v.cast("long").alias("v"))

    entries = F.concat(F.transform(F.array_distinct("terms"), lambda t: entry(t, F.lit(1))),
                       F.array(entry(F.lit(PASSAGES), F.lit(1)), entry(F.lit(WORDS), F.col("dl"))))
    return passages.select(F.inline(entries)).groupBy("term").agg(F.sum("v").alias("v"))


def _total(stats: DataFrame, key: str) -> Column:
    return stats.agg(F.max(F.when(F.col("term") == key, F.col("v")))).scalar()


def bm25_terms(stats: DataFrame) -> DataFrame:
    """(term, df, idf): Okapi idf, negative values replaced by a quarter of the mean idf."""
    n, df = _total(stats, PASSAGES), F.col("v")
    raw = stats.select("term", df.alias("df"), F.when(
        ~F.col("term").isin(PASSAGES, WORDS), F.log(n - df + 0.5) - F.log(df + 0.5)).alias("raw"))
    floor = V.BM25_IDF_FLOOR * raw.agg(F.avg("raw")).scalar()
    return raw.where(F.col("raw").isNotNull()).select(
        "term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def bm25_search(questions: DataFrame, passages: DataFrame, ids: Sequence[str], k: int = V.CANDIDATES_PER_LIST,
                group: str | None = None) -> DataFrame:
    """Best k passages per question: (query_id, *ids, rank, score).

    `questions` has query_id, text (and the group); `passages` comes from passage_terms. Statistics
    cover every passage even when a group restricts the answers.
    """
    groups = [group] if group else []
    stats = bm25_statistics(passages)
    average = _total(stats, WORDS) / _total(stats, PASSAGES)
    asked = (questions.select("query_id", *groups, F.explode(tokenise(F.col("text"))).alias("term"))
             .groupBy("query_id", *groups, "term").agg(F.count("*").alias("qtf"))
             .join(bm25_terms(stats).select("term", "idf"), "term"))
    wanted = asked.select("term").distinct()
    postings = (passages.select(*ids, *groups, "dl", F.explode("terms").alias("term"))
                .join(wanted, "term", "left_semi")
                .groupBy(*ids, *groups, "dl", "term").agg(F.count("*").alias("tf")))
    norm = F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / average)
    weight = F.col("qtf") * F.col("idf") * (F.col("tf") * (V.BM25_K1 + 1) / norm)
    scored = (spread_join(postings, asked, ["term", *groups], ids)
              .groupBy("query_id", *ids).agg(F.round(F.sum(weight), 9).alias("score"))
              .where(F.col("score") > 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ids)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ fusion and presentation
def rrf_fuse(dense: DataFrame, keyword: DataFrame, item: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties go to the dense list, then to the better rank."""
    both = (dense.select("query_id", item, "rank", "similarity", F.lit(0).alias("list"))
            .unionByName(keyword.select("query_id", item, "rank", F.lit(None).cast("double").alias("similarity"),
                                        F.lit(1).alias("list"))))
    fused = both.groupBy("query_id", item).agg(
        F.sum(1 / (V.RRF_CONSTANT + F.col("rank"))).alias("fused"), F.min(F.struct("list", "rank")).alias("first"),
        F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "first.list", "first.rank")
    return (fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", item, "rank", F.round("fused", 4).alias("score"), F.round("similarity", 3).alias("similarity")))


def hybrid_search(questions: DataFrame, index: DataFrame, keywords: SearchIndex, k: int = V.TOP_K_GENERAL, group: str | None = None) -> DataFrame:
    """Dense and keyword candidates of every question, fused.

    `questions`: query_id, text, embedding; `index`: item_id, embedding; `keywords`: the stored index of the items' texts. With `group`, a
    question meets the items of its own groups only (one row for each), or of all if it has none. Items without a vector are found by
    keywords only, and questions without one are answered by keywords only.
    """
    dense = knn_ip(questions.where(F.col("embedding").isNotNull()), index.where(F.col("embedding").isNotNull()), V.CANDIDATES_PER_LIST, group)
    asked = questions.select("query_id", "text", *([group] if group else []))
    if group:
        free = keywords.search(asked.where(F.col(group).isNull()).drop(group), V.CANDIDATES_PER_LIST, limited=False)
        keyword = keywords.search(asked.where(F.col(group).isNotNull()), V.CANDIDATES_PER_LIST).unionByName(free)
    else:
        keyword = keywords.search(asked, V.CANDIDATES_PER_LIST, limited=False)
    return rrf_fuse(dense, keyword, "item_id", k)


def follow_up_queries(turns: DataFrame) -> DataFrame:
    """Search text of every user turn: the previous user question, a line break, the question."""
    asked = last_before(turns, ["conv_id"], id_bucket(F.col("turn")), F.col("turn"),
                        F.when(F.col("role") == "user", F.col("text")), "previous")
    return asked.where("role = 'user'").select(
        "conv_id", "turn", F.concat_ws("\n", "previous", "text").alias("search_text"))


def citations(hits: DataFrame) -> DataFrame:
    """Hits, with their passages' page and text, as page and preview."""
    return hits.withColumn("text_preview", preview(F.col("text"))).drop("text")


def split_matches(hits: DataFrame) -> DataFrame:
    """Strong and weaker matches of each question, and whether even the best is doubtful (at most k rows each)."""
    similarity = similarity_from_distance(F.col("distance"))
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return hits.withColumn("similarity", similarity).withColumns({
        "match": F.when(F.col("similarity") >= best - V.WEAKER_MATCH_MARGIN, "strong").otherwise("weaker"),
        "low_confidence": best < V.LOW_CONFIDENCE})


def context_block(hits: DataFrame, file: str = "doc_id") -> DataFrame:
    """One context text per question from its ranked hits: numbered sources, and page-tagged excerpts."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(file).cast("string").alias("file"), "page", "text")))
    hits = hits.groupBy("query_id").agg(ordered.alias("h"))
    numbered = F.transform("h", lambda x: F.concat(
        F.lit("[Source "), x["rank"].cast("string"), F.lit(": "), x["file"], F.lit(", Page "), x["page"].cast("string"),
        F.lit("]\n"), x["text"]))
    tagged = F.transform("h", lambda x: F.concat(F.lit("[p. "), x["page"].cast("string"), F.lit("] "), x["text"]))
    return hits.select("query_id", F.array_join(numbered, "\n\n---\n\n").alias("context"),
                       F.array_join(tagged, "\n\n").alias("excerpts"))
