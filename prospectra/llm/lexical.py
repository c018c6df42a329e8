"""Ranked lexical search over bit-sliced Bloom signatures: bitmaps of documents give upper bounds, and what they cannot exclude is scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospectra.llm.common import read, small_batches, words_of, written

TOP = 10
LEVELS = (1, 2, 4)              # a term is entered once for each of these counts that it reaches
HASHES, ROOM = 4, 16            # slices that an entry sets, slices per entry of a block's fullest document
BLOCK_DOCS = 1024               # documents whose bits stand side by side in a slice
BLOCK_BITS = 1 << 25            # a block of fuller documents holds fewer of them
GATHERED = 2_000_000            # entries of a task's documents that are sorted by size into blocks at once
HELD_TERMS = 300_000            # terms whose counts a task combines before it passes them on
PART_BYTES = 1_000_000          # bytes of questions that are sent to the tasks at once; more take more passes
ASKED_AT_ONCE = 16_384          # rows of questions' terms that are looked up in a block at once
FIRST = 2 * TOP                 # documents of the highest bounds that are scored first, for a threshold

INDEX = "term binary, df long, doc_ids array<long>, keys array<long>, lengths array<long>, width int, slices binary"
NO_BLOCK = {"doc_ids": None, "keys": None, "lengths": None, "width": None, "slices": None}
INDEX_ARROW = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
                         ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("slices", pa.binary())])


def entry(term: bytes, level: int) -> int:
    return xxhash.xxh3_64_intdigest(term, level)


def slots(entries: np.ndarray, width: int) -> np.ndarray:
    """The slices that each entry sets, (entries, HASHES)."""
    low, high = entries & np.uint64(0xFFFFFFFF), entries >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


# The index --------------------------------------------------------------------------------------------------------------------

def blocks(docs: list[tuple]) -> Iterator[dict]:
    """Index rows of documents (doc_id, key, length, entries): those of like size share a block, as wide as its fullest needs."""
    docs.sort(key=lambda d: -len(d[3]))
    at = 0
    while at < len(docs):
        width = ROOM * len(docs[at][3])
        own = docs[at:at + max(1, min(BLOCK_DOCS, BLOCK_BITS // width))]
        own = [d for d in own if 2 * len(d[3]) >= len(own[0][3])]
        at += len(own)
        bits = np.zeros((width, len(own)), bool)
        places = np.repeat(np.arange(len(own)), [len(d[3]) for d in own])
        bits[slots(np.concatenate([d[3] for d in own]), width), places[:, None]] = True
        yield {"term": None, "df": None, "doc_ids": [d[0] for d in own], "keys": [d[1] for d in own], "lengths": [d[2] for d in own],
               "width": width, "slices": np.packbits(bits, axis=1).tobytes()}


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents, and how many of them hold each term."""
    held: list[tuple] = []
    entries, frequencies = 0, Counter()
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
            counts = Counter(words_of(text))
            if not counts:
                continue
            frequencies.update(counts.keys())
            hashes: list[int] = []
            for term, tf in counts.items():
                own = known.get(term)
                if own is None:
                    own = known[term] = [entry(term, level) for level in LEVELS]
                hashes += own[:1] if tf == 1 else own[:sum(tf >= level for level in LEVELS)]
            held.append((doc_id, key, counts.total(), np.array(hashes, np.uint64)))
            entries += len(hashes)
            if entries >= GATHERED:
                rows += blocks(held)
                held, entries = [], 0
        if len(known) > HELD_TERMS:
            known = {}
        if len(frequencies) > HELD_TERMS:
            rows += ({"term": t, "df": n} | NO_BLOCK for t, n in frequencies.items())
            frequencies = Counter()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
    rows = [*blocks(held), *({"term": t, "df": n} | NO_BLOCK for t, n in frequencies.items())]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)


class Index(NamedTuple):
    """Blocks of signatures, document counts of terms, and the counts of documents and of terms in all."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def keyed(docs: DataFrame) -> DataFrame:
    """Documents by id and text: rows that agree in both have equal scores and are told apart only when results are counted."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def build_index(docs: DataFrame) -> Index:
    """One pass over the documents, whatever will be asked; the index is a written table of about a third of the texts' bytes."""
    small_batches(docs.sparkSession)
    rows = written(keyed(docs).mapInArrow(index_rows, INDEX))
    found = rows.where("slices IS NOT NULL").select("doc_ids", "keys", "lengths", "width", "slices")
    n_docs, n_terms = found.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)),
                                F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()
    terms = written(rows.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")))
    return Index(found, terms, int(n_docs), int(n_terms))


# Scores -----------------------------------------------------------------------------------------------------------------------

def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def measure(n, n_docs: int, n_terms: int):
    """A document's m: 100 at the mean length, no less than 25."""
    return 100 - 75 + (75 * n * n_docs) // n_terms


def share(tf, m):
    """What tf occurrences give of a term's weight; it rises with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Questions(NamedTuple):
    """A bounded part of the questions: their terms' weights as dictionaries, and as rows (question, term, weight) over distinct terms."""

    weights: list[dict[bytes, int]]
    question: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    entries: np.ndarray         # (levels, terms)


def questions(texts: list[str | None], index: Index) -> Questions:
    counts = [Counter(words_of(t)) for t in texts]
    spark = index.terms.sparkSession
    asked = spark.createDataFrame([(bytearray(w),) for w in sorted(set().union(*counts))], "term binary")
    found = {bytes(r["term"]): weight(index.n_docs, r["df"]) for r in index.terms.join(asked, "term", "left_semi").collect()}
    weights = [{t: n * found[t] for t, n in c.items() if found.get(t)} for c in counts]
    terms = sorted(set().union(*weights))
    at = {t: i for i, t in enumerate(terms)}
    rows = np.array([(q, at[t], w) for q, own in enumerate(weights) for t, w in own.items()], np.int64).reshape(-1, 3)
    return Questions(weights, rows[:, 0], rows[:, 1], rows[:, 2], np.array([[entry(t, level) for t in terms] for level in LEVELS], np.uint64).reshape(len(LEVELS), -1))


def upper_bounds(asked: Questions, lengths: np.ndarray, width: int, slices: bytes, n_docs: int, n_terms: int) -> np.ndarray:
    """(questions, documents) of a block: weighted sums of the slices' meets. A meet holds every document with the term, and perhaps
    others; a document between two levels counts with the most that lies between them, one above the last with its length."""
    packed = np.frombuffer(slices, np.uint8).reshape(width, -1)
    m = measure(lengths, n_docs, n_terms)
    most = [share(np.minimum(nxt - 1, lengths), m) for nxt in LEVELS[1:]] + [share(lengths, m)]
    gains = np.diff(np.stack(most), axis=0, prepend=0).astype(np.float64)
    size = len(lengths)
    bounds = np.zeros(len(asked.weights) * size)
    for a in range(0, len(asked.term), ASKED_AT_ONCE):
        rows = np.arange(a, min(a + ASKED_AT_ONCE, len(asked.term)))
        for level, gain in enumerate(gains):
            meet = np.bitwise_and.reduce(packed[slots(asked.entries[level][asked.term[rows]], width)], axis=1)
            held = meet.any(axis=1)
            rows, meet = rows[held], meet[held]         # a term without documents here has none at higher counts
            if not len(rows):
                break
            at, doc = np.nonzero(np.unpackbits(meet, axis=1, count=size))
            at = rows[at]
            bounds += np.bincount(asked.question[at] * size + doc, asked.weight[at] * gain[doc], len(bounds))
    return bounds.reshape(-1, size)


def over_blocks(index: Index, asked: Questions, threshold: np.ndarray | None) -> DataFrame:
    """(question, doc_id, key, bound): per task the FIRST highest bounds of each question or, with a threshold each, all bounds that reach it."""
    n_docs, n_terms = index.n_docs, index.n_terms
    schema = pa.schema([("question", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("bound", pa.float64())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked.weights]
        for batch in batches:
            for ids, keys, lengths, width, slices in zip(*(c.to_pylist() for c in batch.columns)):
                bounds = upper_bounds(asked, np.array(lengths, np.int64), width, slices, n_docs, n_terms)
                if threshold is not None:
                    # Sums of doubles: a relative 1e-9 covers their rounding.
                    q, d = np.nonzero(bounds * (1 + 1e-9) >= threshold[:, None])
                    if len(q):
                        yield rows([(a, ids[b], keys[b], bounds[a, b]) for a, b in zip(q.tolist(), d.tolist())])
                    continue
                top = np.argpartition(-bounds, min(FIRST, len(ids)) - 1, axis=1)[:, :FIRST]
                for q, own in enumerate(best):
                    least = own[-1][0] if len(own) == FIRST else 0.0
                    new = [(bounds[q, d], ids[d], keys[d]) for d in top[q].tolist() if bounds[q, d] > least]
                    if new:
                        best[q] = sorted(own + new, key=lambda r: -r[0])[:FIRST]
        flat = [(q, i, k, b) for q, own in enumerate(best) for b, i, k in own]
        if flat:
            yield rows(flat)

    return index.blocks.mapInArrow(search, "question int, doc_id long, key long, bound double")


def exact_scores(docs: DataFrame, candidates: DataFrame, asked: Questions, index: Index) -> DataFrame:
    """(question, doc_id, score) of every row of docs that is a candidate, its whole text counted."""
    weights, n_docs, n_terms = asked.weights, index.n_docs, index.n_terms
    schema = pa.schema([("question", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                counts = Counter(words_of(text))
                m = measure(counts.total(), n_docs, n_terms)
                for q in wanted:
                    own = weights[q]
                    out.append((q, doc_id, sum(own[t] * share(counts[t], m) for t in own.keys() & counts.keys())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # Written first, so that Spark knows its size when it plans the join. A document's list is at most as long as the part of the questions.
    few = written(candidates.groupBy("doc_id", "key").agg(F.collect_set("question").alias("wanted")))
    rows = keyed(docs).alias("d").join(few.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key")))
    return rows.select("d.doc_id", "text", "wanted").mapInArrow(score, "question int, doc_id long, score long")


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where(F.col("rank") <= most)


def answers(docs: DataFrame, index: Index, asked: Questions) -> DataFrame:
    """question, rank, doc_id, score. The exact scores of the documents with the highest bounds set a threshold for each question; every document
    whose bound reaches it is scored."""
    first = ranked(over_blocks(index, asked, None), [F.desc("bound"), "doc_id"], FIRST)
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    threshold = np.ones(len(asked.weights))
    for r in ranked(exact_scores(docs, first, asked, index).where("score > 0"), by_score, TOP).where(F.col("rank") == TOP).collect():
        threshold[r["question"]] = r["score"]
    candidates = over_blocks(index, asked, threshold)
    return ranked(exact_scores(docs, candidates, asked, index).where("score > 0"), by_score, TOP)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the TOP best documents (doc_id, text) of every item (item_id, text); no more columns are read.

    Every row of items is asked, those of a null or repeated item_id too, in parts of about PART_BYTES; a null, empty or wordless item
    has no answers. Every row of docs is a document: rows of one doc_id are ranked each, a null doc_id comes last among equal scores, null
    and wordless texts are never found and not counted. Very long texts get wider blocks of fewer documents, copies one entry each.
    An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    empty = items.select("item_id", *(F.lit(0).cast(t).alias(c) for c, t in (("rank", "int"), ("doc_id", "long"), ("score", "long")))).limit(0)
    if not index.n_docs:
        return empty
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    dealt = written(items.select("item_id", "text", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part")))
    out = []
    for part in range(parts):
        own = dealt.where(F.col("part") == part).select("item_id", "text").collect()
        asked = questions([r["text"] for r in own], index)
        if not len(asked.term):
            continue
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(own)], f"question int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(answers(docs, index, asked).join(names, "question").select("item_id", "rank", "doc_id", "score"))
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0] if out else empty


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS asks FROM q GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM size),
m AS (SELECT doc_id, 25 + (75 * n * nd) // nt AS m FROM size, total),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (SELECT item_id, doc_id, sum(asks * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
