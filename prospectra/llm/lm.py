"""Documents scored by the difference of two n-gram models' cross-entropies: a target's and the whole corpus's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import read, small_batches, words_of, written

MOST_WORDS = 65_534             # words of the shared vocabulary; ids fit 16 bits with 0 for any other word
START = 65_535                  # stands before a document's first word
DISCOUNT = 0.75
SCALE = 65_536                  # losses are whole numbers of this part of a bit, so that their sums are exact
COUNT_CAP = 1_000_000           # counts from here on are alike when the vocabulary's least count is sought
CELLS = 512                     # parts of the models, by the first word of a pair
CHUNK_WORDS = 2_000_000         # documents are gathered in chunks of about so many words
MERGED, ANSWERED = 64, 256      # chunks whose parts of a cell meet in one task: to be summed, to be answered

WORD_COUNTS = "word binary, n long"
PARTS = "chunk long, cell int, a binary, b binary, c binary, ids array<int>, counts array<long>"
TOKENS, UNIGRAMS = -1, -2       # cells of the rows that hold a chunk's tokens and its target word counts


def packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed bytes: all lowest bytes first, then all next ones."""
    flat = np.ascontiguousarray(values, kind)
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending pairs as differences."""
    return packed(np.diff(keys, prepend=np.uint32(0)), "<u4")


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u4"), dtype=np.uint32)


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and their counts, combined over what a task has read so far."""
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(words_of(text))
        if len(counts) > 500_000:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
            counts.clear()
    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def vocabulary(docs: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """The shared vocabulary and its counts over all documents, other words' sum first: all words with at least the least count
    that leaves no more than MOST_WORDS of them."""
    counts = written(docs.select("text").mapInPandas(count_words, WORD_COUNTS).groupBy("word").agg(F.sum("n").alias("n")))
    held, least = 0, COUNT_CAP + 1
    for n, words in sorted(((r["n"], r["count"]) for r in counts.groupBy(F.least("n", F.lit(COUNT_CAP)).alias("n")).count().collect()), reverse=True):
        held += words
        if held > MOST_WORDS:
            break
        least = n
    kept = sorted((bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= least).collect())
    other = counts.where(F.col("n") < least).agg(F.sum("n")).first()[0] or 0
    return {w: i + 1 for i, (w, _) in enumerate(kept)}, np.array([other, *(n for _, n in kept)], np.float64)


def pairs_of(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token with the one before it, in one number; a document's first token with START."""
    before = np.empty(len(tokens), np.uint32)
    before[1:] = tokens[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts] = START
    return before << np.uint32(16) | tokens.astype(np.uint32)


def by_cell(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct pairs by cell and key, the cells that have some, and where each begins."""
    cells = (keys >> np.uint32(16)) % CELLS
    order = np.argsort(cells, kind="stable")
    held, begins = np.unique(cells[order], return_index=True)
    return order, held, np.append(begins, len(keys))


def encoded(words: dict[bytes, int]):
    """Word ids of a text, two bytes each."""

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = words.get
        for batch in texts:
            yield pd.Series([np.fromiter((known(w, 0) for w in own), "<u2", len(own)).tobytes() for own in map(words_of, batch)])

    return F.pandas_udf(encode, T.BinaryType())


def chunk_rows(chunk: int, ids: list, docs: list[bytes], wanted: list[bool]) -> pd.DataFrame:
    """One row with the chunk's tokens, one with the target's word counts, and one per cell with the chunk's distinct pairs and
    how often corpus and target have them."""
    lengths = np.array([len(d) // 2 for d in docs], np.int64)
    tokens = np.frombuffer(b"".join(docs), "<u2")
    target = np.repeat(np.array(wanted, bool), lengths)
    keys, inverse, counts = np.unique(pairs_of(tokens, lengths), return_inverse=True, return_counts=True)
    in_target = np.bincount(inverse, weights=target, minlength=len(keys))
    order, cells, begins = by_cell(keys)
    held = np.bincount(tokens[target], minlength=1)
    known = np.array([i is not None for i in ids], np.int64)
    rows = [(chunk, TOKENS, packed(np.concatenate([known, [i or 0 for i in ids]]), "<i8"), packed(lengths, "<i8"), packed(tokens, "<u2"), [], []),
            (chunk, UNIGRAMS, None, None, None, np.flatnonzero(held).tolist(), held[held > 0].tolist())]
    for cell, a, b in zip(cells.tolist(), begins[:-1], begins[1:]):
        own = order[a:b]
        rows.append((chunk, cell, packed_keys(keys[own]), packed(counts[own], "<i8"), packed(in_target[own], "<i8"), [], []))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])


def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of chunks of a partition's documents."""
    chunk = TaskContext.get().partitionId() << 24
    ids, docs, wanted, size = [], [], [], 0
    for batch in batches:
        for doc_id, tokens, target in zip(batch["doc_id"], batch["tokens"], batch["target"]):
            docs.append(tokens)
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            wanted.append(target is not None and bool(target))
            size += len(tokens) // 2
            if size >= CHUNK_WORDS or len(ids) >= CHUNK_WORDS:
                yield chunk_rows(chunk, ids, docs, wanted)
                chunk, ids, docs, wanted, size = chunk + 1, [], [], [], 0
    if ids:
        yield chunk_rows(chunk, ids, docs, wanted)


def merge_cells(group: pd.DataFrame) -> pd.DataFrame:
    """Sums a cell's counts over some chunks."""
    keys = np.concatenate([unpacked_keys(x) for x in group["a"]])
    distinct, inverse = np.unique(keys, return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([unpacked(x, "<i8") for x in group[c]]), minlength=len(distinct)) for c in ("b", "c")]
    return pd.DataFrame({"cell": group["cell"].iloc[:1], "part": group["part"].iloc[:1], "a": [packed_keys(distinct)], "b": [packed(sums[0], "<i8")], "c": [packed(sums[1], "<i8")]})


def merged(parts: DataFrame, chunks: int) -> DataFrame:
    """One row per cell with all its pairs and both counts: a tree of sums of at most about MERGED rows each."""
    rows, groups = parts.select("cell", F.xxhash64("chunk").alias("part"), "a", "b", "c"), chunks
    while True:
        groups = -(-groups // MERGED)
        rows = rows.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("cell", "part").applyInPandas(merge_cells, "cell int, part long, a binary, b binary, c binary")
        if groups == 1:
            return rows.drop("part")


def answer_cells(group: pd.DataFrame) -> pd.DataFrame:
    """What both models know of each chunk's pairs, in the chunk's own order: counts of the pairs (b) and, per first word, tokens and
    kinds of words behind it (c), the corpus's before the target's."""
    of_model = group["chunk"].isna()
    model = group[of_model].iloc[0]
    keys = unpacked_keys(model["a"])
    counts = np.stack([unpacked(model[c], "<i8") for c in ("b", "c")])
    firsts, begins = np.unique(keys >> np.uint32(16), return_index=True)
    behind = np.concatenate([np.add.reduceat(counts, begins, axis=1), np.add.reduceat((counts > 0).astype(np.int64), begins, axis=1)])
    rows = []
    for chunk, cell, asked in group.loc[~of_model, ["chunk", "cell", "a"]].itertuples(index=False):
        own = unpacked_keys(asked)
        at = np.searchsorted(firsts, np.unique(own >> np.uint32(16)))
        rows.append((int(chunk), cell, None, packed(counts[:, np.searchsorted(keys, own)], "<i8"), packed(behind[:, at], "<i8")))
    return pd.DataFrame(rows, columns=["chunk", "cell", "a", "b", "c"])


def losses(counts: np.ndarray, total: np.ndarray, kinds: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """Losses of pairs in SCALE parts of a bit: absolute discounting, interpolated with the unigram probability of the second
    word, which stands alone behind a first word that the model has not seen."""
    seen = np.maximum(total, 1.0)
    p = np.where(total > 0, np.maximum(counts - DISCOUNT, 0.0) / seen + DISCOUNT * kinds / seen * unigram, unigram)
    return np.rint(-np.log2(p) * SCALE).astype(np.int64)


def score_chunks(models: list[np.ndarray]):
    """Sums of both losses per document of a chunk."""

    def score(group: pd.DataFrame) -> pd.DataFrame:
        row = group[group["cell"] == TOKENS].iloc[0]
        lengths, tokens = unpacked(row["b"], "<i8"), unpacked(row["c"], "<u2")
        known, ids = unpacked(row["a"], "<i8").reshape(2, -1)
        keys, inverse = np.unique(pairs_of(tokens, lengths), return_inverse=True)
        order, cells, begins = by_cell(keys)
        place = {c: order[a:b] for c, a, b in zip(cells.tolist(), begins[:-1], begins[1:])}
        counts, behind = np.zeros((2, len(keys))), np.zeros((4, len(keys)))
        for cell, b, c in group.loc[group["cell"] >= 0, ["cell", "b", "c"]].itertuples(index=False):
            own = place[cell]
            counts[:, own] = unpacked(b, "<i8").reshape(2, -1)
            behind[:, own] = unpacked(c, "<i8").reshape(4, -1)[:, np.unique(keys[own] >> np.uint32(16), return_inverse=True)[1]]
        ends = np.cumsum(lengths)
        sums = []
        for m, unigram in enumerate(models):
            table = losses(counts[m], behind[m], behind[2 + m], unigram[keys & np.uint32(0xFFFF)])
            upto = np.append(0, np.cumsum(table[inverse]))
            sums.append(upto[ends] - upto[ends - lengths])
        return pd.DataFrame({"doc_id": pd.array([int(i) if k else None for i, k in zip(ids, known)], dtype="Int64"), "n_tokens": lengths, "background": sums[0], "target": sums[1]})

    return score


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits per word) and score, their difference, for every row of docs; a low
    score is like the target. target: doc_ids of the documents that the target model is made of; the background is all of docs.

    Both are bigram models with the same vocabulary, order and smoothing, counted over all documents. Documents are encoded
    once, in chunks; each chunk sends its distinct pairs to the cells of their first word, where counts are summed in a tree and
    what both models know of them is sent back. A pair thus reaches a cell once per chunk, however often a passage is repeated, and
    only the bounded vocabulary is broadcast. Null and empty texts have no tokens and null losses. Repeated rows are
    scored and counted each; rows with a null doc_id are in the background only; an empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words, unigrams = vocabulary(docs)
    # The target grows with the corpus, so it is never broadcast: one plan at every size.
    wanted = target.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    parts = written(docs.select("doc_id", encoded(words)("text").alias("tokens")).join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "tokens", "target").mapInPandas(gather, PARTS))
    chunks = parts.where(F.col("cell") == TOKENS).count()
    if not chunks:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), *(F.lit(None).cast("double").alias(c) for c in ("target_loss", "background_loss", "score"))).limit(0)
    in_target = np.zeros(len(unigrams))
    for row in parts.where(F.col("cell") == UNIGRAMS).select(F.explode(F.arrays_zip("ids", "counts")).alias("z")).groupBy("z.ids").agg(F.sum("z.counts").alias("n")).collect():
        in_target[row["ids"]] = row["n"]
    models = [(u + 1) / (u.sum() + len(u)) for u in (unigrams, in_target)]
    pairs = parts.where("cell >= 0").select("chunk", "cell", "a", "b", "c")
    cells = written(merged(pairs, chunks))
    groups = -(-chunks // ANSWERED)
    asked = pairs.select("chunk", "cell", "a", F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"), F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("part"))
    held = cells.select(F.lit(None).cast("long").alias("chunk"), "cell", "a", "b", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    reach = "chunk long, cell int, a binary, b binary, c binary"
    # A part without any chunk's pairs of a cell answers nothing.
    answered = asked.union(held).groupBy("cell", "part").applyInPandas(answer_cells, reach)
    tokens = parts.where(F.col("cell") == TOKENS).select("chunk", "cell", "a", "b", "c")
    sums = tokens.union(answered).groupBy("chunk").applyInPandas(score_chunks(models), "doc_id long, n_tokens long, background long, target long")
    bits = lambda c: F.when(F.col("n_tokens") > 0, c / SCALE / F.col("n_tokens"))      # noqa: E731
    return sums.select("doc_id", "n_tokens", bits(F.col("target")).alias("target_loss"), bits(F.col("background")).alias("background_loss"),
                       bits(F.col("target") - F.col("background")).alias("score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return cross_entropy_difference(read(spark, sf_dir, "documents"), good)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
                  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS target FROM documents),
t AS (SELECT doc_id, target, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
counted AS (SELECT word, least(count(*), 1000000) AS n FROM t GROUP BY word),
least_count AS (SELECT min(n) AS n FROM (SELECT n, sum(count(*)) OVER (ORDER BY n DESC) AS held FROM counted GROUP BY n) WHERE held <= 65534),
vocabulary AS (SELECT word FROM counted WHERE n >= (SELECT n FROM least_count)),
tok AS (SELECT doc_id, target, i, CASE WHEN v.word IS NULL THEN '' ELSE v.word END AS cur FROM t LEFT JOIN vocabulary v USING (word)),
pairs AS (SELECT doc_id, target, cur, lag(cur, 1, ' ') OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM tok),
symbols AS (SELECT count(*) + 1 AS v FROM vocabulary),
uni AS (SELECT cur, (count(*) + 1) / ((SELECT count(*) FROM tok) + v)::DOUBLE AS pb, (count(*) FILTER (WHERE target) + 1) / ((SELECT count(*) FROM tok WHERE target) + v)::DOUBLE AS pt
        FROM tok, symbols GROUP BY cur, v),
bi AS (SELECT prev, cur, count(*) AS cb, count(*) FILTER (WHERE target) AS ct FROM pairs GROUP BY prev, cur),
ctx AS (SELECT prev, sum(cb) AS nb, count(*) AS kb, sum(ct) AS nt, count(*) FILTER (WHERE ct > 0) AS kt FROM bi GROUP BY prev),
loss AS (SELECT prev, cur, round_even(-log2(greatest(cb - 0.75::DOUBLE, 0) / nb::DOUBLE + 0.75::DOUBLE * kb / nb::DOUBLE * pb) * 65536, 0)::BIGINT AS lb,
                round_even(-log2(CASE WHEN nt > 0 THEN greatest(ct - 0.75::DOUBLE, 0) / nt::DOUBLE + 0.75::DOUBLE * kt / nt::DOUBLE * pt ELSE pt END) * 65536, 0)::BIGINT AS lt
         FROM bi JOIN ctx USING (prev) JOIN uni USING (cur)),
sums AS (SELECT doc_id, count(*) AS n, sum(lb)::BIGINT AS b, sum(lt)::BIGINT AS t FROM pairs JOIN loss USING (prev, cur) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, t / 65536.0::DOUBLE / n AS target_loss, b / 65536.0::DOUBLE / n AS background_loss, (t - b) / 65536.0::DOUBLE / n AS score
FROM d LEFT JOIN sums USING (doc_id)
"""
