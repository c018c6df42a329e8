"""Benchmark passages in training documents, found in one FM-index per shard of documents."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import read, small_batches, words_of

SPAN_WORDS = 13          # words of a window
SAMPLE = 4               # every so many positions of a shard keep their place in the suffix order
SHARD_WORDS = 2_000_000  # a shard closes at this many words; a longer document is a shard of its own
PATTERN_WORDS = 4_000_000   # words of windows that one pass over the documents searches for

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("unnamed", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def in_order(item: int | None) -> tuple[bool, int]:
    """Ascending, null last."""
    return item is None, item or 0


class Windows:
    """The distinct windows of some benchmark items over a vocabulary of their own; word 0 is any other word."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], width: int = SPAN_WORDS) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        pairs = set()
        self.names = sorted({item for item, _ in items}, key=in_order)     # item_ids are places in it
        places = {item: k for k, item in enumerate(self.names)}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                pairs.add((number.setdefault(tuple(ids[at:at + width]), len(number)), places[item]))
        self.lengths = np.array([len(w) for w in number], np.int64)
        self.words = np.zeros((len(number), width), np.int64)          # right-aligned: the search starts at the last word
        for i, w in enumerate(number):
            self.words[i, width - len(w):] = w
        ordered = sorted(pairs)
        self.item_ids = np.array([p[1] for p in ordered], np.int64)
        self.item_at = np.searchsorted(np.array([p[0] for p in ordered], np.int64), np.arange(len(number) + 1))


class WaveletMatrix:
    """Bits of a sequence, one level per bit of its symbols, each with running counts."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for shift, ones, zeros in self.levels:
            bit = (symbol >> shift & 1).astype(bool)
            a, b = ones[low], ones[at]
            low, at = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for _, ones, zeros in self.levels:
            a = ones[at]
            bit = ones[at + 1] - a
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + a, at - a)
        return out


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of word ids by prefix doubling. Each 0 counts as a symbol of its own, smaller where it stands earlier, so
    nothing is compared beyond a foreign word; only groups that are still tied are sorted again."""
    n = len(text)
    step = max(1, 60 // bits)
    key = np.zeros(n, np.int64)
    ends = np.zeros(n, bool)                      # a 0 was met within the key
    padded = np.concatenate([text, np.zeros(step, np.int64)])
    for k in range(step):
        word = np.where(ends, 0, padded[k:k + n])
        key = key << bits | word
        ends |= padded[k:k + n] == 0
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | ends[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    while True:
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, n))
        places = np.flatnonzero(np.repeat(sizes > 1, sizes))      # places of the order that are tied
        if not len(places):
            return order
        rows = order[places]
        behind = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)], -1)
        group = rank[rows]
        rows, group, behind = (x[np.lexsort((behind, group))] for x in (rows, group, behind))
        order[places] = rows
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        fresh[places] = new
        rank[rows] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class ShardIndex:
    """FM-index of a shard's words: last column in a wavelet matrix, first column as counts, sampled suffix positions."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.append(text, 0)                # the end is a break like any other
        bits = max(1, int(symbols).bit_length())
        order = suffix_order(text, bits)
        before = np.where(order > 0, text[order - 1], 0)
        self.last = WaveletMatrix(before, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # A walk back cannot pass a foreign word, as those are told apart by place: what follows one is sampled too.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]
        self.size = len(text)

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-order interval of each right-aligned window, by backward search over all windows at once."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        width = words.shape[1] if words.ndim == 2 else 0
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                break
            word = words[live, width - back]
            low[live] = self.first[word] + self.last.rank(word, low[live])
            high[live] = self.first[word] + self.last.rank(word, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of places in the suffix order: walks back to the next sampled one."""
        out, walked = np.empty(len(rows), np.int64), 0
        at, open_rows = rows.copy(), np.arange(len(rows))
        while len(open_rows):
            known = self.kept_rank[at + 1] > self.kept_rank[at]
            out[open_rows[known]] = self.samples[self.kept_rank[at[known]]] + walked
            at, open_rows = at[~known], open_rows[~known]
            word = self.last.access(at)
            at = self.first[word] + self.last.rank(word, at)
            walked += 1
        return out


def flat(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high, and which range each is of."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def search_shard(docs: list[list[bytes]], windows: Windows) -> list[tuple[list[int | None], list[tuple[int, int]]]]:
    """Per document the items with an occurring window and the merged spans of words."""
    known = windows.vocabulary.get
    text = np.fromiter((known(w, 0) for words in docs for w in itertools.chain(words, (b"",))), np.int64, sum(map(len, docs)) + len(docs))
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    index = ShardIndex(text, len(windows.vocabulary))
    rows, window = flat(*index.search(windows.words, windows.lengths))
    at = index.locate(rows)
    doc = np.searchsorted(starts, at, "right") - 1
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + windows.lengths[window], -1)
    hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    begins, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    span_doc = np.searchsorted(starts, begins, "right") - 1
    pairs = np.unique(np.stack([doc, window]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    items, owner = flat(windows.item_at[pairs[1]], windows.item_at[pairs[1] + 1])
    out: list[tuple[list[int | None], list[tuple[int, int]]]] = [([], []) for _ in docs]
    for d, item in sorted(set(zip(pairs[0][owner].tolist(), windows.item_ids[items].tolist()))):
        out[d][0].append(windows.names[item])
    for d, a, b in zip(span_doc.tolist(), begins.tolist(), ends.tolist()):
        out[d][1].append((a - int(starts[d]), b - int(starts[d])))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def batches_of_windows(benchmark: DataFrame) -> Iterator[Windows]:
    """The benchmark in parts of a bounded number of window words; one part is in memory at a time."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row.text)
        if part and size + len(words) * SPAN_WORDS > PATTERN_WORDS:
            yield Windows(part)
            part, size = [], 0
        part.append((row.item_id, words))
        size += len(words) * SPAN_WORDS
    yield Windows(part)


def shard_search(windows: Broadcast):
    """One pass: cuts each batch into shards and adds what they hold of these windows to what earlier passes found."""

    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            words = [words_of(t) for t in texts]
            results, shard, size = [], [], 0
            for w in words:
                if shard and size + len(w) > SHARD_WORDS:
                    results += search_shard(shard, windows.value)
                    shard, size = [], 0
                shard.append(w)
                size += len(w) + 1
            results += search_shard(shard, windows.value) if shard else []
            for k, (items, unnamed, spans) in enumerate(zip(before["items"], before["unnamed"], before["spans"])):
                if items is not None:
                    results[k] = (sorted({*results[k][0], *items, *([None] if unnamed else [])}, key=in_order), merged([*results[k][1], *((s["start"], s["end"]) for s in spans)]))
            yield pd.DataFrame({
                "n_words": [len(w) for w in words], "n_hit": [sum(b - a for a, b in r[1]) for r in results],
                "items": [[i for i in r[0] if i is not None] for r in results], "unnamed": [None in r[0] for r in results], "spans": [[{"start": a, "end": b} for a, b in r[1]] for r in results],
            })

    return F.pandas_udf(search, FOUND)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, into: str = "found") -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, items (ascending), unnamed (whether items without an id hit) and spans of words to
    remove (merged, end exclusive).

    A shard is a run of a partition's documents. The benchmark is the stated query set: its windows go to the tasks in parts
    of at most PATTERN_WORDS words; a larger benchmark takes more passes over the documents' rows, which carry on
    what the earlier passes found. No row is shuffled. Null and empty texts have no words and no hits, an
    empty benchmark hits nothing, items with a null id hit but are not listed, repeated items and rows count as they stand. Texts are
    searched whole. Other columns of docs stay as they are; one named like `into` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.withColumn(into, F.lit(None).cast(FOUND))
    for part in batches_of_windows(benchmark):
        out = out.withColumn(into, shard_search(spark.sparkContext.broadcast(part))(F.col("text"), F.col(into)))
    return out


def contaminated(found: str = "found"):
    """The rule: a twentieth of the words or more are hit, and one at least."""
    n_hit, n_words = F.col(found)["n_hit"], F.col(found)["n_words"]
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, read(spark, sf_dir, "benchmark")).drop("text")
    joined = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "found.n_words", "found.n_hit", (F.size("found.items") + F.col("found.unnamed").cast("int")).cast("long").alias("n_items"),
                        F.sha2(joined, 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, phrase)),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN marked USING (doc_id)
"""
