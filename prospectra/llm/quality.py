"""Quality classifier: text evidence of each document, combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import itertools
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import WORD_BYTES, attach, read, sampled, small_batches, text_bytes, written

TRAINING_ROWS = 8_000      # labelled rows that the text model is fitted on, about (a hash of doc_id picks them)
LEAST_DOCS, LEAST_Z, LEAST_LIFT = 5, 5.0, 5.0     # a word counts if so many rows have it and the classes differ that clearly
STEPS, RATE, RIDGE = 300, 0.1, 1e-5
STEMS = (4, 5, 6)           # bytes of word beginnings that are evidence besides whole words
HEADS = ("quality", "toxic")

#: Bytes: 0 other, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 blank, 5 end of line, 6 mark, 7 plain punctuation.
BYTE_CLASS = np.zeros(256, np.int64)
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r", 4), (b"\n", 5),
                       (b"!\"#$%&*+/:;<=>?@[\\]^_`{|}~", 6), (b".,'-()", 7)):
    BYTE_CLASS[list(_chars)] = _class


def evidence(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's distinct words and word beginnings, ascending, and its shape: shares of byte classes and of
    distinct words, word and line lengths."""
    raw = text_bytes(text)
    words = raw.translate(WORD_BYTES).split()
    distinct = set(words)
    stems = {b"^" + w[:size] for size in STEMS for w in distinct if len(w) > size}
    hashes = np.unique(np.fromiter(map(zlib.crc32, itertools.chain(distinct, stems)), np.uint32, len(distinct) + len(stems)))
    counts = np.bincount(BYTE_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    n, size, letters = max(1, len(words)), max(1, len(raw)), max(1, counts[1] + counts[2])
    shape = np.array([counts[2] / letters, counts[3] / size * 5, counts[6] / n, counts[7] / n, min(3.0, counts[5] * 10 / n),
                      len(distinct) / n, len(distinct) / n ** 0.7 / 3, size / n / 20, np.log1p(len(words)) / 10], np.float32)
    return hashes, np.minimum(shape, 5.0)


PACKED = T.StructType([T.StructField("hashes", T.BinaryType()), T.StructField("shape", T.BinaryType())])


@F.pandas_udf(PACKED)
def packed_evidence(texts: pd.Series) -> pd.DataFrame:
    found = [evidence(t) for t in texts]
    return pd.DataFrame({"hashes": [b.tobytes() for b, _ in found], "shape": [s.tobytes() for _, s in found]})


class Head(NamedTuple):
    words: np.ndarray       # hashes that count, ascending
    weights: np.ndarray     # theirs
    shape: np.ndarray       # weights of the shape, of its squares, and the constant

    def odds(self, hashes: np.ndarray, shape: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        own = self.weights[at[self.words[at] == hashes]].sum() if len(self.words) else 0.0
        return float(own + np.concatenate([shape, shape ** 2, [1.0]]) @ self.shape)


def fit_head(rows: np.ndarray, words: np.ndarray, vocabulary: np.ndarray, shapes: np.ndarray, truth: np.ndarray) -> Head:
    """Words whose share of rows differs clearly between the classes, then a logistic regression with a ridge on them and the
    shape, by full-batch Adam. (rows, words): which row holds which word of the vocabulary."""
    yes, no = truth.sum(), len(truth) - truth.sum()
    all_rows = np.bincount(words, minlength=len(vocabulary))
    with_yes = np.bincount(words, weights=truth[rows], minlength=len(vocabulary))
    share_yes, share_no, share = with_yes / yes, (all_rows - with_yes) / no, all_rows / len(truth)
    z = np.abs(share_yes - share_no) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / yes + 1 / no))
    lift = np.abs(np.log((share_yes + 0.5 / yes) / (share_no + 0.5 / no)))
    used = np.flatnonzero((all_rows >= LEAST_DOCS) & (z >= LEAST_Z) & (lift >= np.log(LEAST_LIFT)))
    place = np.full(len(vocabulary), -1)
    place[used] = np.arange(len(used))
    kept = place[words] >= 0
    rows, columns = rows[kept], place[words[kept]]
    dense = np.hstack([shapes, shapes ** 2, np.ones((len(shapes), 1))])
    w, v = np.zeros(len(used)), np.zeros(dense.shape[1])
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(v), np.zeros_like(v)]]
    for step in range(1, STEPS + 1):
        odds = np.bincount(rows, weights=w[columns], minlength=len(truth)) + dense @ v
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - truth) / len(truth)
        gradients = (np.bincount(columns, weights=error[rows], minlength=len(used)) + RIDGE * w, dense.T @ error)
        for value, gradient, (first, second) in zip((w, v), gradients, moments):
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient ** 2 - second)
            value -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return Head(vocabulary[used], w, v)


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, Head]:
    """One head per label column, from about TRAINING_ROWS labelled documents. A head that has not seen both of its classes
    is left out. Only the sample's evidence reaches the driver."""
    known = labels.where("doc_id IS NOT NULL").select("doc_id", *HEADS)
    share = min(1.0, TRAINING_ROWS / max(1, known.count()))
    sample = known.where(sampled("doc_id", share))      # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(*HEADS, packed_evidence("text").alias("e")).select(*HEADS, "e.*").collect()
    heads: dict[str, Head] = {}
    if not rows:
        return heads
    # Words that too few rows have can never count; without them little is left to hold.
    flat = np.frombuffer(b"".join(r.hashes for r in rows), np.uint32)
    vocabulary, held = np.unique(flat, return_counts=True)
    vocabulary = vocabulary[held >= LEAST_DOCS]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r.hashes) // 4 for r in rows])
    shapes = np.array([np.frombuffer(r["shape"], np.float32) for r in rows], np.float64)
    truths = {head: [r[head] for r in rows] for head in HEADS}
    del rows
    kept = np.isin(flat, vocabulary)
    words, owner = np.searchsorted(vocabulary, flat[kept]).astype(np.int32), owner[kept]
    del flat, kept, held
    for head in HEADS:
        known = np.array([t is not None for t in truths[head]])
        truth = np.array([float(bool(t)) for t in truths[head]])
        if 0 < truth[known].sum() < known.sum():
            own = known[owner]
            heads[head] = fit_head((np.cumsum(known) - 1)[owner[own]], words[own], vocabulary, shapes[known], truth[known])
    return heads


def scored(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """doc_id, host, path and the log-odds of every head for every row of docs; a missing head is null."""
    model = docs.sparkSession.sparkContext.broadcast(heads)

    def score(texts: pd.Series) -> pd.DataFrame:
        out = {h: [] for h in HEADS}
        for text in texts:
            found = evidence(text)
            for h in HEADS:
                out[h].append(model.value[h].odds(*found) if h in model.value else None)
        return pd.DataFrame({h: pd.array(out[h], dtype="Float64") for h in HEADS})

    odds = F.pandas_udf(score, T.StructType([T.StructField(h, T.DoubleType()) for h in HEADS]))
    site = lambda c: F.coalesce(F.col(c), F.lit("\0"))      # noqa: E731  no site is a site of its own
    return docs.select("doc_id", site("source").alias("host"), site("lang").alias("path"), odds("text").alias("_odds")).select("doc_id", "host", "path", "_odds.*")


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, center: Column) -> float:
    """How many documents the prior of a level is worth: by moments, prior variance over the variance between groups beyond
    what their sizes explain. groups: n and mean per group; few or equal groups give a strong prior."""
    inside = center * (1 - center)
    found = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * inside).alias("inside"), F.sum(F.col("n") * (F.col("mean") - center) ** 2).alias("spread"), F.count("*").alias("k")).first()
    if not found.n or not found.inside:
        return 1.0
    variance = found.inside / found.n
    between = (found.spread - found.k * variance) / found.n
    return float(min(1e4, max(1.0, variance / between - 1))) if between > 0 else 1e4


def with_sites(rows: DataFrame, head: str) -> DataFrame:
    """rows with <head>_site, the path's posterior share, and p_<head>, what text and site say together.

    Each level is an aggregate of documents' probabilities: all, hosts, paths of a host. A path is shrunk towards its host
    and a host towards all by as many documents as the level's strength. The path's odds against the whole are added to the text's.
    """
    rows = rows.withColumn("_p", logistic(F.col(head)))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("_p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total.n or total.s is None:
        return rows.withColumn(f"{head}_site", F.lit(None).cast("double")).withColumn(f"p_{head}", F.col("_p")).drop("_p")
    prior = min(1 - 1e-6, max(1e-6, total.s / total.n))
    a = strength(hosts.withColumn("mean", F.col("s") / F.col("n")), F.lit(prior))
    hosts = hosts.select("host", ((F.col("s") + a * prior) / (F.col("n") + a)).alias("host_mean"))
    paths = paths.join(hosts, "host")
    b = strength(paths.withColumn("mean", F.col("s") / F.col("n")), F.col("host_mean"))
    posterior = paths.select("host", "path", ((F.col("s") + b * F.col("host_mean")) / (F.col("n") + b)).alias(f"{head}_site"))
    out = attach(rows, posterior, ["host", "path"])
    return out.withColumn(f"p_{head}", logistic(F.col(head) + logit(F.col(f"{head}_site")) - float(np.log(prior / (1 - prior))))).drop("_p")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic, quality_site, toxic_site and keep for every row of docs.

    keep: good text is at least as likely as not, and toxic text is not. Whole texts are read; null and empty texts have no
    words and are judged by shape and site. Null hosts and paths are sites of their own. A head without labels of both
    classes is null and rejects nothing. Repeated rows are judged alike; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(scored(docs, fit(docs, labels)))
    for head in HEADS:
        rows = with_sites(rows, head)
    keep = (F.coalesce("p_quality", F.lit(1.0)) >= 0.5) & (F.coalesce("p_toxic", F.lit(0.0)) < 0.5)
    return rows.select("doc_id", "p_quality", "p_toxic", "quality_site", "toxic_site", keep.alias("keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
