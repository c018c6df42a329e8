"""Packing of token streams into windows by order-preserving dynamic programming."""

from __future__ import annotations

import base64
import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from prospectra.llm.common import BATCH_ROWS, read, small_batches

WINDOW = 2048
# What a cut costs, in tokens of padding: after a document nothing, after a sentence little, inside one more.
SENTENCE_PENALTY, HARD_PENALTY = 6.0, 48.0
HARD_STEP = 64          # places offered for a cut inside a sentence that is longer than this

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cut string")


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """Byte-level BPE out of a vocabulary file's lines; kept per worker process."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=2)
def sentence_ends(ranks: bytes, pattern: str) -> np.ndarray:
    """For every id whether its bytes end a sentence."""
    coder = encoding(ranks, pattern)
    out = np.zeros(coder.n_vocab, bool)
    for i, token in enumerate(coder.token_byte_values()):
        out[coder.encode_single_token(token)] = token.rstrip(b" ").endswith((b".", b"!", b"?", b"\n"))
    return out


def places_to_cut(ends: np.ndarray, doc_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and the penalty of each. ends: positions after a sentence."""
    soft = np.unique(np.concatenate([ends, doc_ends, [0, total]]))
    gaps = np.diff(soft)
    hard = [np.arange(a + HARD_STEP, a + g, HARD_STEP) for a, g in zip(soft[:-1][gaps > HARD_STEP], gaps[gaps > HARD_STEP])]
    places = np.unique(np.concatenate([soft, *hard])).astype(np.int64)
    penalty = np.full(len(places), HARD_PENALTY)
    penalty[np.isin(places, soft)] = SENTENCE_PENALTY
    penalty[np.isin(places, np.append(doc_ends, [0, total]))] = 0.0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Window ends of least padding plus penalties.

    cost[j] = penalty[j] + min over i with places[j] - places[i] <= window of cost[i] + window - (places[j] - places[i]).
    cost[i] + places[i] is all of the minimum that depends on i, so the candidates form a sliding window whose minimum
    a monotone queue keeps: each place enters and leaves it once.
    """
    at, fee = places.tolist(), penalty.tolist()
    back = [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(float(at[0]), at[0], 0)])      # (cost + place, place, index)
    push, drop_last, drop_first = queue.append, queue.pop, queue.popleft
    for j in range(1, len(at)):
        here = at[j]
        while here - queue[0][1] > window:
            drop_first()
        least, _, back[j] = queue[0]
        value = least + window + fee[j]             # cost[j] + places[j]
        while queue and queue[-1][0] >= value:
            drop_last()
        push((value, here, j))
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def split_tail(start: int, end: int, window: int = WINDOW) -> list[int]:
    """Ends of the last window's parts. A part whose length is a power of two needs no padding, so the rest of a stream is
    cut into such parts where that costs less than padding it."""
    length = end - start
    bits = [1 << b for b in range(window.bit_length() - 1, -1, -1) if length >> b & 1]
    if length == 0 or (len(bits) - 1) * HARD_PENALTY >= window - length:
        return [end]
    return (start + np.cumsum(bits)).tolist()


def pack_batch(doc_ids, texts, first_sequence: int, ranks: bytes, pattern: str, end_id: int) -> tuple[pd.DataFrame, int]:
    coder, is_end = encoding(ranks, pattern), sentence_ends(ranks, pattern)
    last = np.array([end_id], np.uint32)
    parts = []
    for text in texts:
        if isinstance(text, str) and text:
            parts.append(np.asarray(coder.encode_to_numpy(text, disallowed_special=()), np.uint32))
        parts.append(last)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    is_last = np.fromiter((p is last for p in parts), bool, len(parts))
    doc_ends = np.cumsum([len(p) for p in parts])[is_last] if parts else np.zeros(0, np.int64)
    total = len(ids)
    if not total:
        return pd.DataFrame(columns=[c.split()[0] for c in PIECES.split(", ")]), first_sequence
    places, penalty = places_to_cut(np.flatnonzero(is_end[np.minimum(ids, len(is_end) - 1)]) + 1, doc_ends, total)
    cuts = best_cuts(places, penalty)
    cuts[-1:] = split_tail(cuts[-2] if len(cuts) > 1 else 0, total)
    cuts = np.array(cuts, np.int64)
    ends = np.union1d(cuts, doc_ends)                    # every piece ends where a window or a document does
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, starts, "right")
    window = np.searchsorted(cuts, starts, "right")
    doc_start = np.concatenate([[0], doc_ends[:-1]])
    raw = ids.astype("<u4").tobytes()
    kind = np.where(np.isin(ends, doc_ends), "document", np.where(penalty[np.minimum(np.searchsorted(places, ends), len(places) - 1)] == SENTENCE_PENALTY, "sentence", "inside"))
    return pd.DataFrame({
        "doc_id": pd.array([doc_ids[i] for i in doc], dtype="Int64"), "start": starts - doc_start[doc], "length": ends - starts,
        "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
        "doc_tokens": (doc_ends - doc_start)[doc], "sequence_id": first_sequence + window,
        "offset": starts - np.concatenate([[0], cuts[:-1]])[window], "cut": kind,
    }), first_sequence + len(cuts)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in windows of at most WINDOW tokens, in the documents' order.

    Each batch of a partition is one stream and is packed alone, so no row moves and a lost task is simply run again;
    a sequence id holds the partition's number above 40 bits of a count in it. Documents that are null or empty give their
    end id alone. Rows with equal or null doc_id are packed as documents of their own. An empty table gives no piece.
    Texts of any length are tokenised whole. Other columns, whatever their names, are not read.
    `cut` says where a piece ends: document, sentence or inside.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())       # the vocabulary file, about a megabyte

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                ids, texts = (batch[c].iloc[at:at + BATCH_ROWS] for c in ("doc_id", "text"))
                ids = [None if pd.isna(i) else int(i) for i in ids]
                out, sequence = pack_batch(ids, texts, sequence, vocabulary.value, pattern, end_id)
                yield out

    return docs.select("doc_id", "text").mapInPandas(pack, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
