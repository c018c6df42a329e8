"""Near-duplicate documents by SimHash, linked through deletion variants of fingerprint segments."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import connected_components, read, small_batches, text_bytes, unsigned_hex, written

SHINGLE, SEED, MOST_BITS = 3, 42, 2
SEGMENT_BITS = 32       # two segments: of at most two differing bits, one segment has at most one


def fingerprint(text: str | None) -> int:
    """64 bits; bit b is 1 if it is set in over half of the shingles' hashes. A text without words gives 0."""
    words = text_bytes(text).lower().split()            # bytes: only A-Z change, only ASCII blanks separate
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """Fingerprints of whole texts as signed longs; null is empty."""
    return texts.map(fingerprint).astype("int64")


def variants(fp: Column) -> Column:
    """The one-wildcard variants of both segments: (segment and wildcard) << 32 | segment without the wildcard's bit."""
    halves = (F.shiftrightunsigned(fp, SEGMENT_BITS), fp.bitwiseAND((1 << SEGMENT_BITS) - 1))
    return F.array(*(half.bitwiseAND(~(1 << bit)).bitwiseOR((s * SEGMENT_BITS + bit) << SEGMENT_BITS)
                     for s, half in enumerate(halves) for bit in range(SEGMENT_BITS)))


def links(prints: DataFrame) -> DataFrame:
    """(u, v) of all pairs of rows of `prints` (fp, node; fp distinct) that differ in MOST_BITS or fewer bits, each once."""
    index = prints.select("fp", "node", F.explode(variants(F.col("fp"))).alias("key"))
    a, b = index.alias("a"), index.alias("b")
    differing = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    high, low = F.shiftrightunsigned(differing, SEGMENT_BITS), differing.bitwiseAND((1 << SEGMENT_BITS) - 1)
    # A pair shares up to 32 variants of a segment; it counts where the wildcard is the differing bit, or else the first.
    place = (F.when(F.bit_count(high) == 0, 0).when(F.bit_count(high) == 1, F.bit_count(high - 1)).otherwise(SEGMENT_BITS))
    # Spark takes the exploded index for as small as the rows that it came from and would broadcast all variants; hence the hint.
    return (a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.bit_count(differing) <= MOST_BITS)
                   & (F.shiftrightunsigned(F.col("a.key"), SEGMENT_BITS) == place))
            .select(F.col("a.node").alias("u"), F.col("b.node").alias("v")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) for every row of docs.

    Equal fingerprints become one class before anything is joined, so a group of copies costs one row of the index whatever
    its size; links join class representatives only. Null, empty and blank texts share fingerprint 0. Repeated rows
    give repeated results; rows with a null doc_id are kept, with the component of their fingerprint, null if no other row has it.
    """
    small_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", simhash("text").alias("fp")))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    components = connected_components(links(classes.where("node IS NOT NULL")))
    by_print = classes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # A row per document, which takes far less room in a file (with many copies) than in memory, must not be broadcast for its file's size.
    return prints.join(by_print.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
