"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import connected_components, read, small_batches, written

COSINE = 0.98
CODE_BITS = 256             # bits of a code at least, from as many rotations as that takes
BAND_BITS, BANDS = 16, 16   # a pair at the threshold shares a band with probability 0.347 and one of 16 with 0.999
CONFIDENCE = 3.0            # standard errors that an estimate may be off
SEED = 20_011
MEMBERS = 512               # vectors of a bucket or component that meet in one block; larger ones are cut into pairs of blocks
TASK_ROWS = 4_000           # rows of blocks that one call handles, about


@functools.lru_cache(maxsize=8)
def rotations(width: int) -> np.ndarray:
    """Orthogonal matrices, one beside the other, for vectors padded to `width`."""
    random = np.random.default_rng(SEED + width)
    return np.hstack([np.linalg.qr(random.standard_normal((width, width)))[0] for _ in range(-(-CODE_BITS // width))])


def padded_width(size: int) -> int:
    return max(64, -(-size // BAND_BITS) * BAND_BITS)


CODED = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType()), T.StructField("bands", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(CODED)
def coded(vectors: pd.Series) -> pd.DataFrame:
    """Sign bits of the rotated unit vectors; the factor is the inner product of each with the unit vector of its signs, which
    corrects estimates that are made from the signs alone; the bands are the code's first BANDS pieces of BAND_BITS."""
    out = [None] * len(vectors)
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        width = padded_width(int(size))
        unit = np.zeros((len(rows), width))
        unit[:, :size] = np.stack([np.asarray(vectors.iloc[r], np.float64) for r in rows])
        unit /= np.abs(unit).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        turned = unit @ rotations(width)
        codes = np.packbits(turned > 0, axis=1)
        factors = np.abs(turned).mean(1) * np.sqrt(width)
        bands = np.ascontiguousarray(codes[:, :BANDS * BAND_BITS // 8]).view(">u2").astype(np.int32)
        for r, code, factor, own in zip(rows.tolist(), codes, factors.tolist(), bands):
            out[r] = (code.tobytes(), factor, own.tolist())
    return pd.DataFrame(out, columns=["code", "factor", "bands"])


def may_link(codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Pairs whose cosine may be COSINE or more: the inner product of the signs, corrected by both factors, plus its
    confidence bound. Only these are recomputed from the vectors."""
    words = np.ascontiguousarray(codes).view(np.uint64)
    bits = codes.shape[1] * 8
    differing = np.zeros((len(words), len(words)), np.int64)
    for k in range(words.shape[1]):
        differing += np.bitwise_count(words[:, k, None] ^ words[None, :, k])
    correction = np.outer(factors, factors)
    estimate = (1 - 2 * differing / bits) / correction
    bound = CONFIDENCE * np.sqrt(np.maximum(1 / correction ** 2 - 1, 0) / (bits - 1))
    return estimate + bound >= COSINE


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the first row that it reaches."""
    own = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(reach, own[None, :], len(linked)).min(1)
        least = least[least]
        if (least == own).all():
            return own
        own = least


def blocks(group: pd.DataFrame):
    """The blocks of a call: rows of one bucket or component and one pair of its parts."""
    for _, rows in group.groupby(["block", "low", "high"], sort=False):
        if len(rows) > 1:
            yield rows.reset_index(drop=True)


def candidate_edges(group: pd.DataFrame) -> pd.DataFrame:
    """Edges that join what the bounds cannot rule out: of each block a forest, not its pairs."""
    found = []
    for rows in blocks(group):
        nodes = rows["node"].to_numpy()
        root = roots(may_link(np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]]), rows["factor"].to_numpy()))
        found += [(u, v) for u, v in zip(nodes.tolist(), nodes[root].tolist()) if u != v]
    return pd.DataFrame(found, columns=["u", "v"])


def exact_links(group: pd.DataFrame) -> pd.DataFrame:
    """Per vector of each block how many vectors it is linked with there, and an edge of the block's forest."""
    found = []
    for rows in blocks(group):
        vectors = np.stack([np.asarray(e, np.float64) for e in rows["embedding"]])
        part, same = rows["own"].to_numpy(), rows["low"].iloc[0] == rows["high"].iloc[0]
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        linked = vectors @ vectors.T >= COSINE
        np.fill_diagonal(linked, False)
        if not same:
            linked &= part[:, None] != part[None, :]
        counts = linked @ rows["copies"].to_numpy()
        root, nodes = roots(linked), rows["node"].to_numpy()
        found += zip(nodes.tolist(), nodes[root].tolist(), counts.tolist())
    return pd.DataFrame(found, columns=["node", "root", "links"])


def in_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a partner of the same key, dealt into blocks of at most about 2 * MEMBERS rows: a larger key is cut into parts
    by a hash, and each row goes to the pair of its part with every part. Column `call` deals the blocks to calls."""
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"))
    parts = F.ceil(F.col("size") / MEMBERS).cast("int")
    dealt = rows.join(sizes, key).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = written(dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn("block", F.xxhash64(*key)).drop("size", "parts", "other", *key))
    calls = max(1, dealt.count() // TASK_ROWS)
    return dealt.withColumn("call", F.pmod(F.xxhash64("block", "low", "high"), F.lit(calls)))


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))      # noqa: E731
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label).

    Equal vectors of a label become one class with a count. Classes that share a band of their codes, and whose estimated
    cosine with its bound reaches COSINE, are joined to candidate components; within these all cosines are computed in
    double precision, so a pair that no band joined is found where others join it. Links are counted per vector inside the blocks
    and only forests of edges leave them. Vectors without label or that are not usable, and those of other lengths, link with
    nothing; rows with a null vec_id count as copies and get their class's component; repeated rows are vectors of their own.
    A component of very many different vectors costs its square in blocks, since each link is counted.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = vectors.select("vec_id", "embedding", "label")
    good = own.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    named = classes.where("node IS NOT NULL").withColumn("width", F.size("embedding"))
    codes = named.select("node", "label", "width", coded("embedding").alias("c")).select("node", "label", "width", "c.code", "c.factor", F.posexplode("c.bands").alias("band", "bits"))
    buckets = in_blocks(written(codes), ["label", "width", "band", "bits"])
    edges = buckets.groupBy("call").applyInPandas(candidate_edges, "u long, v long")
    candidates = connected_components(edges)
    members = written(named.join(candidates, "node").select("node", "copies", "embedding", "component", "label", "width"))
    found = written(in_blocks(members, ["component", "label", "width"]).groupBy("call").applyInPandas(exact_links, "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    by_class = written(classes.join(links, "node", "left").join(components, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    rows = own.withColumn("embedding", F.when(F.col("label").isNotNull() & usable(F.col("embedding")), F.col("embedding"))).join(by_class, ["label", "embedding"], "left")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
