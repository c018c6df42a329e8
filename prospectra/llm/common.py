"""Helpers that several operators of this package share."""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch: at a few kilobytes of text a row, a batch stays within some tens of megabytes.
BATCH_ROWS = 1000
# Rows up to which a side table may be broadcast (some megabytes); larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text to its words: A-Z become a-z, ASCII bytes that are neither letters nor digits become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of wide text columns small; a session setting, as Spark has no other place for it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sampled(key: str, share: float) -> Column:
    """Whether a row is in a sample of that share of all keys, by hashes: 10^15 steps, so that a bounded sample of any table exists."""
    coarse, fine = F.pmod(F.xxhash64(key), F.lit(10**6)), F.pmod(F.xxhash64(key, F.lit("fine")), F.lit(10**9))
    return coarse * 10**9 + fine < F.lit(round(share * 10**15))


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text_bytes(text).translate(WORD_BYTES).split()


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@functools.cache
def folder_of(application: str) -> str:
    """A temporary folder for a local session."""
    return "file://" + tempfile.mkdtemp(prefix=f"prospectra-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; without that setting a local session gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder_of(spark.sparkContext.applicationId)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, readable by every executor."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, small: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join with a table of one row per key. Up to BROADCAST_ROWS rows it is broadcast; a larger one is copied once
    per salt, so the rows of a hot key spread over `salts` tasks. Both give the same rows."""
    if len(small.limit(BROADCAST_ROWS + 1).select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), keys, "left")
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def unsigned_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that it reaches.

    Alternating large-star and small-star rounds. Minima combine before the shuffle and the joins are plain
    equi-joins, so a hub's rows can be split. Each round is a written table; nothing but two sums reaches the driver.
    """
    now = written(edges.select(F.least(u, v).alias("v"), F.greatest(u, v).alias("u")).where("u <> v").distinct())
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(down.select("u", F.col("m").alias("v"))).distinct())
        now = written(small)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
