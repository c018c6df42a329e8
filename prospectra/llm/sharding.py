"""Shards of equal size that cut few links between documents, by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospectra.llm.common import read, written

SHARDS = 24
ROUNDS = 6                  # propagation ends earlier once fewer than one linked document in STILL may move
STILL = 1000
SMALL_GROUP = 64            # rows of a group that are numbered by one sort
ROWS_PER_BUCKET = 10_000    # documents that one sort numbers, about


def by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), shard + 1)


def shard_counts(rows: DataFrame, shards: int) -> list[int]:
    """Rows per shard: the only thing about them that the driver sees."""
    found = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Moves linked documents (row, group, shard, group_size) towards the shard that holds most of their neighbours.

    A round counts the neighbours of each group per shard, those in a full shard half, joins the shard with most back as the
    wish of every member that is elsewhere, and lets a share of the wishes pass: as many as the wished shard has room for
    below its capacity. A hash of group and round picks them, so that a group moves as one. Counts combine before the shuffle; wishes come by an equi-join that a hot group's rows may split.
    """
    total = linked.count()
    for turn in range(ROUNDS):
        size = shard_counts(linked, shards)
        weight = F.element_at(F.array(*(F.lit(0.5 if n >= capacity else 1.0) for n in size)), F.col("shard") + 1)
        held = linked.groupBy("group", "shard").agg((F.count("*") * F.first(weight)).alias("n"))
        wish = written(held.groupBy("group").agg(F.max_by("shard", F.struct("n", F.xxhash64("group", "shard"))).alias("wish")))
        asked = written(linked.join(wish, "group"))
        moves = {(r["shard"], r["wish"]): r["count"] for r in asked.where("shard <> wish").groupBy("shard", "wish").count().collect()}
        wanted = [sum(n for (_, to), n in moves.items() if to == s) for s in range(shards)]
        leaving = [sum(min(n, moves.get((to, s), 0)) for (at, to), n in moves.items() if at == s) for s in range(shards)]    # matched exchanges
        share = [0.0 if not w else min(1.0, max(0, capacity - held_now + out) / w) for held_now, out, w in zip(size, leaving, wanted)]
        draw = F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        passes = draw < F.element_at(F.array(*map(F.lit, share)), F.col("wish") + 1)
        linked = written(asked.withColumn("shard", F.when(passes, F.col("wish")).otherwise(F.col("shard"))).drop("wish"))
        if sum(w * p for w, p in zip(wanted, share)) * STILL < total:
            break
    return linked


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs; shard sizes differ by one row at most.

    Links join documents of equal text. Documents start in a shard by hash, linked ones propagate, then the surplus of each
    shard goes to those that lack rows, unlinked documents first and then whole small groups. A group larger than three quarters of a shard is cut. Slots number a
    shard's rows from 0 without gaps. Null texts are empty; rows with equal or null doc_id are documents of their own.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = written(docs.select(
        "doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw, F.crc32(raw), F.length(raw)).alias("group"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")))
    total = base.count()
    capacity = total // shards
    # Written, so that the join is of two plain tables and Spark can split a hot group's rows.
    groups = written(base.groupBy("group").agg(F.count("*").alias("group_size")).where("group_size > 1"))
    # A group that no shard can hold is cut beforehand into as few parts as fit, by a hash of the row.
    cuts = F.ceil(F.col("group_size") / F.lit(max(1, capacity * 3 // 4)))
    part = F.when(cuts > 1, F.xxhash64("group", F.pmod(F.xxhash64("row", F.lit("part")), cuts))).otherwise(F.col("group"))
    sized = written(base.join(groups, "group", "left").withColumn("group", part))
    alone = sized.where("group_size IS NULL")
    linked = propagate(sized.where("group_size IS NOT NULL"), capacity, shards)
    # First to leave a full shard are unlinked rows, then whole small groups, as their rows are numbered together.
    order = F.when(F.col("group_size").isNull(), 0).when(F.col("group_size") <= SMALL_GROUP, 1).otherwise(2)
    together = F.when(order == 1, F.col("group")).otherwise(F.xxhash64("row"))
    buckets = max(8, total // (shards * ROWS_PER_BUCKET))
    rows = written(alone.unionByName(linked).withColumn("part", order * buckets + F.pmod(F.xxhash64(together), F.lit(buckets)).cast("int")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    parts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", before).select("shard", "part", "before")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("group", "row")) - 1
    numbered = rows.withColumn("place", place).join(parts, ["shard", "part"]).withColumn("place", F.col("place") + F.col("before"))
    now = shard_counts(rows, shards)
    largest = sorted(range(shards), key=lambda s: -now[s])[:total % shards]
    target = [capacity + (s in largest) for s in range(shards)]
    surplus = [max(0, n - t) for n, t in zip(now, target)]
    lack = [max(0, t - n) for n, t in zip(now, target)]
    given, taken = ([sum(x[:s]) for s in range(shards)] for x in (surplus, lack))
    leaves = F.col("place") < by_shard(surplus, F.col("shard"))
    ticket = F.col("place") + by_shard(given, F.col("shard"))
    receiver = F.coalesce(*(F.when((ticket >= taken[s]) & (ticket < taken[s] + lack[s]), s) for s in range(shards)))
    moved = numbered.withColumn("to", F.when(leaves, receiver))
    slot = (F.when(F.col("to").isNull(), F.col("place") - by_shard(surplus, F.col("shard")))
            .otherwise(by_shard(now, F.col("to")) + ticket - by_shard(taken, F.col("to"))))
    return moved.select("doc_id", "size", "text_crc32", F.coalesce("to", "shard").alias("shard"), slot.cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
