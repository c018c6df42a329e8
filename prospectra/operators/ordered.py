"""Ordered numbering and running totals inside groups of any size.

A plain window over a group sends the whole group to one task. These helpers split
each group into order-preserving buckets, work inside the buckets, and add what the
earlier buckets of the group contribute. Only one row per (group, bucket) is ever
ordered across buckets, so a group that holds a third of all rows still spreads out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 65536


def id_bucket(unique_integer: Column, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a unique integer: at most `rows` different values share one."""
    return F.floor(unique_integer / rows)


def running_before(df: DataFrame, keys: Sequence[str], buckets: Sequence[Column], order: Sequence[Column],
                   value: Column, out: str) -> DataFrame:
    """Adds the total of `value` over the rows of the same group that come before this one.

    `buckets` must be non-null and must sort the same way as `order` (each bucket's rows
    come entirely before the next bucket's rows).
    """
    names = [f"__b{i}" for i in range(len(buckets))]
    df = df.withColumns({**dict(zip(names, buckets)), "__v": value})
    group = list(keys)
    totals = df.groupBy(*group, *names).agg(F.sum("__v").alias("__t"))
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, *names, F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return (local.join(totals, [*group, *names])
            .withColumn(out, F.col("__local") + F.col("__before"))
            .drop("__v", "__local", "__before", *names))


def position(df: DataFrame, keys: Sequence[str], buckets: Sequence[Column], order: Sequence[Column],
             out: str) -> DataFrame:
    """Adds the 1-based position of each row in its group."""
    df = running_before(df, keys, buckets, order, F.lit(1).cast("long"), out)
    return df.withColumn(out, F.col(out) + 1)


def last_before(df: DataFrame, keys: Sequence[str], bucket: Column, order: Column, value: Column,
                out: str) -> DataFrame:
    """Adds the latest non-null `value` strictly before each row of its group."""
    group = list(keys)
    df = df.withColumns({"__b": bucket, "__o": order, "__v": value})
    inside = Window.partitionBy(*group, "__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    carried = (df.where(F.col("__v").isNotNull()).groupBy(*group, "__b")
               .agg(F.max_by("__v", "__o").alias("__last")))
    present = df.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    across = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (present.join(carried, [*group, "__b"], "left")
               .select(*group, "__b", F.last("__last", ignorenulls=True).over(across).alias("__carry")))
    return (df.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
            .join(carried, [*group, "__b"])
            .withColumn(out, F.coalesce("__in", "__carry"))
            .drop("__b", "__o", "__v", "__in", "__carry"))


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join in which every key of `big` is spread over `salts` tasks.

    `small` has few rows per key and is repeated once per salt, so a key that holds a
    large share of `big` is not joined by a single task.
    """
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
