"""Folders that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"prospectra-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without that setting gets a temporary one, the same for its whole life."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for results that several parts of a query use: worked out once, read by each."""
    path = f"{shared_folder(df.sparkSession)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's files (path, length, time of change), from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*files.columns)))), 256)).first()[0]
