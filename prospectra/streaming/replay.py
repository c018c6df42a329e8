"""Runs a stream over stored files to its end and reads back what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder of the cluster; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='prospectra-')}/{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A stream reads a folder or a pattern; the bracket makes the one name a pattern that matches nothing else.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def replay(stream: DataFrame) -> DataFrame:
    """Appends a stream's output to files until its input ends, and returns the files."""
    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replay_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key of an aggregating stream once its input has ended. Each micro-batch writes the keys that it
    changed, under its number; a repeated batch replaces its own files."""
    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    states = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    values = [c for c in stream.columns if c not in keys]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *(F.col("last")[v].alias(v) for v in values))
