"""Streaming ingest: new documents are chunked and replace their earlier chunks.

Each micro-batch adds one part, its documents and their chunks, to a versioned sink under its number; a repeated batch adds nothing. Readers
take the newest part that names a document. Parts are merged as they come, small ones into larger ones, superseded chunks dropping
out, so a reader meets a bounded number of parts however many batches have come, and a chunk is rewritten about once per doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prospectra.functions import fixed_values as V
from prospectra.operators.chunking import chunk_pages
from prospectra.sources.tables import DOCUMENT_KEY
from prospectra.sources.versions import Part, Versions

PARTS = 6           # parts of a sink from which on the last ones are merged


def ingest_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of a batch of documents; a document sent twice in one batch counts once, the later arrival."""
    newest = documents.groupBy("domain", "filename").agg(F.max_by("text", "arrival").alias("text"))
    return chunk_pages(newest.select("domain", "filename", F.array("text").alias("pages")), *V.GENERAL_CHUNKS)


class IngestSink:
    """The chunks of all documents that have come, by batch."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Chunks a batch of documents and adds them, unless this batch has been added."""
        version, parts = self.versions.current()
        if any(p.bucket >= batch_id for p in parts):
            return
        part = self._write(batch.select(*DOCUMENT_KEY).distinct(), ingest_chunks(batch), batch_id)
        version = self.versions.commit(version, [*parts, part])
        if len(parts) + 1 > PARTS:
            self._merge(version, [*parts, part])

    def _merge(self, version: int, parts: list[Part]) -> None:
        """Makes one part of the last ones: those that are at most twice as large as all that follow them, and two at least."""
        first, rows = len(parts) - 2, parts[-2].rows + parts[-1].rows
        while first and parts[first - 1].rows <= 2 * rows:
            first -= 1
            rows += parts[first].rows
        last = parts[first:]
        documents = reduce(DataFrame.unionByName, (self._read(p, "documents") for p in last)).distinct()
        self.versions.commit(version, [*parts[:first], self._write(documents, self._newest(last), parts[-1].bucket)])

    def _write(self, documents: DataFrame, chunks: DataFrame, batch_id: int) -> Part:
        path = self.versions.new_path("chunks")
        documents.write.parquet(f"{path}/documents")
        chunks.write.parquet(f"{path}/chunks")
        return Part("chunks", "batch", path, batch_id, self.spark.read.parquet(f"{path}/chunks").count())

    def _read(self, part: Part, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{part.path}/{table}")

    def _newest(self, parts: list[Part]) -> DataFrame:
        """The chunks of each document from the last of some parts that names it."""
        with_place = lambda table: reduce(DataFrame.unionByName, (self._read(p, table).withColumn("place", F.lit(i)) for i, p in enumerate(parts)))      # noqa: E731
        newest = with_place("documents").groupBy(*DOCUMENT_KEY).agg(F.max("place").alias("place"))
        return with_place("chunks").join(newest, [*DOCUMENT_KEY, "place"], "left_semi").drop("place")

    def current(self) -> DataFrame:
        """The chunks of the newest version of every document."""
        parts = self.versions.current()[1]
        if not parts:
            raise ValueError("no batch has come yet")
        return self._newest(parts)


def stream_ingest(arriving: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Chunks a stream of documents (domain, filename, text, arrival) into `sink` until no input is left."""
    kept = IngestSink(arriving.sparkSession, sink)
    return (arriving.writeStream.foreachBatch(kept.add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_chunks(spark: SparkSession, sink: str) -> DataFrame:
    """The chunks of the newest version of every document of a sink."""
    return IngestSink(spark, sink).current()
