"""A store of documents and everything derived from them, with versions.

All tables carry the key of their document and are cut into buckets by it. Replacing or deleting documents writes anew only their buckets, of
every table, and then commits one list of parts: a reader sees all tables before the change or all after it, never a mixture.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.sources.tables import DOCUMENT_KEY
from prospectra.sources.versions import CommitConflict, Part, Versions

TRIES = 5           # of a change that other writers come before
BUCKET_TASKS = 4    # tasks that write a bucket, by its documents


class Snapshot:
    """The tables at one version."""

    def __init__(self, store: Store, version: int, parts: list[Part]) -> None:
        self.version, self.parts, self._store = version, parts, store

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table's rows; of some buckets only, if given."""
        schema = self._store.tables[table]
        paths = [p.path for p in self.parts if p.name == table and (buckets is None or p.bucket in buckets)]
        spark = self._store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class Store:
    """`tables`: name to schema, each with the columns of `key`. The number of buckets is fixed for the store's life."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str], buckets: int = 64, key: Sequence[str] = tuple(DOCUMENT_KEY)) -> None:
        self.spark, self.tables, self.buckets, self.key = spark, dict(tables), buckets, list(key)
        self.versions = Versions(spark, root)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self.versions.current())

    def replace(self, rows: Mapping[str, DataFrame]) -> int:
        """Puts the given rows in place of everything that any table holds of their documents; the new version."""
        keys = None
        for df in rows.values():
            own = df.select(*self.key)
            keys = own if keys is None else keys.unionByName(own)
        return self._change(keys.distinct(), rows)

    def delete(self, documents: DataFrame) -> int:
        """Removes the documents from every table; the new version."""
        return self._change(documents.select(*self.key).distinct(), {})

    def removed(self, documents: DataFrame, before: Snapshot) -> DataFrame:
        """(key, table, removed): how many rows of each table a deletion takes, 0 for a document that is not there."""
        keys = self._kept(documents.select(*self.key).distinct())
        touched = self._touched(keys)
        counts = None
        for name in self.tables:
            held = before.read(name, touched).groupBy(*self.key).agg(F.count("*").alias("removed"))
            own = keys.join(held, self.key, "left").select(*self.key, F.lit(name).alias("table"), F.coalesce("removed", F.lit(0).cast("long")).alias("removed"))
            counts = own if counts is None else counts.unionByName(own)
        return counts

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _kept(self, rows: DataFrame) -> DataFrame:
        path = self.versions.new_path("keys")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some documents, at most as many as the store has."""
        return [r[0] for r in keys.select(self._bucket()).distinct().collect()]

    def _change(self, keys: DataFrame, rows: Mapping[str, DataFrame]) -> int:
        keys = self._kept(keys)
        touched = self._touched(keys)
        for _ in range(TRIES):
            old = self.snapshot()
            parts = [p for p in old.parts if p.bucket not in touched]
            for name in self.tables:
                stays = old.read(name, touched).join(keys, self.key, "left_anti")
                columns = stays.columns
                parts += self._write(name, stays.unionByName(rows[name].select(*columns)) if name in rows else stays)
            try:
                return self.versions.commit(old.version, parts)
            except CommitConflict:
                continue
        raise CommitConflict("other writers always came first")

    def _write(self, name: str, rows: DataFrame) -> list[Part]:
        path = self.versions.new_path(name)
        dealt = rows.withColumn("bucket", self._bucket())
        dealt.repartition("bucket", F.pmod(F.hash(*self.key), F.lit(BUCKET_TASKS))).write.partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(dealt.schema).parquet(path)
        return [Part(name, "bucket", f"{path}/bucket={r['bucket']}", r["bucket"], r["count"]) for r in written.groupBy("bucket").count().collect()]
