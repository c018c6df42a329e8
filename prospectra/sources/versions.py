"""Versions of a folder of immutable tables.

A version lists the parts that make up the folder's tables. Its list is one small file under `manifest/version=<n>`, which appears whole by
the commit of the job that writes it. Parts are never changed, so a reader that has read a list goes on with it whatever
is committed meanwhile. A writer prepares its parts first, then commits the next list; of two writers that commit the same number,
the one with the smaller token stays and the other is told to start over.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "token string, place int, name string, kind string, path string, bucket int, rows long, words long"


class Part(NamedTuple):
    """An immutable folder of Parquet files; what name, kind, bucket and the counts mean is its owner's matter."""

    name: str
    kind: str
    path: str
    bucket: int = 0
    rows: int = 0
    words: int = 0


class CommitConflict(RuntimeError):
    """Another writer has committed this version first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._lists = f"{self.root}/manifest"
        try:
            self._read()
        except AnalysisException:       # a new folder: an empty list makes it readable
            self.spark.createDataFrame([], LIST).write.mode("append").parquet(f"{self._lists}/version=0")

    def _read(self) -> DataFrame:
        return self.spark.read.schema(f"{LIST}, version int").option("basePath", self._lists).parquet(self._lists)

    def current(self) -> tuple[int, list[Part]]:
        """The latest version and its parts in order; 0 and none at first."""
        newest = self._read().agg(F.max("version")).first()[0] or 0
        return newest, self.parts(newest) if newest else []

    def parts(self, version: int) -> list[Part]:
        """The parts of a version, also of an earlier one."""
        rows = self._read().where(F.col("version") == version).collect()
        winner = min(r["token"] for r in rows)
        return [Part(*(r[f] for f in Part._fields)) for r in sorted(rows, key=lambda r: r["place"]) if r["token"] == winner and r["place"] >= 0]

    def commit(self, after: int, parts: list[Part]) -> int:
        """Makes `parts` the version that follows `after`."""
        token, version = uuid.uuid4().hex, after + 1
        rows = [(token, -1, "", "", "", 0, 0, 0)] + [(token, i, *p) for i, p in enumerate(parts)]
        if self.current()[0] != after:
            raise CommitConflict(f"version {version} exists")
        self.spark.createDataFrame(rows, LIST).coalesce(1).write.mode("append").parquet(f"{self._lists}/version={version}")
        if self._read().where(F.col("version") == version).agg(F.min("token")).first()[0] != token:
            raise CommitConflict(f"version {version} was committed by another writer")
        return version

    def new_path(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"
