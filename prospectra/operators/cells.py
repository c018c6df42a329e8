"""Exact nearest neighbours by cells.

Every item belongs to the nearest of a bounded number of pivots and keeps its distance to it. A question first looks into the nearest cells
that hold k items, which bounds its k-th distance; by the triangle inequality, and by the plane between two pivots, most other
cells may then be known to hold nothing nearer, and only the rest are looked into. An item's vector is read once a round, with the questions
that look into its cell.

Inner products are distances too: with every item lengthened by one coordinate to the same norm, the order of falling inner products is that of
rising distances.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospectra.sources.folders import shared_folder

PIVOTS = 256                # cells; the pivots are that many items, drawn by a hash of the id
CELL_ROWS = 8192            # items that a call compares at once; larger cells are split and their questions copied
QUESTION_ROWS = 1024        # questions that are compared at once
SLACK = 1e-6                # distances are rounded to 9 digits: bounds closer than this exclude nothing

ITEMS = "grp long, cell int, item_id long, r double, e array<float>"
ASKED = "query_id long, grp long, e array<float>, norm double, near array<double>, plane array<double>"


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0))


def lengthened(v: np.ndarray, square: float) -> np.ndarray:
    """Items with one more coordinate, so that all have the same squared norm; unchanged where square is not given."""
    return v if square < 0 else np.hstack([v, np.sqrt(np.maximum(square - (v * v).sum(1), 0.0))[:, None]])


def best(ids: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest values of each row, of equal values those of the smallest ids."""
    if value.shape[1] > k:
        row, col = np.nonzero(value <= np.partition(value, k - 1, axis=1)[:, k - 1:k])
    else:
        row, col = (i.ravel() for i in np.indices(value.shape))
    order = np.lexsort((ids[col], value[row, col], row))
    row, col = row[order], col[order]
    starts = np.searchsorted(row, row)
    keep = np.arange(len(row)) - starts < k
    return row[keep], col[keep]


class Cells:
    """Items (item_id, grp, e) in cells, as a written table."""

    def __init__(self, items: DataFrame, metric: str) -> None:
        spark = items.sparkSession
        self.spark, self.metric, self.folder = spark, metric, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
        norms = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        self.square = -1.0 if metric == "l2" else (items.agg(F.max(norms)).first()[0] or 0.0)
        drawn = items.orderBy(F.xxhash64("item_id"), "item_id").limit(PIVOTS).select("e").collect()
        self.pivots = pivots = lengthened(np.array([r["e"] for r in drawn], np.float64), self.square) if drawn else np.zeros((0, 0))
        square = self.square

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = distances(lengthened(matrix(batch["e"]), square), pivots)
                    cell = d.argmin(1)
                    yield pd.DataFrame({"grp": batch["grp"], "cell": cell, "item_id": batch["item_id"], "r": d[np.arange(len(d)), cell], "e": batch["e"]})

        self.items = self._kept(items.select("item_id", "grp", "e").mapInPandas(assign, ITEMS), "items")
        self.sizes = self._kept(self.items.groupBy("grp", "cell").agg(F.count("*").alias("held"), F.min("r").alias("inner"), F.max("r").alias("outer")), "sizes")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def nearest(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, item_id, value): the k best items of each question (query_id, grp, e; one row for each group it may look into). value is the
        squared distance, or the negative inner product, rounded to 9 digits; equal values go by item_id."""
        if not len(self.pivots):
            return self.spark.createDataFrame([], "query_id long, item_id long, value double")
        asked = self._asked(questions)
        ways = self._ways(asked)
        first = self._first(ways, k)
        found = self._kept(self._look(asked, first, k), "first")
        rank = Window.partitionBy("query_id").orderBy("value", "item_id")
        kth = (found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == k)
               .join(asked.select("query_id", "norm").distinct(), "query_id").select("query_id", self._reach().alias("reach")))
        rest = (ways.join(kth, "query_id", "left").where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach") + SLACK))
                .join(first, ["query_id", "grp", "cell"], "left_anti").select("query_id", "grp", "cell"))
        return found.unionByName(self._look(asked, rest, k))

    def work(self, questions: DataFrame, k: int) -> float:
        """The share of all distances between questions and items of their groups that a search computes."""
        asked = self._asked(questions)
        ways = self._ways(asked)
        first = self._first(ways, k)
        rank = Window.partitionBy("query_id").orderBy("value", "item_id")
        kth = (self._look(asked, first, k).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == k)
               .join(asked.select("query_id", "norm").distinct(), "query_id").select("query_id", self._reach().alias("reach")))
        seen = ways.join(kth, "query_id", "left").join(first.withColumn("own", F.lit(True)), ["query_id", "grp", "cell"], "left")
        looked = F.col("own").isNotNull() | F.col("reach").isNull() | (F.col("bound") <= F.col("reach") + SLACK)
        done, every = seen.agg(F.sum(F.when(looked, F.col("held")).otherwise(0)), F.sum("held")).first()
        return done / every if every else 0.0

    def _asked(self, questions: DataFrame) -> DataFrame:
        """Questions with their distances to all pivots, and for each cell how far behind the plane to the nearest pivot's cell it begins."""
        pivots, ip = self.pivots, self.metric == "ip"
        between = np.maximum(distances(pivots, pivots), 1e-300)

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    q = matrix(batch["e"])
                    long = np.hstack([q, np.zeros((len(q), 1))]) if ip else q
                    d = distances(long, pivots)
                    own = d.argmin(1)
                    # The root of rounding errors: equal vectors may come out some 1e-8 apart.
                    plane = (d * d - (d.min(1) ** 2)[:, None]) / (2 * between[own])
                    plane[np.arange(len(d)), own] = 0.0
                    plane[between[own] < SLACK] = 0.0
                    yield pd.DataFrame({"query_id": batch["query_id"], "grp": batch["grp"], "e": batch["e"], "norm": (q * q).sum(1), "near": list(d), "plane": list(plane)})

        return self._kept(questions.select("query_id", "grp", "e").mapInPandas(measure, ASKED), "asked")

    def _ways(self, asked: DataFrame) -> DataFrame:
        """(query_id, grp, cell, held, d, bound) of every cell that a question may look into; no item of it is nearer than bound."""
        d = F.get("near", F.col("cell"))
        return asked.join(self.sizes, "grp").select("query_id", "grp", "cell", "held", d.alias("d"), F.greatest(
            F.lit(0.0), d - F.col("outer"), F.col("inner") - d, F.get("plane", F.col("cell"))).alias("bound"))

    def _first(self, ways: DataFrame, k: int) -> DataFrame:
        before = Window.partitionBy("query_id").orderBy("d", "grp", "cell").rowsBetween(Window.unboundedPreceding, -1)
        return ways.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).where(F.col("before") < k).select("query_id", "grp", "cell")

    def _reach(self):
        """The distance that belongs to a value."""
        square = F.col("value") if self.metric == "l2" else F.col("norm") + self.square + 2 * F.col("value")
        return F.sqrt(F.greatest(square, F.lit(0.0)) + 1e-9)

    def _look(self, asked: DataFrame, ways: DataFrame, k: int) -> DataFrame:
        """The k best items of each question among those of the given cells, per part of a cell."""
        metric = self.metric

        def compare(questions: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(questions) and len(items):
                ids, c = items["item_id"].to_numpy(), matrix(items["e"])
                for at in range(0, len(questions), QUESTION_ROWS):
                    part = questions.iloc[at:at + QUESTION_ROWS]
                    q = matrix(part["e"])
                    value = q @ c.T
                    value = np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * value, 0.0) if metric == "l2" else -value
                    value = np.round(value, 9) + 0.0
                    row, col = best(ids, value, k)
                    out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "item_id": ids[col], "value": value[row, col]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "item_id": [], "value": []})

        parts = F.ceil(F.col("held") / CELL_ROWS)
        sizes = self.sizes.select("grp", "cell", parts.alias("parts"))
        items = self.items.join(sizes, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("item_id"), "parts"))
        wanted = (ways.join(asked.select("query_id", "grp", "e"), ["query_id", "grp"]).join(sizes, ["grp", "cell"])
                  .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
        key = ["grp", "cell", "part"]
        visited = items.join(wanted.select(*key).distinct(), key, "left_semi")
        return (wanted.select(*key, "query_id", "e").groupBy(*key)
                .cogroup(visited.select(*key, "item_id", "e").groupBy(*key)).applyInPandas(compare, "query_id long, item_id long, value double"))
