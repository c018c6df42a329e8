"""Nearest neighbours by cells against brute force, and the work they save."""

from __future__ import annotations

import numpy as np
import pytest

from prospectra.operators import cells
from prospectra.operators.cells import Cells

SCHEMA = "{} long, grp long, e array<float>"


def clustered(seed, n, width=8, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 10
    return (middle[rng.integers(centres, size=n)] + rng.normal(size=(n, width))).astype(np.float32)


def brute(q, q_groups, c, c_groups, k, metric):
    out = set()
    for i, v in enumerate(q.astype(np.float64)):
        x = c.astype(np.float64)
        value = ((x - v) ** 2).sum(1) if metric == "l2" else -(x @ v)
        rows = sorted((round(float(value[j]), 5), j) for j in range(len(c)) if c_groups[j] in q_groups[i])
        out |= {(i, j, v) for v, j in rows[:k]}
    return out


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("pivots, cell_rows", [(256, 8192), (5, 30)], ids=["as shipped", "few cells in parts"])
def test_nearest_by_brute_force(spark, monkeypatch, metric, pivots, cell_rows):
    monkeypatch.setattr(cells, "PIVOTS", pivots)
    monkeypatch.setattr(cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(cells, "QUESTION_ROWS", 7)
    c, q = clustered(1, 600), np.vstack([clustered(1, 25), np.zeros((1, 8), np.float32), clustered(2, 6)])
    c[100:140] = c[99]                                          # equal vectors: ties go by id
    c_groups, q_groups = [j % 3 for j in range(600)], [{0, 1, 2} if i % 2 else {i % 3} for i in range(len(q))]
    items = spark.createDataFrame([(j, c_groups[j], v.tolist()) for j, v in enumerate(c)], SCHEMA.format("item_id")).repartition(3)
    asked = spark.createDataFrame([(i, g, v.tolist()) for i, v in enumerate(q) for g in q_groups[i]], SCHEMA.format("query_id"))
    found = {}
    for r in Cells(items, metric).nearest(asked, 9).collect():
        found.setdefault(r["query_id"], set()).add((r["value"], r["item_id"]))
    got = {(i, j, round(v, 5)) for i, own in found.items() for v, j in sorted(own)[:9]}
    want = brute(q, q_groups, c, c_groups, 9, metric)
    assert {g[:2] for g in got} == {w[:2] for w in want}
    assert max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want))) < 2e-4


def test_few_distances_of_clustered_items(spark):
    c = clustered(3, 2000, centres=60)
    items = spark.createDataFrame([(j, 0, v.tolist()) for j, v in enumerate(c)], SCHEMA.format("item_id"))
    asked = spark.createDataFrame([(j, 0, v.tolist()) for j, v in enumerate(c[:40])], SCHEMA.format("query_id"))
    assert Cells(items, "l2").work(asked, 5) < 0.2


def test_fewer_items_than_asked(spark):
    items = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0])], SCHEMA.format("item_id"))
    asked = spark.createDataFrame([(7, 0, [1.0, 1.0]), (8, 5, [1.0, 1.0])], SCHEMA.format("query_id"))
    assert [tuple(r)[:2] for r in Cells(items, "l2").nearest(asked, 3).collect()] == [(7, 1)]
    assert Cells(items.limit(0), "ip").nearest(asked, 3).count() == 0
