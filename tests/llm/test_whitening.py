"""Whitening: exact polynomials and roots against plain arithmetic, components against brute force, edge cases."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from prospectra.llm import common, whitening

VECTORS = "vec_id long, embedding array<float>, component string, n int, label int"


def plain_characteristic(matrix):
    """Faddeev and LeVerrier, in fractions."""
    d = len(matrix)
    a = np.array([[Fraction(int(v)) for v in row] for row in matrix], object)
    c, m = [Fraction(1)], np.array([[Fraction(0)] * d for _ in range(d)], object)
    for k in range(1, d + 1):
        m = a @ m + c[-1] * np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
        c.append(-np.trace(a @ m) / k)
    return [int(v) for v in reversed(c)]


def gram(seed, d, rows, size):
    rng = random.Random(seed)
    x = np.array([[rng.randrange(-size, size + 1) for _ in range(d)] for _ in range(rows)], object)
    return x.T @ x


@pytest.mark.parametrize("matrix", [
    gram(1, 1, 3, 9), gram(2, 2, 5, 10**9), gram(3, 7, 20, 50), gram(4, 9, 4, 10**12), np.zeros((5, 5), object),
    np.array([[2, 0, 0], [0, 2, 0], [0, 0, 5]], object), np.array([[1, 0, 1], [0, 3, 0], [1, 0, 1]], object),
], ids=["1x1", "large", "plain", "rank 4 of 9", "zero", "double root", "zero pivots"])
def test_polynomial_by_brute_force(spark, matrix):
    assert whitening.characteristic(spark, matrix) == plain_characteristic(matrix)


def from_roots(roots):
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    return c


def test_roots_are_isolated_and_counted():
    c = from_roots([0, 0, 3, 7, 7, 7, 10**12, 10**12 + 1])
    assert [whitening.roots_above(c, a) for a in (0, 2, 3, 6, 7, 10**12, 10**12 + 1)] == [6, 6, 5, 5, 2, 1, 0]
    found = [(Fraction(r, 2**whitening.ROOT_BITS), m) for r, m in whitening.largest_roots(c, 8)]
    assert found == [(10**12 + 1, 1), (10**12, 1), (7, 3), (3, 1)]
    assert [m for _, m in whitening.largest_roots(c, 3)] == [1, 1, 3]
    close = from_roots([Fraction(1, 3) * 3**40, Fraction(1, 3) * 3**40 + 1])                # whole again
    assert len(whitening.largest_roots([int(v) for v in close], 2)) == 2
    (root, _), (small, _) = whitening.largest_roots([1, -3, 1], 2)                          # x^2 - 3x + 1
    assert abs(root / 2**whitening.ROOT_BITS - (3 + math.sqrt(5)) / 2) < 1e-15 and abs(small / 2**whitening.ROOT_BITS - (3 - math.sqrt(5)) / 2) < 1e-15


def test_vectors_of_close_and_equal_eigenvalues(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.integers(-9, 9, (6, 6)).astype(float))
    base = gram(6, 6, 12, 100)
    twice = np.block([[base, np.zeros((6, 6), object)], [np.zeros((6, 6), object), base]])   # every eigenvalue twice
    found = whitening.components(spark, twice, 7)
    axes = np.stack([v for _, v in found])
    assert np.abs(axes @ axes.T - np.eye(7)).max() < 1e-14
    for e, v in found:
        assert np.abs(twice.astype(float) @ v - e * v).max() < 1e-11 * found[0][0]
    near = np.array([[10**15, 1], [1, 10**15]], object)                                     # a relative gap of 2e-15
    (a, u), (b, v) = whitening.components(spark, near, 2)
    assert a - b == 2 and np.allclose(np.abs(u), math.sqrt(0.5), atol=1e-15) and abs(u @ v) < 1e-15


def brute(rows, wanted=16):
    x = np.array([[math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in r] for r in rows], object)
    distinct = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(distinct), distinct.sum(axis=0)
    dev = n * x - s
    centred = (n * distinct - s).astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    keep = [k for k in range(len(e))[::-1] if e[k] > 1e-9 * e.max()][:wanted]
    return n, [int(sum(v * v for v in r)) for r in dev], (dev.astype(float) / n) @ axes[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


def test_whiten_by_brute_force(spark):
    rng = random.Random(7)
    rows = [[rng.gauss(0, 1 + k) for k in range(20)] for _ in range(300)]
    rows += rows[:40] + [rows[0]] * 200                                                     # copies count once
    bad = [(900, None), (901, [None] + [0.5] * 19), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, []), (905, [0.5] * 3), (None, rows[1])]
    table = [(i, r, "x", 0, None) for i, r in enumerate(rows)] + [(i, r, "x", 0, 1) for i, r in bad]
    got = whitening.whiten(spark.createDataFrame(table, VECTORS), "embedding", ["vec_id"]).collect()
    n, deviation, z, explained = brute(rows)
    by_key = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by_key) == (len(rows) + 1) * 16 and {r["n"] for r in got} == {n}
    assert {r["vec_id"] for r in got} == {*range(len(rows)), None}
    mine = np.array([[by_key[i, k + 1]["whitened"] for k in range(16)] for i in range(len(rows))])
    z *= np.sign((mine * z).sum(axis=0))
    assert np.abs(mine - z).max() < 1e-9
    assert [by_key[i, 1]["deviation"] for i in range(len(rows))] == deviation
    assert np.allclose([by_key[0, k + 1]["explained"] for k in range(16)], explained, rtol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12
    assert [by_key[None, k]["whitened"] for k in (1, 16)] == [by_key[1, k]["whitened"] for k in (1, 16)]


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], "", 0, 0) for i in range(5)]                      # one direction varies
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), "embedding", ["vec_id"]).collect()
    assert sorted(r["component"] for r in got) == [1] * 5 and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    for table in ([], [(1, None, "", 0, 0)], [(1, [], "", 0, 0)], [(1, [1.0, 2.0], "", 0, 0), (2, [1.0, 2.0], "", 0, 0)]):
        found = whitening.whiten(spark.createDataFrame(table, VECTORS), "embedding", ["vec_id"])
        assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_far_entries_are_exact(spark):
    rows = [(1, [3e38, 1.0], "", 0, 0), (2, [-3e38, 2.0], "", 0, 0), (3, [1e12, 3.0], "", 0, 0), (4, [0.0, -5.0], "", 0, 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), "embedding", ["vec_id"]).collect()
    assert len(got) == 8 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None} and got[0]["identity_error"] < 1e-6


def test_shared_folder_without_the_setting(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "local[2]", "app-1"
            getConf = staticmethod(dict)

    assert common.shared_dir(Session) == common.shared_dir(Session)
    monkeypatch.setattr(Session.sparkContext, "master", "spark://far:7077")
    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_samples_exist_at_any_size(spark):
    ids = spark.range(200_000).toDF("doc_id")
    assert ids.where(common.sampled("doc_id", 1.0)).count() == 200_000 and ids.where(common.sampled("doc_id", 0.0)).count() == 0
    assert 900 < ids.where(common.sampled("doc_id", 0.005)).count() < 1100
    share = 8_000 / 10**11                                              # of a table of 10^11 rows
    assert round(share * 10**15) == 80_000_000 and common.sampled("doc_id", share) is not None
    assert 0 < spark.range(30_000_000).toDF("doc_id").where(common.sampled("doc_id", 2e-7)).count() < 20
