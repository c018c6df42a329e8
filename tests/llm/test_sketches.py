"""Fingerprints: peeling against plain set differences, retries, the edited texts, edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from prospectra.llm import sketches
from tests.llm.fixtures import EDGES, docs, prose

VERSIONS = "id int, old array<long>, new array<long>, kept struct<x: string>"


def longs(rng, n):
    return [rng.randrange(-2**63, 2**63) for _ in range(n)]


def peel(spark, rows, **kw):
    table = spark.createDataFrame([(i, o, n, (str(i),)) for i, (o, n) in enumerate(rows)], VERSIONS)
    return {r["id"]: r for r in sketches.differences(table, ["id"], "old", "new", "kept", **kw).collect()}


def test_peeling_recovers_what_differs(spark):
    rng = random.Random(1)
    rows = [([], []), ([5], []), ([], [5]), ([0], [-1]), ([7], [7])]
    for n in (3, 20, 300, 5_000):
        both = longs(rng, n)
        rows += [(both, both), (both + longs(rng, n // 3), both), (both, longs(rng, n)), (both + longs(rng, 2), longs(rng, 1) + both)]
    done = 0
    for i, r in peel(spark, rows).items():
        old, new = map(set, rows[i])
        assert r["kept"]["x"] == str(i) and (r["n_old"], r["n_new"]) == (len(old), len(new))
        assert set(r["removed"]) <= old - new and set(r["added"]) <= new - old
        if not r["stalled"]:
            done += 1
            assert sorted(r["removed"]) == sorted(old - new) and sorted(r["added"]) == sorted(new - old)
    assert len(rows) - done <= 2


def test_a_larger_table_follows_a_stalled_one(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(longs(rng, 30), longs(rng, 30)) for _ in range(20)]
    monkeypatch.setattr(sketches, "LEAST", 2)
    monkeypatch.setattr(sketches, "SPARE", 0.2)
    first, last = peel(spark, rows), peel(spark, rows, attempt=4)
    assert all(r["stalled"] for r in first.values()) and not any(r["stalled"] for r in last.values())
    assert all(sorted(r["removed"]) == sorted(rows[i][0]) for i, r in last.items())


def paragraphs(text):
    return set(re.findall(r"(?:[^ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r.!?;:][ \t\x0b\f\r]+){0,15}[^ \t\n\x0b\f\r]+", text, re.A))


def brute(rows):
    order = sorted({r[0] for r in rows}, key=lambda d: (d is not None, d or 0), reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    out = []
    for doc_id, text in rows:
        text = text or ""
        others = {(t or "") for d, t in rows if d == following[doc_id]}
        near = {}
        for other in others:
            half = len(text) // 2
            edited = text[:len(text) - half] + other[:half]
            like = lambda a, b: round(len(a & b) / len(a | b), 9) if a | b else 1.0        # noqa: E731
            near[hashlib.sha256(edited.encode()).hexdigest()] = (like(paragraphs(text), paragraphs(edited)), like(paragraphs(text), paragraphs(other)))
        out.append((doc_id, len(text), near))
    return out


def check(spark, rows):
    got = sketches.fingerprints(docs(spark, rows)).collect()
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])       # noqa: E731
    assert len(got) == len(want)
    for r, (doc_id, n_chars, near) in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_chars))), sorted(want, key=key)):
        assert (r.doc_id, r.n_chars) == (doc_id, n_chars) and r.edited_sha256 in near
        assert (round(r.near_edited, 9), round(r.near_next, 9)) == near[r.edited_sha256]
    return got


def test_fingerprints_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sketches, "ID_ROWS", 7)         # several ranges of ids
    rng = random.Random(3)
    rows = [(100 + 3 * i, "\n".join(prose(50 + i % 17, rng.choice([3, 30, 200]), 300) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    rows += [(-5, rows[0][1]), (2**60, rows[0][1] + "\nOne line more."), (2**60 - 1, "a: b; c! d? e. f")]
    got = check(spark, rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for own in by_text.values() for f in own}) == len(by_text)


def test_edges_and_retries(spark, monkeypatch):
    monkeypatch.setattr(sketches, "SPARE", 0.3)
    monkeypatch.setattr(sketches, "LEAST", 2)
    texts = [*EDGES, (20, "a b. " * 3 + "z"), (21, "\n\n"), (22, "x.\n" * 500)]
    got = check(spark, texts)
    assert max(r.tries for r in got) > 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "alone here. Twice here.")], [(4, "same"), (4, "same")]])
def test_small_tables(spark, rows):
    got = sketches.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.near_next == 1.0 for r in got)


def test_no_python_on_the_main_path(spark):
    plan = sketches.edited_pairs(docs(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    rows = spark.createDataFrame([(1, [1], [2], ("x",))], VERSIONS)
    plan += sketches.differences(rows, ["id"], "old", "new", "kept").select(F.size("added"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
