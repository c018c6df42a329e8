"""Lexical search: bounds never fall below scores, results against brute force, edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from prospectra.llm import lexical
from tests.llm.fixtures import EDGES, docs, prose


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, items):
    counts = [(r[0], Counter(terms(r[1]))) for r in rows]
    held = [c for _, c in counts if c]
    n, total = len(held), sum(c.total() for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counts:
            m = 25 + (75 * c.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:10])]
    return out


def compare(spark, rows, items):
    table = spark.createDataFrame([(*i, 5, "x") for i in items], "item_id long, text string, rank int, doc_id string")
    got = lexical.search(docs(spark, rows), table)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (str(r[0]), r[1], r[3], r[2] is None, r[2] or 0)        # noqa: E731
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, items), key=key)


def corpus(seed, n):
    rng = random.Random(seed)
    texts = [prose(seed * 1000 + i, rng.choice([1, 3, 40, 120, 2_000]), 3_000) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[0]) for i in range(60)] + [(5, "rare w1 w2 w2 w2 w2 w2"), (5, "RARE é漢字")]


ITEMS = [(1, prose(31_000, 40, 3_000)), (2, "w1 w1 W2 w3"), (3, None), (4, "..."), (5, "rare rare é漢字"), (6, "nowhere"), (None, "w7 w8"), (None, "w9"), (7, "w5"), (7, "w5"), (8, prose(8, 900))]


def test_search_by_brute_force(spark):
    compare(spark, corpus(31, 150) + EDGES, ITEMS)


def test_search_in_parts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 200)
    monkeypatch.setattr(lexical, "BLOCK_BITS", 4096)
    monkeypatch.setattr(lexical, "GATHERED", 500)
    monkeypatch.setattr(lexical, "HELD_TERMS", 50)
    monkeypatch.setattr(lexical, "ASKED_AT_ONCE", 3)
    compare(spark, corpus(32, 30), ITEMS)


@pytest.mark.parametrize("room", [1, 16], ids=["nearly full slices", "as shipped"])
def test_bounds_hold(room, monkeypatch):
    monkeypatch.setattr(lexical, "ROOM", room)
    texts = [t for _, t in corpus(33, 60)]
    counts = [Counter(terms(t)) for t in texts]
    held = []
    for i, c in enumerate(counts):
        entries = [lexical.entry(t.encode(), level) for t, tf in c.items() for level in lexical.LEVELS if tf >= level]
        held.append((i, 0, c.total(), np.array(entries, np.uint64)))
    vocabulary = sorted({t.encode() for c in counts for t in c})
    weights = {t: 1 + len(t) * 37 for t in vocabulary}
    asked = lexical.Questions([weights], np.zeros(len(vocabulary), np.int64), np.arange(len(vocabulary)), np.array([weights[t] for t in vocabulary]),
                              np.array([[lexical.entry(t, level) for t in vocabulary] for level in lexical.LEVELS], np.uint64))
    total, seen = sum(c.total() for c in counts), 0
    for b in lexical.blocks(held):
        bounds = lexical.upper_bounds(asked, np.array(b["lengths"]), b["width"], b["slices"], len(texts), total)[0]
        for i, bound in zip(b["doc_ids"], bounds):
            m = lexical.measure(counts[i].total(), len(texts), total)
            assert bound >= sum(weights[t.encode()] * lexical.share(tf, m) for t, tf in counts[i].items())
            seen += 1
    assert seen == len(texts)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs(spark, []), items).count() == 0
    assert lexical.search(docs(spark, [(1, None), (2, " . ")]), items).count() == 0
    assert lexical.search(docs(spark, [(1, "a")]), items.limit(0)).count() == 0
    (only,) = lexical.search(docs(spark, [(1, "a")]), items).collect()          # in every document, but ln(4 / 3) is above zero
    assert tuple(only) == (1, 1, 1, 287 * (10**9 // 1800))
