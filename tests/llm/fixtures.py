"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, label int, n_words string, spans string, row long, shard int"
EMPTY_ID = None


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1]), "x", 1, "x", "x", 7, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(words))


EDGES = [(None, None), (None, "no id here"), (1, None), (2, ""), (3, "   \n\t "), (4, "é ü 漢字 \U0001F600 done."), (5, "one"), (5, "one"), (6, "two words"), (7, "x" * 30_000), (8, prose(8, 9_000)), (9, prose(8, 9_000))]
