"""The sink of the ingest stream: merged parts, repeated batches, documents that come again."""

from __future__ import annotations

import random

from prospectra.streaming import ingest
from prospectra.streaming.ingest import IngestSink

SCHEMA = "domain string, filename string, text string, arrival long"


def test_parts_stay_few_and_the_newest_version_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PARTS", 3)
    rng = random.Random(1)
    batches = [[("d", f"f{rng.randrange(12)}", f"text {b} " + "word " * rng.randrange(1, 300), b) for _ in range(rng.randrange(1, 6))] for b in range(9)]
    batches[6].append(("d", "f3", "   ", 6))                            # comes again without any text
    sink = IngestSink(spark, f"file://{tmp_path}/sink")
    last, most = {}, 0
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        sink.add(batch, number)
        if number in (0, 4):
            sink.add(batch, number)                                     # a repeated batch
        for r in rows:
            last[r[1]] = number
        most = max(most, len(sink.versions.current()[1]))
    assert most <= 4 and sink.versions.current()[1][-1].bucket == 8
    got = sorted(map(tuple, sink.current().collect()))
    want = []
    for number, rows in enumerate(batches):
        own = spark.createDataFrame([r for r in rows if last[r[1]] == number] or [], SCHEMA)
        want += map(tuple, ingest.ingest_chunks(own).select(*sink.current().columns).collect())
    assert got == sorted(want) and (last["f3"] > 6 or not any(r[1] == "f3" for r in got))


def test_a_reader_goes_on_while_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PARTS", 2)
    sink = IngestSink(spark, f"file://{tmp_path}/sink")
    sink.add(spark.createDataFrame([("d", "a", "first text", 1)], SCHEMA), 0)
    before = sink.current()
    for n in (1, 2, 3):
        sink.add(spark.createDataFrame([("d", "a", f"text {n}", 1), ("d", f"b{n}", "more", 1)], SCHEMA), n)
    assert [r["text"] for r in before.collect()] == ["first text"]
    assert {(r["filename"], r["text"]) for r in sink.current().collect()} == {("a", "text 3"), ("b1", "more"), ("b2", "more"), ("b3", "more")}
