"""Missing numbers: only gaps are listed, wide ones in several rows."""

import pytest

from prospectra.operators import structure


@pytest.mark.parametrize("step", [3, 65_536])
def test_missing_numbers(spark, monkeypatch, step):
    monkeypatch.setattr(structure, "GAP_ROWS", step)
    held = {1: [1, 2, 5, 5, 9], 2: [4], 3: [1, 2, 3], 4: [0, -7, 2], 5: [200_000, 70_000]}
    found = spark.createDataFrame([(d, n) for d, own in held.items() for n in own] + [(6, None)], "doc_id int, number int")
    got = sorted(map(tuple, structure.missing_numbers(found).collect()))
    assert got == [(d, n) for d, own in held.items() for n in range(1, max(own)) if n not in own]
