"""The versioned store: one bucket of each table per document, readers between versions, cascading deletes."""

from __future__ import annotations

import pytest

from prospectra.sources.store import Store
from prospectra.sources.versions import CommitConflict

TABLES = {"documents": "domain string, filename string, size long", "chunks": "domain string, filename string, text string"}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", TABLES, buckets=8)


def docs(spark, names, size=1):
    return spark.createDataFrame([("d", n, size) for n in names], TABLES["documents"])


def chunks(spark, names, text="t", each=3):
    return spark.createDataFrame([("d", n, f"{text}{i}") for n in names for i in range(each)], TABLES["chunks"])


def rows(snapshot, table):
    return sorted(map(tuple, snapshot.read(table).collect()))


def test_replacing_one_document_rewrites_one_bucket_of_each_table(spark, store):
    names = [f"f{i}" for i in range(40)]
    assert store.snapshot().version == 0 and rows(store.snapshot(), "chunks") == []
    assert store.replace({"documents": docs(spark, names), "chunks": chunks(spark, names)}) == 1
    old = store.snapshot()
    assert store.replace({"chunks": chunks(spark, ["f7"], "new", 2), "documents": docs(spark, ["f7"], 9)}) == 2
    new = store.snapshot()
    gone, came = set(old.parts) - set(new.parts), set(new.parts) - set(old.parts)
    for parts in (gone, came):
        assert sorted(p.name for p in parts) == ["chunks", "documents"] and len({p.bucket for p in parts}) == 1
    assert len(rows(old, "chunks")) == 120 and ("d", "f7", "t2") in rows(old, "chunks")             # a reader goes on with its version
    assert len(rows(new, "chunks")) == 119 and [r for r in rows(new, "chunks") if r[1] == "f7"] == [("d", "f7", "new0"), ("d", "f7", "new1")]
    assert ("d", "f7", 9) in rows(new, "documents") and sum(p.rows for p in new.parts if p.name == "documents") == 40


def test_a_delete_cascades_and_counts(spark, store):
    names = [f"f{i}" for i in range(20)]
    store.replace({"documents": docs(spark, names), "chunks": chunks(spark, names)})
    store.replace({"documents": docs(spark, ["alone"])})
    asked = docs(spark, ["f3", "alone", "unknown", "f3"])
    before = store.snapshot()
    counts = {(r["filename"], r["table"]): r["removed"] for r in store.removed(asked, before).collect()}
    assert counts == {("f3", "documents"): 1, ("f3", "chunks"): 3, ("alone", "documents"): 1, ("alone", "chunks"): 0, ("unknown", "documents"): 0, ("unknown", "chunks"): 0}
    store.delete(asked)
    assert len(rows(store.snapshot(), "documents")) == 19 and len(rows(store.snapshot(), "chunks")) == 57
    store.delete(docs(spark, names))
    assert rows(store.snapshot(), "documents") == [] == rows(store.snapshot(), "chunks") and len(rows(before, "chunks")) == 60


def test_a_writer_that_comes_second_starts_over(spark, store, monkeypatch):
    store.replace({"documents": docs(spark, ["a"])})
    commit, late = store.versions.commit, []

    def slow(after, parts):
        if not late:                                    # another writer commits while this one prepares its parts
            late.append(1)
            Store(spark, store.versions.root, TABLES, buckets=8).replace({"documents": docs(spark, ["b"])})
        return commit(after, parts)

    monkeypatch.setattr(store.versions, "commit", slow)
    assert store.replace({"documents": docs(spark, ["c"])}) == 3
    assert [r[1] for r in rows(store.snapshot(), "documents")] == ["a", "b", "c"]
    monkeypatch.setattr(store.versions, "commit", lambda *_: (_ for _ in ()).throw(CommitConflict("always")))
    with pytest.raises(CommitConflict):
        store.delete(docs(spark, ["a"]))
    assert store.snapshot().version == 3
