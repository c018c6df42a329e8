"""Operators over whole tables: near-duplicates, shards, quality, language models, packing, and the pipeline."""

from __future__ import annotations

import json
import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from prospectra.llm import common, embeddings, lm, near_copies, packing, quality, secrets, sharding, simhash
from tests.llm.fixtures import EDGES, docs, prose

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)] + [(7, 7)]
    nodes = {n for pair in links if pair[0] != pair[1] for n in pair}
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == components(nodes, [p for p in links if p[0] != p[1]])
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def test_simhash_by_brute_force(spark):
    rng = random.Random(2)
    rows = [*EDGES, (30, "UPPER\x0bcase É\x1cx")]
    for g in range(12):
        words = prose(900 + g, 1500).split()
        for copy in range(6):
            own = list(words)
            for _ in range(copy):
                own[rng.randrange(len(own))] = "changed"
            rows.append((100 + 10 * g + copy, " ".join(own)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows}
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter((r[0], prints[r[0], r[1]]) for r in rows)
    distinct = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bin(a ^ b).count("1") <= 2]
    ids = {p: min((r[0] for r in rows if prints[r[0], r[1]] == p and r[0] is not None), default=None) for p in distinct}
    whole = components(distinct, links)
    least = defaultdict(list)
    for p in distinct:
        if ids[p] is not None:
            least[whole[p]].append(ids[p])
    assert {(r.fp & (2**64 - 1), r.component_id) for r in got} == {(p, min(least[whole[p]], default=None)) for p in distinct}
    assert len(links) > 3 and simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_every_near_pair(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for bits in ((0, 1), (0, 40), (33, 63), (5,), (32,), (31, 32)):
            prints.add(p ^ sum(1 << b for b in bits))
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(sorted(prints))]
    got = sorted(map(tuple, simhash.links(spark.createDataFrame(rows, "fp long, node long")).collect()))
    want = [(i, j) for a, i in rows for b, j in rows if i < j and bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    assert got == sorted(want)


def test_simhash_broadcasts_neither_variants_nor_documents(spark):
    rng = random.Random(4)
    prints = [(rng.getrandbits(63), i) for i in range(2000)]
    prints += [(p ^ 1 << 40, 2000 + i) for p, i in prints[:20]]
    links = simhash.links(common.written(spark.createDataFrame(prints, "fp long, node long")))
    assert sorted(map(tuple, links.collect())) == [(i, 2000 + i) for i in range(20)]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "Broadcast" not in plan
    found = simhash.near_duplicates(docs(spark, [(i, "the same few words") for i in range(2000)]))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(i, 0) for i in range(2000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [fp" in plan and "BroadcastHashJoin [fp" not in plan


def test_embeddings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MEMBERS", 16)          # larger buckets and components are cut
    rng = np.random.default_rng(6)
    rows = []
    for g in range(25):
        center = rng.normal(size=64)
        for c in range(60 if g == 0 else 4):
            rows.append((len(rows), (center + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.15])).astype(np.float32).tolist(), int(g % 3)))
    rows += [(r[0] + 1000, r[1], r[2]) for r in rows[:20]] + [(5, rows[5][1], rows[5][2]), (2000, rows[0][1], 9), (2001, rows[0][1], None), (2002, None, 0), (2003, [0.0] * 64, 0),
             (2004, [float("nan")] + [1.0] * 63, 0), (2005, [float("inf")] * 64, 0), (2006, [None] + [1.0] * 63, 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [], 0),
             (2010, (np.array(rows[0][1]) * 7).tolist(), 0), (2011, [1e-30, 2e-30], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    got = [tuple(r) for r in embeddings.near_duplicates(table).collect()]
    unit = []
    for _, e, label in rows:
        v = None if label is None or e is None or not len(e) or any(x is None or not np.isfinite(x) for x in e) or not any(e) else np.array(e, np.float32).astype(float)
        unit.append(None if v is None else v / np.linalg.norm(v))
    links = [(i, j) for i, a in enumerate(unit) for j, b in enumerate(unit) if i < j and a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= 0.98]
    count = Counter(i for pair in links for i in pair)
    whole = components(range(len(rows)), links)
    least = defaultdict(list)
    for i, root in whole.items():
        least[root].append(rows[i][0])
    want = [(r[0], count[i], min(least[whole[i]]), r[0] == min(least[whole[i]])) for i, r in enumerate(rows)]
    found = sum(g[1] for g in got) / max(1, 2 * len(links))
    assert len(got) == len(rows) and found > 0.99 and sorted(got) == sorted(want)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    import pandas as pd
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = base + rng.normal(size=base.shape) * 0.02
    codes = [embeddings.coded.func(pd.Series(list(x))) for x in (base, other)]
    bits = [np.stack([np.frombuffer(c, np.uint8) for c in own["code"]]) for own in codes]
    factors = [own["factor"].to_numpy() for own in codes]
    cosines = (base * other).sum(1) / np.linalg.norm(other, axis=1)
    kept = [embeddings.may_link(np.stack([a, b]), np.array(f))[0, 1] for a, b, f in zip(*bits, zip(*factors))]
    assert (cosines >= 0.98).sum() > 100 and all(np.array(kept)[cosines >= 0.98])
    shuffled = embeddings.may_link(bits[0], factors[0])
    assert shuffled.mean() < 0.01
    signs = np.unpackbits(bits[0], axis=1) * 2.0 - 1
    turned = base @ embeddings.rotations(64)
    estimate = (signs * np.roll(turned, 1, axis=0)).mean(1) * np.sqrt(64) / factors[0]       # inner products with the next vector
    assert abs((estimate - (base * np.roll(base, 1, axis=0)).sum(1)).mean()) < 0.02


@pytest.mark.parametrize("shards", [24, 3])
def test_shards(spark, shards):
    rows = [*EDGES, *((1000 + i, f"copy {i % 40}") for i in range(400)), *((3000 + i, prose(i, 5)) for i in range(300)), *((5000 + i, "hot") for i in range(200))]
    got = sharding.assign(docs(spark, rows), shards).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes.get(s, 0)))
    home = defaultdict(set)
    for r in got:
        if r.doc_id is not None and 1000 <= r.doc_id < 1400:
            home[r.doc_id % 40].add(r.shard)
    by_hash = 40 * shards * (1 - (1 - 1 / shards) ** 10) - 40         # cuts of 40 groups of ten if each row went by its own hash
    assert sum(len(h) - 1 for h in home.values()) <= by_hash / 10 and len(home) == 40
    assert len({r.shard for r in got if r.doc_id is not None and r.doc_id >= 5000}) <= -(-200 * shards * 4 // 3 // len(rows)) + 3
    assert sharding.assign(docs(spark, []), shards).count() == 0
    assert sharding.assign(docs(spark, [(1, "a"), (2, "a")]), shards).count() == 2


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        kind = i % 10
        text = prose(i, 80, 300)
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2:
            text += " " + " ".join(rng.choice(["vileness", "villainous", "vilest"]) for _ in range(2))
        rows.append((i, text, rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])))
        labels.append((i, int(kind != 1), int(kind == 2), "x"))
    table = spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, quality int, toxic int, text string")
    got = quality.classify(docs(spark, [*rows, *EDGES]), table).collect()
    assert len(got) == len(rows) + len(EDGES)
    kept = {r.doc_id: r.keep for r in got if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id >= 20}
    right = [kept[i] == (q == 1 and t == 0) for i, q, t, _ in labels if i in kept]
    assert sum(right) / len(right) > 0.97
    assert all(kept[i] for i, q, t, _ in labels if i in kept and q == 1 and t == 0)
    untrained = quality.classify(docs(spark, EDGES), table.limit(0)).collect()
    assert len(untrained) == len(EDGES) and all(r.keep for r in untrained)
    assert quality.classify(docs(spark, []), table).count() == 0


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("big", "p", 3.0)] * 200 + [("bad", "p", -3.0)] * 200 + [("tiny", "p", -3.0)]
    got = quality.with_sites(spark.createDataFrame(rows, "host string, path string, quality double"), "quality").select("host", "quality_site", "p_quality").distinct().collect()
    site = {r.host: r.quality_site for r in got}
    assert site["bad"] < 0.1 < 0.9 < site["big"] and site["bad"] < site["tiny"] < site["big"] and site["tiny"] > 2 * site["bad"]


def plain_scores(rows, target):
    words = {k: [w.decode() for w in common.words_of(t)] for k, (_, t) in enumerate(rows)}
    pairs = {k: list(zip([None, *w], w)) for k, w in words.items()}
    vocabulary = {w for own in words.values() for w in own}
    losses = []
    for member in (lambda i: i in target, lambda i: True):
        uni, bi = Counter(), Counter()
        for k, (i, _) in enumerate(rows):
            if member(i):
                uni.update(words[k])
                bi.update(pairs[k])
        total, kinds = Counter(), Counter()
        for (a, _), n in bi.items():
            total[a] += n
            kinds[a] += 1
        p1 = lambda w, uni=uni: (uni[w] + 1) / (sum(uni.values()) + len(vocabulary) + 1)      # noqa: E731
        p2 = lambda a, w, bi=bi, total=total, kinds=kinds, p1=p1: p1(w) if not total[a] else max(bi[a, w] - 0.75, 0) / total[a] + 0.75 * kinds[a] / total[a] * p1(w)      # noqa: E731
        losses.append({k: -sum(np.log2(p2(*p)) for p in own) / len(own) if own else None for k, own in pairs.items()})
    return losses


def test_language_models_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "MERGED", 2)            # several levels of sums and several parts of answers
    monkeypatch.setattr(lm, "ANSWERED", 2)
    monkeypatch.setattr(lm, "CELLS", 7)
    rows = [(i, prose(i, 40, 30)) for i in range(100, 160)] + [e for e in EDGES if e[1] is None or len(e[1]) < 100]
    target = spark.createDataFrame([(i,) for i in [*range(100, 130), 100, None, 5, 12345]], "doc_id long")
    got = lm.cross_entropy_difference(docs(spark, rows).repartition(5), target).collect()
    assert len(got) == len(rows)
    in_target, background = plain_scores(rows, {*range(100, 130), 5})
    want = sorted((str(rows[k][0]), len(common.words_of(rows[k][1])), *(None if x[k] is None else round(x[k], 3) for x in (in_target, background))) for k in range(len(rows)))
    have = sorted((str(r.doc_id), r.n_tokens, *(None if x is None else round(x, 3) for x in (r.target_loss, r.background_loss))) for r in got)
    assert [w[:2] for w in want] == [h[:2] for h in have]
    assert all(a == b or abs(a - b) < 2e-3 for w, h in zip(want, have) for a, b in zip(w[2:], h[2:]))
    assert lm.cross_entropy_difference(docs(spark, []), target).count() == 0


def test_vocabulary_keeps_whole_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_WORDS", 3)
    words, counts = lm.vocabulary(docs(spark, [(1, "a a a b b c c d"), (2, None), (3, "A B e")]))
    assert words == {b"a": 1, b"b": 2, b"c": 3} and counts.tolist() == [2, 4, 3, 2]      # d would bring its equal, e, too


def plain_cuts(places, penalty, window):
    best = [(0.0, 0)]
    for j in range(1, len(places)):
        best.append(min((best[i][0] + window - (places[j] - places[i]) + penalty[j], i) for i in range(j) if places[j] - places[i] <= window))
    return best[-1][0]


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        places = np.append(0, np.cumsum(rng.integers(1, 9, rng.integers(1, 60))))
        penalty = rng.choice([0.0, 1.0, 5.0], len(places))
        cuts = packing.best_cuts(places, penalty, 12)
        cost = sum(12 - (b - a) + penalty[np.searchsorted(places, b)] for a, b in zip([0, *cuts[:-1]], cuts))
        assert cuts[-1] == places[-1] and cost == pytest.approx(plain_cuts(places, penalty, 12))


def test_packing_round_trip(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*EDGES, *((200 + i, prose(i, 20 + 13 * i)) for i in range(80)), (300, "don't \u2028 <b>|x|</b>   \n\n end\r\n" * 50)]
    got = packing.pack_documents(docs(spark, rows).coalesce(1), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    import zlib
    expected = [(i, [*(coder.encode(t, add_special_tokens=False).ids if t else []), 1]) for i, t in rows]
    pieces = sorted(got, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for doc_id, ids in expected:                # pieces stand in the documents' order
        done = 0
        while done < len(ids):
            p = pieces[at]
            own = np.array(ids[done:done + p.length], "<u4")
            assert (p.doc_id, p.start, p.doc_tokens, p.ids_crc32) == (doc_id, done, len(ids), zlib.crc32(own.tobytes()))
            done, at = done + p.length, at + 1
    assert at == len(pieces)
    lengths = Counter()
    for p in pieces:
        assert p.offset == lengths[p.sequence_id]
        lengths[p.sequence_id] += p.length
    assert max(lengths.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.02 * sum(lengths.values())
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_pipeline_stages(spark, tmp_path):
    words = prose(1, 60, 5000)
    labels = [(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(200, 260)] + [(i, 1, 1) for i in range(260, 320)]
    rows = [(i, prose(i, 60, 5000)) for i in range(200)] + [(i, prose(i, 60, 5000).upper().replace(" ", "!! ")) for i in range(200, 260)]
    rows += [(i, prose(i, 60, 5000) + " villainous vileness villainous") for i in range(260, 320)]
    rows += [(400, words), (401, words), (402, prose(77, 20, 5000) + " " + prose(4, 40, 5000)), (403, prose(78, 30) + " password = hunter2secret and more"), (404, None), (None, "no id"), (405, "")]
    table = docs(spark, rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(4, 40, 5000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], str(tmp_path))))
    assert all(f.columns == table.columns for f in frames[:-1])
    kept = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert not {*range(200, 320)} & set(kept[1]) and {*range(200), 400, 401, 402, 403, 404, None} <= set(kept[1])
    assert 400 not in kept[2] or 401 not in kept[2] and 0 in kept[2]
    assert 1 not in set(kept[2]) or {1, 400, 401} & set(kept[2]) == {1}         # 400 and 401 copy document 1
    assert set(kept[2]) - set(kept[3]) == {4, 402}                              # what the benchmark holds, and its source
    assert kept[4][403].text.endswith(" [SECRET] and more") and kept[4][403].n_chars == len(kept[4][403].text) and kept[4][5] == kept[3][5]
    packed = frames[-1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in packed} == set(kept[4]) and all(r.n % r.m == 0 for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frames[-1].count()


def plain_shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_by_brute_force(spark):
    rng = random.Random(12)
    rows = [*EDGES, (5, "one"), (None, "no id here"), (None, "only unnamed"), (None, "only  UNNAMED")]
    for g in range(25):
        words = prose(700 + g, 150, 5000).split()
        for copy in range(8):
            own = words if g % 2 else list(words)           # every second group drifts, so that its ends are unlike
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(10**6)}"
            rows.append((1000 + 100 * g + copy, " ".join(own)))
    rng.shuffle(rows)
    sets = [plain_shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    whole = components(range(len(rows)), links)
    groups = defaultdict(list)
    for i, root in whole.items():
        groups[root].append((rows[i][0] is None, rows[i][0], i))
    want = Counter(rows[min(g)[2]][0] for g in groups.values())
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "")
    assert Counter(r.doc_id for r in got.collect()) == want and got.columns == docs(spark, []).columns
    assert sum(1 for i, j in links if sets[i] != sets[j]) > 100
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, []), "").count() == 0


def test_near_copies_beyond_a_bands_smallest(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "near_sizes", lambda a, b: F.lit(True))
    base = [prose(40, 60, 5000), prose(41, 60, 5000), prose(41, 60, 5000) + " more"]
    sets = spark.createDataFrame([(i, 60, [7, 100 + i]) for i in range(3)], "node long, n long, bands array<long>")       # one shared band
    found = near_copies.links(sets, spark.createDataFrame(list(enumerate(base)), "row long, text string"))
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


@needs_tables
def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql()))


def test_secrets_take_one_python_pass(spark):
    """A stage with two passes keeps two Python workers for each task, and all of them stay in the executor's memory."""
    rows = docs(spark, [*EDGES, (20, "token = abcdef token: ghijkl!"), (21, "no more")])
    got = corpus_pipeline.redact_secrets(spark, rows, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    old = rows.withColumn("spots", secrets.find_secrets("text")).withColumn("text", secrets.redact("text", "spots"))
    n_chars = F.when(F.size("spots") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(rows.schema["n_chars"].dataType)
    key = lambda r: str(r)      # noqa: E731
    assert sorted(got.collect(), key=key) == sorted(old.withColumn("n_chars", n_chars).select(rows.columns).collect(), key=key)
