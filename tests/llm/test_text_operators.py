"""Operators that work within a document: secrets, benchmark passages, chat formatting, personal data."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from prospectra.llm import chat, decontamination, pii, secrets
from tests.llm.fixtures import EDGES, docs, prose

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def tlv(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def rsa_key():
    rng = random.Random(1)
    number = lambda n: tlv(2, b"\x41" + rng.randbytes(n - 1))      # noqa: E731
    return tlv(0x30, tlv(2, b"\0") + number(128) + tlv(2, b"\1\0\1") + number(128) + b"".join(number(64) for _ in range(5)))


def openssh_key():
    part = lambda b: len(b).to_bytes(4, "big") + b      # noqa: E731
    return b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(b"p" * 51) + part(b"s" * 136)


def jwt(alg="HS256", size=32):
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()      # noqa: E731
    return ".".join((url(json.dumps({"alg": alg, "typ": "JWT"}).encode()), url(b'{"sub":"1"}'), url(bytes(range(size)))))


def test_confirmed_secrets():
    key = rsa_key()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", base64.b64encode(key).decode())) + "\n-----END RSA PRIVATE KEY-----"
    text = f"é {pem} raw {base64.b64encode(key).decode()} hex {key.hex().upper()} ssh {base64.b64encode(openssh_key()).decode()} t {jwt()} end"
    found = secrets.find(text)
    assert [k for k, _, _ in found if k not in secrets.BASE_KINDS] == ["der", "der", "der", "openssh", "jwt"]
    assert text[slice(*found[0][1:])] == pem
    assert [s for s in found if s[0] in secrets.BASE_KINDS] == plain_secrets(text)


def test_unconfirmed_candidates():
    key = rsa_key()
    broken = key[:-1] + b"", key + b"\0", b"\x30\x82\x01\x00" + bytes(200), bytes(range(200))
    for data in broken:
        assert not any(k in ("der", "openssh") for k, _, _ in secrets.find(base64.b64encode(data).decode() + " " + data.hex()))
    assert not any(k == "jwt" for k, _, _ in secrets.find(jwt("none") + " " + jwt("HS256", 12) + " eyJhbGciOiJI.eyJ.abc"))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    "])
@pytest.mark.parametrize("data", [rsa_key(), openssh_key()], ids=["der", "openssh"])
def test_wrapped_and_escaped_keys(data, end):
    kind = "openssh" if data.startswith(b"openssh") else "der"
    for width in (40, 64, 76):
        lines = end.join(re.findall(f".{{1,{width}}}", base64.b64encode(data).decode()))
        armoured = f"-----BEGIN PRIVATE KEY-----{end}{lines}{end}-----END PRIVATE KEY-----"
        text = f'é {{"type": "service_account", "private_key": "{armoured}{end}", "id": "x"}}'
        assert [text[a:b] for k, a, b in secrets.find(text) if k == kind] == [armoured]
        for before, after in (("key:" + end, end + "More words follow"), ("", ""), ("M ", " ")):
            text = before + lines + after
            assert [text[a:b] for k, a, b in secrets.find(text) if k == kind] == [lines], (before, after)
        assert not [k for k, _, _ in secrets.find(lines[:-9] + " " + lines[-5:] + end + "Words") if k == kind]


def test_token_headers_are_judged_by_decoding():
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()      # noqa: E731
    for head in (b'{ "alg":"HS256"}', b'{\n  "alg": "HS256"\n}', b' {"alg":"HS256"}', b'{\r\n"alg":"HS256"}', b'{"alg":"HS256"}'):
        token = ".".join((url(head), url(b'{"sub":"1"}'), url(bytes(32))))
        for before in ("", "www.example.", "\\n", "a b"[:2]):
            text = before + token + ". End"
            assert [text[a:b] for k, a, b in secrets.find(text) if k == "jwt"] == [token], (head, before)
    assert not any(k == "jwt" for k, _, _ in secrets.find(".".join((url(b'["alg","HS256"]'), url(b"{}"), url(bytes(32))))))


def test_base_secrets_by_brute_force():
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "abc", "ABCDEF", "0f" * 13, "AKIA", "Z9" * 8, "\n", "ſecret", "toKen", "é", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [s for s in secrets.find(text) if s[0] in secrets.BASE_KINDS] == plain_secrets(text), text


def test_secrets_on_spark(spark):
    rows = docs(spark, [*EDGES, (20, "token = abcdef token: ghijkl!")]).withColumn("found", secrets.find_secrets("text"))
    got = rows.withColumn("clean", secrets.redact("text", "found")).collect()
    assert len(got) == len(EDGES) + 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[20].clean == "[SECRET] [SECRET]!" and by_id[1].clean is None and by_id[2].clean == "" and by_id[7].clean == "x" * 30_000
    assert secrets.redacted("abcdef", [{"start": 0, "end": 3}, {"start": 2, "end": 4}, {"start": 4, "end": 5}]) == "[SECRET][SECRET]f"
    assert docs(spark, []).withColumn("found", secrets.find_secrets("text")).count() == 0


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        for at in range(max(1, len(own) - 12) if own else 0):
            window = own[at:at + 13]
            for p in range(len(words) - len(window) + 1):
                if words[p:p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(item)
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("part_words", [10**9, 60])
def test_decontamination_by_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(decontamination, "PATTERN_WORDS", part_words)       # the small one takes several passes
    rng = random.Random(5)
    items = [(i, prose(i, rng.choice((0, 1, 3, 12, 13, 14, 30)), 6)) for i in range(12)] + [(3, prose(3, 20, 6)), (50, None), (51, prose(8, 9_000)[200:400])]
    rows = [(100 + i, prose(200 + i, rng.randrange(60), 6) + " " + rng.choice(items)[1].upper() if i % 2 else prose(300 + i, 80, 6)) for i in range(30) if items] if all(t is not None for _, t in items[:12]) else []
    rows = [*rows, *EDGES]
    benchmark = spark.createDataFrame(items + [(None, "x")], "item_id long, text string")
    got = decontamination.find_benchmark(docs(spark, rows), benchmark).select("doc_id", "text", "lang", "found").collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = plain_hits(r.text, items)
        spans = [p for s in r.found.spans for p in range(s.start, s.end)]
        assert (r.found.n_words, r.found.n_hit, r.found["items"], spans) == (n, len(hit), found, hit), r.doc_id
        assert all(a.end < b.start for a, b in zip(r.found.spans, r.found.spans[1:]))


@pytest.mark.parametrize("part_words", [10**9, 60])
def test_items_without_an_id_are_searched(spark, monkeypatch, tmp_path, part_words):
    import duckdb
    monkeypatch.setattr(decontamination, "PATTERN_WORDS", part_words)
    items = [(None, prose(61, 20, 900)), (10, prose(62, 20, 900)), (None, prose(63, 20, 900)), (9, prose(61, 14, 900)), (0, "")]
    rows = [(1, "a " + prose(61, 20, 900)), (2, prose(62, 20, 900) + " b " + prose(63, 20, 900)), (3, prose(64, 90, 900)), (4, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, decontamination.op2_decontamination(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(tuple(r) for r in db.sql(decontamination.OP2_SQL).fetchall())
    assert [r[2] for r in got] == [20, 40, 0, 0] and [r[3] for r in got] == [2, 2, 0, 0]


def test_decontamination_of_empty_tables(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_benchmark(docs(spark, []), nothing).count() == 0
    assert {tuple(r) for r in decontamination.find_benchmark(docs(spark, EDGES), nothing).select("found.n_hit", F.size("found.items")).collect()} == {(0, 0)}


def test_index_finds_all_places():
    import numpy as np
    rng = np.random.default_rng(2)
    for symbols in (1, 2, 9):
        text = rng.integers(0, symbols + 1, 500)
        index = decontamination.ShardIndex(text, symbols)
        for size in (1, 2, 5, 13):
            words = np.zeros((40, 13), np.int64)
            words[:, 13 - size:] = rng.integers(1, symbols + 1, (40, size))
            low, high = index.search(words, np.full(40, size))
            for w, a, b in zip(words, low, high):
                want = [p for p in range(500 - size + 1) if (text[p:p + size] == w[13 - size:]).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_chat_round_trip(spark):
    hard = ["<turn>", "</turn>", "\\", "\\s\\l\\n", "a\nb", "", None, "\n</turn>\n", "\\</turn>\\", "漢 \U0001F600"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(["system", "user", "assistant", "assi\nstant", None, "assistant", "user", "assistant", "user", "tool"], hard))]
    rows += [(2, 0, "user", "only a question", "x"), (3, None, "assistant", "b", "x"), (3, None, "assistant", "a", "x"), (3, None, "assistant", "a", "x"), (None, 1, "assistant", "no id", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.examples(table).withColumn("back", chat.turns_of(F.col("formatted"))).withColumn("reply", chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).collect()
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [tuple(t) for t in mine[-1].back] == turns
        ends = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [r.reply for r in mine if r.loss_end is not None] == [turns[i][1] for i in ends]
        assert [[tuple(t) for t in r.back] for r in mine if r.loss_end is not None] == [turns[:i + 1] for i in ends]
        assert sum(r.loss_end is None for r in mine) == (turns[-1][0] != "assistant")
    assert chat.examples(table.limit(0)).count() == 0
    probe = chat.examples(chat.with_probe(table.limit(0))).collect()
    assert len(probe) == 1 and hashlib.sha256(probe[0].formatted.encode()).hexdigest()


def plain_personal(text):
    def matches(pattern):
        return re.finditer(pattern, text)
    out = [("email", *m.span()) for m in matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", *m.span()) for m in matches(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))]
    for m in matches(r"[0-9]([\x20-]?[0-9])+"):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in matches(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_personal_patterns_by_brute_force():
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x-y", ".", "com", "é", " ", "1", "25", "255", "256", "4539148803436467", "+1", "(974) 555-3436", "-", "_%", "\n", "0001"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 22)))
        assert pii.base_spans(text) == plain_personal(text), text
    assert pii.base_spans("9" * 200_000 + "." * 1000 + "a" * 200_000) == []


def test_field_marginals_are_exact_on_a_tree():
    import itertools

    import numpy as np
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.FEATURES, k)), rng.normal(size=(3, k, k)))
    nodes = [pii.Node(i, i + 1, 0, (), (i, 30 + i)) for i in range(4)]
    edges = [(0, 1, 0), (1, 2, 1), (1, 3, 2)]
    weight = np.zeros((k,) * 4)
    for labels in itertools.product(range(k), repeat=4):
        weight[labels] = np.exp(sum(field.unary[list(n.features), y].sum() for n, y in zip(nodes, labels)) + sum(field.pair[t][labels[i], labels[j]] for i, j, t in edges))
    weight /= weight.sum()
    exact = np.stack([weight.sum(tuple(a for a in range(4) if a != i)) for i in range(4)])
    assert np.abs(pii.posteriors(field, nodes, np.array(edges)) - exact).max() < 1e-3


def test_repeats_get_the_label_of_what_they_repeat(spark):
    text = "Call +1 (974) 555-34{0:02d} now. Later call 1 (974) 555-34{0:02d} once. Mail jane.doe{0}@mail.example.com or jane.doe{0} (at) mail.example.com or jane.doe{0}. Order 99{0:02d}5678901 shipped."
    rows = [(i, text.format(i)) for i in range(10, 60)] + [(100 + i, prose(i, 50)) for i in range(50)]
    got = {r.doc_id: r for r in pii.find_personal(docs(spark, [*rows, (None, None), (1, "")])).select("doc_id", "text", "found").collect() if r.doc_id is not None}
    assert len(got) == 101 and not got[1].found and not any(got[100 + i].found for i in range(50))
    added = [(r.text[s.start:s.end], s.kind) for r in got.values() for s in r.found if s.added]
    assert ("jane.doe12", "email") in added and ("jane.doe12 (at) mail.example.com", "email") in added and ("1 (974) 555-3412", "phone") in added
    assert not any("5678901" in a for a, _ in added)
    for r in got.values():
        assert [(s.kind, s.start, s.end) for s in r.found if not s.added] == plain_personal(r.text or "")
    assert pii.find_personal(docs(spark, [])).count() == 0
