"""Personal data in texts: plain patterns, and a skip-chain conditional random field that carries their labels to repeats."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import read, sampled, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = (None, *KINDS)                 # the field's labels; 0 is no personal data

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER = re.compile(r"(?<![0-9A-Za-z+])[0-9(][0-9().\x20-]{4,40}[0-9](?![0-9A-Za-z])")     # a run of digits that may be one
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\x20?(?:\(at\)|\[at\])\x20?([A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})", re.I)
HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{6,64}(?![A-Za-z0-9_%+@-])")
WORD_BEFORE = re.compile(r"([^\W\d_]{1,30})[^\w]{0,8}\Z")

LEAST_DIGITS, TAIL_DIGITS = 7, 7        # digits of a number that is looked at; of the end that makes two numbers similar
NEAR = 40                               # code points between neighbours of the chain
WORD_BUCKETS = 512
TRAINING_DOCS = 20_000                  # documents that the field is fitted on, about (a hash of doc_id picks them)
SURE = 0.9                              # posterior from which a span is added
ROUNDS, DAMPING = 12, 0.3
REPEATED = ((1, 3.0), (2, 1.5))         # least log potential of equal labels by type of skip edge, and most of unequal ones, negated
OBSERVED = 12.0                         # log potential of a label that a pattern has confirmed

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("added", T.BooleanType())]))


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each address holds one @: the run before it, as far as the last match, and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns confirm, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Node(NamedTuple):
    start: int
    end: int
    label: int                  # of a pattern, or 0
    keys: tuple[str, ...]       # nodes with a common key are repeats of, or similar to, one another
    features: tuple[int, ...]


def number_features(text: str, start: int, end: int) -> tuple[int, ...]:
    """What a number looks like apart from what the patterns themselves ask for: digits, groups, separators, the word before."""
    own = text[start:end].lstrip("+")
    digits = sum(c.isdigit() for c in own)
    word = WORD_BEFORE.search(text[max(0, start - 42):start])
    return (min(digits, 23), 24 + min(7, len(re.findall(r"[0-9]+", own))), 32 + ("(" in own) + 2 * ("." in own) + 4 * ("-" in own) + 8 * (" " in own),
            48 + (zlib.crc32(word[1].casefold().encode()) % WORD_BUCKETS if word else 0))


FEATURES = 48 + WORD_BUCKETS + 1        # the last one marks addresses


def nodes_of(text: str, base: list[tuple[str, int, int]]) -> list[Node]:
    """The field's nodes in the order of the text: confirmed spans and what else may be one."""
    out = []
    taken = np.array([(a, b) for _, a, b in base], np.int64).reshape(-1, 2)
    for kind, a, b in base:
        if kind == "email":
            address = text[a:b].casefold()
            local = address.partition("@")[0]
            keys = ("@" + address, *(("@" + local,) if len(local) >= 6 and re.search(r"[0-9._]", local) else ()))
            out.append(Node(a, b, 1, keys, (FEATURES - 1,)))
        else:
            digits = "".join(c for c in text[a:b] if c.isdigit())
            out.append(Node(a, b, LABELS.index(kind), (digits, digits[-TAIL_DIGITS:]), number_features(text, a, b)))
    free = lambda a, b: not ((taken[:, 0] < b) & (taken[:, 1] > a)).any()      # noqa: E731
    for m in NUMBER.finditer(text):
        digits = "".join(c for c in m[0] if c.isdigit())
        if len(digits) >= LEAST_DIGITS and free(*m.span()):
            out.append(Node(*m.span(), 0, (digits, digits[-TAIL_DIGITS:]), number_features(text, *m.span())))
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        for m in SPELLED.finditer(text):
            if free(*m.span()):
                out.append(Node(*m.span(), 0, (f"@{m[1]}@{m[2]}".casefold(),), (FEATURES - 1,)))
    handles = {k[1:] for n in out if n.label == 1 for k in n.keys[1:]}
    if handles:
        for m in HANDLE.finditer(text):
            handle = m[0].rstrip(".")
            if handle.casefold() in handles and free(m.start(), m.start() + len(handle)):
                out.append(Node(m.start(), m.start() + len(handle), 0, ("@" + handle.casefold(),), (FEATURES - 1,)))
    return sorted(out)


def edges_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 joins neighbours of the chain; a node is joined with the last one before it that has a common key, by 1
    if that is the whole number, address or handle, by 2 if it is the end of a number."""
    out, last = [], {}
    for j, node in enumerate(nodes):
        if j and node.start - nodes[j - 1].end <= NEAR:
            out.append((j - 1, j, 0))
        joined = {}
        for k in node.keys:
            if k in last:
                same = k[:1] == "@" or k == node.keys[0] == nodes[last[k]].keys[0]
                joined[last[k]] = min(joined.get(last[k], 2), 1 if same else 2)
        out += [(i, j, kind) for i, kind in sorted(joined.items())]
        last.update(dict.fromkeys(node.keys, j))
    return out


class Field(NamedTuple):
    unary: np.ndarray           # feature x label
    pair: np.ndarray            # type x label x label, log potentials


def fit_field(nodes: list[tuple[int, tuple[int, ...]]], pairs: np.ndarray) -> Field:
    """Weights by maximum pseudo-likelihood: a softmax regression of the patterns' labels on what nodes look like, and pair
    potentials from how much oftener than by chance joined nodes bear each two labels. pairs: type x label x label counts."""
    k = len(LABELS)
    unary = np.zeros((FEATURES, k))
    if nodes:
        truth = np.eye(k)[[n[0] for n in nodes]]
        rows = np.repeat(np.arange(len(nodes)), [len(n[1]) for n in nodes])
        columns = np.array([f for n in nodes for f in n[1]])
        first, second = np.zeros_like(unary), np.zeros_like(unary)
        for step in range(1, 201):
            z = np.zeros((len(nodes), k))
            np.add.at(z, rows, unary[columns])
            p = np.exp(z - z.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - truth) / len(nodes)
            gradient = 1e-4 * unary
            np.add.at(gradient, columns, error[rows])
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient ** 2 - second)
            unary -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    smooth = pairs + 0.5
    together = smooth / smooth.sum((1, 2), keepdims=True)
    chance = together.sum(2)[:, :, None] * together.sum(1)[:, None, :]
    potentials = np.clip(np.log(together / chance), -2.0, 2.0)
    # Repeats of one thing agree: at least this much, even where the sample has few repeats.
    for kind, least in REPEATED:
        potentials[kind] = np.where(np.eye(k, dtype=bool), np.maximum(potentials[kind], least), -least)
    return Field(unary, potentials)


def posteriors(field: Field, nodes: list[Node], edges: np.ndarray) -> np.ndarray:
    """Label posteriors of every node by damped loopy sum-product messages along both directions of every edge."""
    local = np.stack([field.unary[list(n.features)].sum(0) for n in nodes])
    labels = np.array([n.label for n in nodes])
    local[labels > 0, labels[labels > 0]] += OBSERVED
    if not len(edges):
        return normal(local)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([field.pair[edges[:, 2]], field.pair[edges[:, 2]].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), len(LABELS)))
    for _ in range(ROUNDS):
        belief = local.copy()
        np.add.at(belief, target, messages)
        out = belief[source] - messages[back]
        sent = np.log(np.exp(out[:, :, None] - out.max(1)[:, None, None] + table).sum(1))
        sent -= sent.max(1, keepdims=True)
        messages = DAMPING * messages + (1 - DAMPING) * sent
    belief = local.copy()
    np.add.at(belief, target, messages)
    return normal(belief)


def normal(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


NODES = T.StructType([T.StructField("nodes", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("pairs", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(NODES)
def training_nodes(texts: pd.Series) -> pd.DataFrame:
    """Per text its nodes as [label, features...] and the codes (type, label, label) of its edges. What repeats a confirmed span
    without being one is left out: that the patterns miss it says nothing about it."""
    rows = []
    k = len(LABELS)
    for text in texts:
        nodes = nodes_of(text, base_spans(text)) if isinstance(text, str) and text else []
        confirmed = {key for n in nodes if n.label for key in n.keys}
        known = [bool(n.label) or confirmed.isdisjoint(n.keys) for n in nodes]
        rows.append(([[n.label, *n.features] for n, own in zip(nodes, known) if own],
                     [(t * k + nodes[i].label) * k + nodes[j].label for i, j, t in edges_of(nodes) if known[i] and known[j]]))
    return pd.DataFrame({"nodes": [r[0] for r in rows], "pairs": [r[1] for r in rows]})


def fit(docs: DataFrame) -> Field:
    """The field from about TRAINING_DOCS documents. Equal nodes and equal edges are counted before they reach the driver."""
    share = min(1.0, TRAINING_DOCS / max(1, docs.count()))
    sample = docs.where(sampled("doc_id", share)).select(training_nodes("text").alias("t"))
    nodes = sample.select(F.explode("t.nodes").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(TRAINING_DOCS).collect()
    edges = sample.select(F.explode("t.pairs").alias("p")).groupBy("p").count().collect()
    k = len(LABELS)
    pairs = np.zeros(3 * k * k)
    for row in edges:
        pairs[row["p"]] += row["count"]
    repeated = [(r["n"][0], tuple(r["n"][1:])) for r in nodes for _ in range(min(r["count"], 50))]
    return fit_field(repeated, pairs.reshape(3, k, k))


def label_texts(field: Broadcast):
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            nodes, edges, owners, found = [], [], [], []
            for t in texts:
                base = base_spans(t) if isinstance(t, str) and t else []
                own = nodes_of(t, base) if isinstance(t, str) and t else []
                edges += [(i + len(nodes), j + len(nodes), kind) for i, j, kind in edges_of(own)]
                owners += [len(found)] * len(own)
                nodes += own
                found.append([{"kind": k, "start": a, "end": b, "added": False} for k, a, b in base])
            if nodes:            # the documents of a batch are one graph without edges between them
                p = posteriors(field.value, nodes, np.array(edges, np.int64).reshape(-1, 3))
                for n, owner, best, sure in zip(nodes, owners, p.argmax(1), p.max(1)):
                    if not n.label and best and sure >= SURE:
                        found[owner].append({"kind": LABELS[best], "start": n.start, "end": n.end, "added": True})
            yield pd.Series([sorted(f, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"])) for f in found])

    return F.pandas_udf(label, FOUND)


def find_personal(docs: DataFrame, into: str = "found") -> DataFrame:
    """docs with the column `into`: spans (kind, start, end, added) of personal data, by kind and then start.

    Whole texts are read; null and empty ones have no spans. Spans that patterns confirm always stay; added ones do not overlap
    them. All other columns stay; one named like `into` is replaced. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(into, label_texts(docs.sparkSession.sparkContext.broadcast(fit(docs)))(F.col("text")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")      # noqa: E731
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")      # noqa: E731
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_added"))
