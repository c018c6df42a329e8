"""Secrets in texts: plain patterns, and encoded keys and signed tokens confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import read, small_batches

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")       # a run from AKIA that is too short holds no longer one
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]|\\+[nrt])++)-----END [A-Z0-9 ]*PRIVATE KEY-----")
BREAK = re.compile(r"(?:\s|\\+[nrt])+")         # white space, also escaped as in JSON or source text
KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")       # a DER sequence, the magic of OpenSSH
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
PADDING = re.compile(r"={0,2}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:={1,2})?")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
#: What follows a token's header; no payload, signature or header (20) of a token that is_signed_token takes is shorter.
SIGNED = re.compile(r"\.(?=([A-Za-z0-9_-]{3,})\.([A-Za-z0-9_-]{43,}))")
SIGNED_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Bytes that the signature of each algorithm holds; 0: any number above 31.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
                   "RS256": 0, "RS384": 0, "RS512": 0, "PS256": 0, "PS384": 0, "PS512": 0}

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def decode64(run: str) -> bytes | None:
    """Bytes of a standard or URL-safe base64 run, with or without padding."""
    run = run.translate({45: "+", 95: "/"}).rstrip("=")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True) if len(run) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill start..end exactly, or None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            length, at = int.from_bytes(data[at:at + width], "big"), at + width
            if length < 0x80:
                return None
        if at + length > end:
            return None
        out.append((tag, at, at + length))
        start = at + length
    return out


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA."""
    outer = elements(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inside = elements(data, *outer[0][1:])
    if not inside:
        return False
    tags = [e[0] for e in inside]
    if tags[0] == SEQUENCE:                                     # encrypted PKCS#8: algorithm, then octets
        algorithm = elements(data, *inside[0][1:])
        return tags == [SEQUENCE, OCTETS] and bool(algorithm) and algorithm[0][0] == OID and data[algorithm[0][1]:].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01\x05")
    if tags[0] != INTEGER or inside[0][2] - inside[0][1] != 1:
        return False
    version = data[inside[0][1]]
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9:            # RSA: version, modulus, ..., coefficient
        return version in (0, 1) and inside[1][2] - inside[1][1] >= 64
    if tags == [INTEGER] * 6:                                   # DSA: version, p, q, g, y, x
        return version == 0 and inside[1][2] - inside[1][1] >= 64
    if tags[1:3] == [SEQUENCE, OCTETS]:                         # PKCS#8: version, algorithm, key
        algorithm = elements(data, *inside[1][1:])
        return version in (0, 1) and bool(algorithm) and algorithm[0][0] == OID
    if len(tags) >= 2 and tags[1] == OCTETS:                    # SEC 1: version, key, [parameters], [public key]
        return version == 1 and inside[1][2] - inside[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return False


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key whose nested lengths end where the data do."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields, keys = len(magic), 0, None
    while at + 4 <= len(data):
        value = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if fields == 3:                                         # cipher, kdf, kdf options, then the number of keys
            keys = value
        else:
            at += value
        fields += 1
        if keys is not None and fields == 5 + keys:
            break
    return bool(keys) and fields == 5 + keys and at == len(data)


def key_kind(data: bytes | None) -> str | None:
    if not data or len(data) < 30:
        return None
    if data[0] == SEQUENCE and is_der_key(data):
        return "der"
    return "openssh" if is_openssh_key(data) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether the three parts are a JSON header that names a known algorithm, a JSON object and a signature of its length."""
    try:
        head, body = (json.loads(decode64(p) or b"") for p in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str) or head["alg"] not in SIGNATURE_BYTES:
        return False
    size = len(decode64(signature) or b"")
    return size == SIGNATURE_BYTES[head["alg"]] or not SIGNATURE_BYTES[head["alg"]] and size >= 64


def after_escape(text: str, at: int) -> bool:
    """Whether an escaped line end or tab stands right before a place."""
    return at >= 2 and text[at - 1] in "nrt" and text[at - 2] == "\\"


def openssh_size(data: bytes) -> int | None:
    """Where the fields of an OpenSSH private key end, which other data may follow."""
    at, left, fields = len(b"openssh-key-v1\0"), None, 0
    while left != 0 and at + 4 <= len(data):
        value = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if fields == 3:
            left = value + 1                                    # the public keys and the private part
        else:
            at += value
            left = left and left - 1
        fields += 1
    return at if left == 0 else None


def der_size(data: bytes) -> int | None:
    """Bytes of the DER sequence that begins here, if a version or an algorithm comes first in it."""
    if len(data) < 9:
        return None
    size, at = data[1], 2
    if size & 0x80:
        at += size & 0x7F
        if not 3 <= at <= 6:
            return None
        size = int.from_bytes(data[2:at], "big")
    return at + size if data[at] == SEQUENCE or data[at:at + 2] == b"\x02\x01" else None


def wrapped_key(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the base64 key that begins at start, over lines that white space or escaped line ends part. Its own lengths say
    where it ends; a line has to end there."""
    is_der, need, held, ends = text[start] == "M", None, 0, {}
    pieces: list[str] = []
    at = start
    while m := PIECE.match(text, at):
        pieces.append(m[0])
        held += len(m[0])
        ends[held] = m.end()
        if is_der and need is None and held >= 16:
            size = der_size(decode64("".join(pieces)[:16]) or b"")
            if size is None or size < 30:
                return None
            need = (size * 8 + 5) // 6
        gap = BREAK.match(text, m.end())
        if not gap or need is not None and held >= need:
            break
        at = gap.end()
    run = "".join(pieces)
    if not is_der and (size := openssh_size(decode64(run[:len(run) // 4 * 4]) or b"")):
        need = (size * 8 + 5) // 6
    if need not in ends or not (kind := key_kind(decode64(run[:need]))):
        return None
    return kind, PADDING.match(text, ends[need]).end()


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of signed tokens; what is left of a found one begins none."""
    out, done = [], 0
    for m in SIGNED.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in SIGNED_CHARACTERS:
            start -= 1
        starts = [start, start + 1] if after_escape(text, start + 1) else [start]
        for a in starts:
            if m.start() - a >= 20 and is_signed_token(text[a:m.start()], *m.groups()):
                out.append((a, m.end(2)))
                done = m.end(2)
                break
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and then kind; none in a null or empty text."""
    if not isinstance(text, str) or not text:
        return []
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if kind := key_kind(decode64(BREAK.sub("", m[1]))):
                out.append((kind, *m.span()))
                taken.append(m.span())
    for pattern, decode in ((BASE64, decode64), (HEX_BYTES, lambda run: bytes.fromhex(run) if len(run) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if not any(a <= m.start() < b for a, b in taken) and (kind := key_kind(decode(m[0]))):
                out.append((kind, *m.span()))
                taken.append(m.span())
    for m in KEY_START.finditer(text):
        if (not PIECE.match(text, max(0, m.start() - 1), m.start()) or after_escape(text, m.start())) and not any(a <= m.start() < b for a, b in taken):
            if key := wrapped_key(text, m.start()):
                out.append((key[0], m.start(), key[1]))
                taken.append((m.start(), key[1]))
    out += [("jwt", *span) for span in signed_tokens(text)]
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@F.pandas_udf(FOUND)
def find_secrets(texts: pd.Series) -> pd.Series:
    """All secrets of each text, by start and then kind, as code points with the end exclusive. Whole texts are read;
    null and empty ones give an empty array."""
    return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in find(t)])


def redacted(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with every run of overlapping spans replaced by the mark."""
    if not isinstance(text, str) or spans is None or not len(spans):
        return text
    out, run_end = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if not out or s["start"] >= run_end:
            out += [text[run_end:s["start"]], mark]
            run_end = s["end"]
        run_end = max(run_end, s["end"])
    return "".join([*out, text[run_end:]])


@F.pandas_udf(T.StringType())
def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without what the spans cover; a null text stays null."""
    return pd.Series([redacted(t, s) for t, s in zip(texts, spans)], dtype=object)


@F.pandas_udf(T.StringType())
def without_secrets(texts: pd.Series) -> pd.Series:
    """Texts that hold secrets, without them; null for all others. One pass, as every further one in a stage keeps a Python worker of its own."""
    spans = ([{"start": a, "end": b} for _, a, b in find(t)] for t in texts)
    return pd.Series([redacted(t, s) if s else None for t, s in zip(texts, spans)], dtype=object)


def span_list(spans: Column) -> Column:
    """kind:start:end of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = read(spark, sf_dir, "documents").select("doc_id", find_secrets("text").alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_confirmed"))
