"""Secret scans with structural confirmation.

Base candidates (assignments to a credential name, access key ids, hex runs)
are always reported. Further candidates count only after their structure is
parsed:

* ``key``   - PEM of a private key: base64 that decodes to a private key's DER (below) or to
  the fields of an ``openssh-key-v1`` key, or, behind the header lines of an encrypted key,
  to whole cipher blocks;
* ``jwt``   - three base64url parts, the first a JSON header with ``alg``, the
  second a JSON object;
* ``ssh``   - an unmarked base64 run of the fields of an ``openssh-key-v1`` key, their
  nested lengths exact;
* ``der``   - an unmarked base64, base64url or hex run (64 characters or more) that decodes to
  a private key's DER: one SEQUENCE over all bytes whose nested lengths add up exactly at
  every level, laid out as a private key (a small version number, then the rest; or an
  algorithm and an OCTET STRING, encrypted).

Public keys and certificates are laid out otherwise and are no secrets.

Spans are code points, end exclusive. A null text is empty; an empty table
gives an empty result; repeated rows are scanned alike; other columns do not
matter. Texts are scanned whole, a very long one alone in its batch.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded_batches, documents
from ._words import slabs

#: Fixed values of the base scan: kind, pattern, least length of the tested group, the group.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16, 0),
)
ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", "key", "jwt", "ssh", "der"))}
#: Credential words start an assignment; text without any of their rarer middles has none.
NAMES = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*|\s*Proc-Type: [0-9],ENCRYPTED\r?\nDEK-Info: ([A-Za-z0-9-]+),[0-9A-Fa-f]+\s([A-Za-z0-9+/=\s]*))-----END \1-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Base64 of ``openssh-key-v1`` and a zero byte.
OPENSSH = b"openssh-key-v1\0"
SSH = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{40,}={0,2}")
#: Levels of DER that are read; keys have fewer.
DEPTH = 16
#: Maximal base64 and base64url runs whose first byte can be that of a SEQUENCE (0x30); DER decides. The leading letter lets the matcher skip to it.
BLOBS = ((re.compile(r"M(?<![A-Za-z0-9+/]M)[A-Za-z0-9+/]{61,}={0,2}"), False), (re.compile(r"M(?<![A-Za-z0-9_-]M)[A-Za-z0-9_-]{61,}={0,2}"), True))
LEAST_BLOB = 64
HEX_DER = re.compile(r"(?<![0-9a-fA-F])30[0-9a-fA-F]{62,}")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content end) of the element at ``at``."""
    if at + 2 > len(data):
        return None
    first = data[at + 1]
    if first < 0x80:
        begin, size = at + 2, first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + 2 + n > len(data):
            return None
        begin, size = at + 2 + n, int.from_bytes(data[at + 2 : at + 2 + n], "big")
    return (begin, begin + size) if begin + size <= len(data) else None


def der_elements(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the elements that make up ``begin``:``end``, if they do so exactly."""
    out, at = [], begin
    while at < end:
        inner = der_length(data, at)
        if not inner or inner[1] > end:
            return None
        out.append((data[at], *inner))
        at = inner[1]
    return out


def is_nested(data: bytes, begin: int, end: int, depth: int = DEPTH) -> bool:
    """Whether the lengths of all elements add up at every level below."""
    found = der_elements(data, begin, end)
    return found is not None and all(depth > 0 and is_nested(data, a, b, depth - 1) for tag, a, b in found if tag & 0x20)


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE over all bytes, its lengths exact to the bottom, laid out as a private key."""
    whole = der_elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not whole or len(whole) != 1 or not is_nested(data, 0, len(data)):
        return False
    parts = der_elements(data, *whole[0][1:])
    if len(parts) < 2:
        return False
    (tag, a, b), second = parts[0], parts[1]
    if tag == 0x02:  # a version, then a key: INTEGERs, an OCTET STRING, or an algorithm and an OCTET STRING
        plain = all(p[0] == 0x02 for p in parts[1:]) and len(parts) >= 6
        return b - a == 1 and data[a] <= 3 and (plain or second[0] == 0x04 or (second[0] == 0x30 and len(parts) > 2 and parts[2][0] == 0x04))
    return tag == 0x30 and data[a : a + 1] == b"\x06" and len(parts) == 2 and second[0] == 0x04


def decode64(text: str, url: bool = False) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    text += "=" * (-len(text) % 4)
    try:
        return base64.b64decode(text, altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_jwt(header: str, body: str) -> bool:
    try:
        head, claims = (json.loads(decode64(x, url=True) or b"") for x in (header, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def ssh_fields(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """``n`` length-prefixed fields from ``at`` on and the place behind them."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def is_ssh_key(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, that many public keys and the private part, over all bytes; a public key is fields as well."""
    head = ssh_fields(data, len(OPENSSH), 3) if data.startswith(OPENSSH) else None
    if not head or head[1] + 4 > len(data):
        return False
    keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
    rest = ssh_fields(data, head[1] + 4, keys + 1) if 1 <= keys <= 64 else None
    if not rest or rest[1] != len(data) or len(rest[0][-1]) % 8:
        return False
    kinds = [ssh_fields(k, 0, 1) for k in rest[0][:-1]]
    return all(k and k[0][0].startswith((b"ssh-", b"ecdsa-", b"sk-")) for k in kinds)


def is_pem_key(m: re.Match) -> bool:
    """Whether the body between PEM markers is a private key."""
    data = decode64(m[4] if m[3] else m[2])
    if not data:
        return False
    if m[3]:
        return len(data) >= 32 and len(data) % (8 if m[3].startswith("DES") else 16) == 0
    return is_der_key(data) or is_ssh_key(data)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, pattern, least, group in BASE:
        if kind == "assign" and not NAMES.search(text):
            continue
        found += [(*m.span(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "-----BEGIN " in text:
        found += [(*m.span(), "key") for m in PEM.finditer(text) if is_pem_key(m)]
    if "eyJ" in text:
        found += [(*m.span(), "jwt") for m in JWT.finditer(text) if is_jwt(m[1], m[2])]
    if "b3BlbnNzaC1rZXktdjE" in text:
        found += [(*m.span(), "ssh") for m in SSH.finditer(text) if (d := decode64(m[0])) and is_ssh_key(d)]
    # A run of letters and digits alone is one of both alphabets, and counts once.
    found += sorted({(*m.span(), "der") for blob, url in BLOBS for m in blob.finditer(text) if len(m[0]) >= LEAST_BLOB and (d := decode64(m[0], url)) and is_der_key(d)})
    if "30" in text:
        found += [(*m.span(), "der") for m in HEX_DER.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
    return [x for x in found if x[2] not in ("der", "ssh") or not any(k == "key" and s <= x[0] < e for s, e, k in found)]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    order = lambda x: (x[0], ORDER[x[2]], x[1])
    return sorted(base, key=order), sorted(base + confirmed_spans(text), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None) -> str | None:
    """Every span replaced by ``[secret]``, overlapping ones together; the text itself where none is found."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind: string, start: long, end: long>>"


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``base`` and ``found``, arrays of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "__text"):
            both = [scan(x.as_py()) for x in batch.column(len(keep))]
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *lists], [*keep, "base", "found"])

    bounded_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kept}, base {SPANS}, found {SPANS}")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir, "doc_id", "text"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every found secret cut out; clean texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, most=1 << 20):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([redact(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type))

    bounded_batches(spark)
    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
