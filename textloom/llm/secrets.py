"""Secret scan: patterns propose candidates, structure confirms them.

Base kinds (``assign``, ``access``, ``hex``) are pattern matches with a length rule.
Further kinds are reported only after structural confirmation:

* ``pem``: a PEM private key whose body decodes to a well-formed key, plain or sealed; of the
  older sealed form, whose body has no structure, the cipher and its start value;
* ``jwt``: three dot-joined parts whose first decodes to a JSON header with ``alg``;
* ``b64key`` / ``hexkey``: base64 or hex runs that decode to a DER private key whose
  nested lengths tile the value exactly, or to an OpenSSH key container whose
  length-prefixed fields parse to the end.

Null or empty text: no spans. Repeated rows give repeated results; an empty table gives
none. Offsets are code
points, end exclusive. Every pattern is anchored so that a scan stays linear in the
text's length; texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "b64key", "hexkey")

# The base patterns of the contract (letters of the names in either case).
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----((?:[^-]|-(?!----))*+)-----END \1PRIVATE KEY-----")
JWT = re.compile(
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
)
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEXRUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, "
    "base_sha256 string, spans string, n_confirmed long"
)


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of value, end of value) of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that tile ``data[at:end]``, or None if they don't."""
    out = []
    while at < end:
        if (x := _tlv(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def _tiles(data: bytes, at: int, end: int) -> bool:
    """One element fills ``data[at:end]``, and its parts fill it in turn if it is a sequence."""
    top = _tlv(data, at, end)
    if top is None or top[2] != end:
        return False
    return top[0] != 0x30 or bool(_children(data, top[1], top[2]))


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 or SEC1 layout with all nested lengths consistent."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and set(tags) == {0x02}:
        return True
    if len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:
        inner = _children(data, parts[1][1], parts[1][2])
        # The octets hold the key itself: a sequence, an octet string or a number of their length.
        return bool(inner) and inner[0][0] == 0x06 and data[parts[2][1] : parts[2][1] + 1] in (b"\x30", b"\x04", b"\x02") and _tiles(data, parts[2][1], parts[2][2])
    return len(parts) >= 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}


def is_sealed_key(data: bytes) -> bool:
    """PKCS#8's sealed layout: an algorithm (an object id and its parameters), then the sealed octets."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts or [p[0] for p in parts] != [0x30, 0x04] or parts[1][1] == parts[1][2]:
        return False
    inner = _children(data, parts[0][1], parts[0][2])
    return bool(inner) and inner[0][0] == 0x06 and all(x[0] != 0x30 or _children(data, x[1], x[2]) for x in inner[1:])


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: cipher, kdf, options, count, then count public keys and a blob."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= n <= 16 and all(field() for _ in range(n + 1)) and at == len(data)


def _is_key(data: bytes) -> bool:
    return is_der_private_key(data) or is_openssh_key(data)


def _from_base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_pem(label: str, body: str) -> bool:
    """Also with header lines and with the escapes of a string."""
    lines = re.sub(r"\\+[nr]", "\n", body).replace("\\/", "/").splitlines()
    heads = dict(x.split(":", 1) for x in lines if ":" in x)
    data = _from_base64("".join("".join(x for x in lines if ":" not in x).split()))
    if not data:
        return False
    if "ENCRYPTED" in heads.get("Proc-Type", ""):
        return re.fullmatch(r"\s*[A-Z0-9-]+,(?:[0-9A-Fa-f]{2})+\s*", heads.get("DEK-Info", "")) is not None
    return is_sealed_key(data) if "ENCRYPTED" in label else _is_key(data)


def _is_jwt(token: str) -> bool:
    head = _from_base64(token.split(".", 1)[0])
    try:
        head = json.loads(head or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in a text, ordered by start, then kind."""
    out = []
    lowered = text.lower()
    if any(x in lowered for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if _is_pem(m[1], m[2]):
                out.append((m.start(), 3, m.end()))
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in JWT.finditer(text) if _is_jwt(m[0])]
    for m in B64.finditer(text):
        if (body := _from_base64(m[0])) and _is_key(body):
            out.append((m.start(), 5, m.end()))
    for m in HEXRUN.finditer(text):
        if len(m[0]) % 2 == 0 and _is_key(bytes.fromhex(m[0])):
            out.append((m.start(), 6, m.end()))
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every secret replaced by ``mask``; overlapping spans become one."""
    parts, at = [], 0
    for a, _, b in find_spans(text):
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            spans = find_spans(text.as_py())
            base = [x for x in spans if x[1] < len(BASE_KINDS)]
            n = [sum(x[1] == k for x in base) for k in range(len(BASE_KINDS))]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*n, digest, _joined(spans), len(spans) - len(base)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by base kind, digest of base spans, all spans.

    Row-local: no shuffle, and a batch of texts in memory at most.
    """
    return texts(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs`` with secrets in the text masked; null texts stay null."""

    def mask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new = [None if (s := x.as_py()) is None else redact(s, mask) for x in batch.column(k)]
            cols = [pa.array(new, batch.schema.field(k).type) if i == k else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(mask_all, docs.schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def clean_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keeps every document and masks its secrets; n_chars follows the text."""
    out = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
