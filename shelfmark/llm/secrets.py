"""Secret scans: patterns for assignments, access keys and hex strings, and structural confirmation of encoded keys.

Runs of base64 or hex characters, also over several lines, are candidates only: all are decoded, from every start that
a key can have in them, and reported if the bytes hold a private key (nested DER lengths that fit exactly, or the
length-prefixed fields of an OpenSSH key) or an encoding of one, or the text a signed token (a JSON header that names
an algorithm, a JSON payload, and a signature). Patterns run over UTF-8 bytes; all
classes are ASCII, so positions are turned into code points by counting the bytes that begin one.
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

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "key", "token")

_ASSIGN = re.compile(
    rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # the maximal runs of 24 and more: a run is met at its first character
_MARK = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]{0,40})-----")
#: A line's end, written out or escaped as in a JSON string, with what may stand around it.
_BREAK = rb"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:" + _BREAK + rb"[A-Za-z0-9+/_-]+)*={0,2}")
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{16,}(?:" + _BREAK + rb"[0-9A-Fa-f]+)*")
_BREAKS = re.compile(_BREAK)
#: A place from which three parts of a token may be read; parts of names before the first belong to the run.
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
#: Where a JSON object begins in base64: a brace, or at the start of the run white space too.
_BRACE = re.compile(rb"e[w-z]|\A[CDI]")
#: The first bytes of a key: a SEQUENCE whose first element is a number or a SEQUENCE.
_KEY = re.compile(rb"0(?:[\x18-\x7f]|\x81.|\x82..|\x83...)[\x020]|openssh-key-v1\0", re.DOTALL)
#: Encodings of encodings are followed so deep.
NESTED = 3


def der_elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill data exactly; None if a length is not minimal or doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if tag & 0x1F == 0x1F:
            return None
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + size], "big"), at + size
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        content, at = data[at : at + length], at + length
        if tag & 0x20 and (depth >= 8 or der_elements(content, depth + 1) is None):
            return None
        out.append((tag, content))
    return out


def private_key(data: bytes) -> str | None:
    """The encoding of a private key that data is: rsa, ec, pkcs8, encrypted-pkcs8 or openssh."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(data[15:]) else None
    if len(data) < 24 or data[0] != 0x30:
        return None
    outer = der_elements(data)
    if outer is None or len(outer) != 1:
        return None
    inner = der_elements(outer[0][1]) or []
    tags = [t for t, _ in inner]
    if tags[:2] == [0x02, 0x02] and len(tags) >= 9 and set(tags[:9]) == {0x02} and inner[0][1] in (b"\0", b"\1"):
        return "rsa"
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec"
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][1] in (b"\0", b"\1") and (der_elements(inner[1][1]) or [(0, b"")])[0][0] == 0x06:
        return "pkcs8"
    if tags == [0x30, 0x04] and (der_elements(inner[0][1]) or [(0, b"")])[0][0] == 0x06:
        return "encrypted-pkcs8"
    return None


def _openssh(data: bytes) -> bool:
    """Whether the fields of an OpenSSH key fill data."""
    return _openssh_end(data) == len(data)


def _openssh_end(data: bytes) -> int:
    """The end of cipher, kdf and its options, the number of keys, that many public keys and the private part; -1 if they don't fit."""

    def field(at: int) -> int:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else -1
        return end if end <= len(data) else -1

    at = 0
    for _ in range(3):
        at = field(at)
        if at < 0:
            return -1
    number, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= number <= 16:
        return -1
    for _ in range(number + 1):
        at = field(at)
        if at < 0:
            return -1
    return at


def decoded(run: bytes) -> bytes | None:
    """Bytes of a base64 run, of either alphabet, with or without padding."""
    body = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def signed_token(text: bytes) -> bool:
    """Three base64 parts: a JSON header that names an algorithm, a JSON object, and a signature (none for "none")."""
    head, body, signature = text.split(b".")
    try:
        header, payload = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(payload, dict):
        return False
    return header["alg"] == "none" or len(decoded(signature) or b"") >= 16


def base_spans(data: bytes, low: bytes) -> list[tuple[str, int, int]]:
    """Spans in bytes of the three patterns, each leftmost and without overlap; low: data in lower case."""
    out = []
    if any(x in low for x in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(data) if len(m[1]) >= 6]
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(data)]
    return out


def _keys(data: bytes) -> list[tuple[int, int]]:
    """Start and end of the private keys in data, wherever they begin."""
    out, at = [], 0
    while m := _KEY.search(data, at):
        at = m.start()
        if data[at] == 0x30:
            n = data[at + 1]
            head = 2 + (n & 0x7F if n >= 0x80 else 0)
            end = at + head + (int.from_bytes(data[at + 2 : at + head], "big") if n >= 0x80 else n)
        else:
            size = _openssh_end(data[at + 15 :])
            end = at + 15 + size if size >= 0 else len(data) + 1
        if end <= len(data) and private_key(data[at:end]):
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def _found(raw: bytes, nested: int) -> list[tuple[str, int, int]]:
    """Keys, and encodings of keys and tokens, in decoded bytes."""
    out = [("key", a, b) for a, b in _keys(raw)]
    return out or (confirmed_spans(raw, nested - 1) if nested > 0 else [])


def _run_spans(run: bytes, nested: int) -> list[tuple[str, int, int]]:
    """Spans in a run without line ends: base64 is read from each of four starts, which meets every place in it."""
    body = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    out: list[tuple[str, int, int]] = []
    for k in range(4):
        part = body[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        for kind, a, b in _found(raw, nested):
            end = k + -(-b * 4 // 3)
            out.append((kind, k + a // 3 * 4 + a % 3, len(run) if end >= len(body) else end))
    return out


def _hex_spans(run: bytes, nested: int) -> list[tuple[str, int, int]]:
    out = []
    for k in range(2):
        raw = bytes.fromhex(run[k : len(run) - (len(run) - k) % 2].decode())
        out += [(kind, k + 2 * a, k + 2 * b) for kind, a, b in _found(raw, nested)]
    return out


def _runs(data: bytes, pattern: re.Pattern, spans, nested: int) -> list[tuple[str, int, int]]:
    """What spans finds in the runs of a pattern, at its places in data."""
    out = []
    for m in pattern.finditer(data):
        run = m[0]
        gaps = [g.span() for g in _BREAKS.finditer(run)]
        whole = _BREAKS.sub(b"", run) if gaps else run
        if len(whole) < 34:
            continue

        def place(i: int) -> int:
            for a, b in gaps:  # noqa: B023
                if i < a:
                    break
                i += b - a
            return m.start() + i  # noqa: B023

        out += [(kind, place(a), place(b - 1) + 1) for kind, a, b in spans(whole, nested)]
    return out


def confirmed_spans(data: bytes, nested: int = NESTED) -> list[tuple[str, int, int]]:
    """Spans in bytes of keys and tokens whose decoded structure holds; where some overlap, the first and longest."""
    out: list[tuple[str, int, int]] = []
    if b"-----BEGIN " in data:
        begun = None
        for m in _MARK.finditer(data):
            if m[1] == b"BEGIN":
                begun = m
            elif begun is not None and begun[2] == m[2]:
                inside = data[begun.end() : m.start()]
                text = inside.replace(b"\\r", b" ").replace(b"\\n", b" ").replace(b"\\/", b"/")
                body = b"".join(x for x in text.split() if b":" not in x and b"," not in x)
                if m[2].endswith(b"PRIVATE KEY") and (raw := decoded(body)) is not None and (private_key(raw) or b"ENCRYPTED" in data[begun.start() : m.start()] and len(raw) >= 64):
                    out.append(("key", begun.start(), m.end()))
                begun = None
    for m in _TOKEN.finditer(data):
        for e in _BRACE.finditer(m[1]):
            if signed_token(b".".join([m[1][e.start() :], m[2], m[3]])):
                out.append(("token", m.start(1) + e.start(), m.end(3)))
                break
    out += _runs(data, _RUN, _run_spans, nested)
    out += _runs(data, _HEX_RUN, _hex_spans, nested)
    kept: list[tuple[str, int, int]] = []
    for span in sorted(out, key=lambda x: (x[1], -x[2], x[0])):
        if not kept or span[1] >= kept[-1][2]:
            kept.append(span)
    return kept


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans in code points."""
    if data.isascii():
        return spans
    import numpy as np

    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(begins[i - 1]) if i else 0
    return [(k, at(a), at(b)) for k, a, b in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans = [], []
        for text in batch.column(1):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            base = base_spans(data, data.lower())
            more = confirmed_spans(data)
            base, more = _points(data, base), _points(data, more) if more else more
            for k in KINDS:
                counts[k].append(sum(1 for s in base if s[0] == k) + sum(1 for s in more if s[0] == k))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(base + more))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, n_key, n_token, base_sha256, spans.

    Spans are kind:start:end in code points, comma-joined by start and kind; base_sha256 is that of the first three
    kinds alone. Rows are independent: repeated rows, null identifiers and ties keep rows of their own; a null or empty
    text has no spans; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_key long, n_token long, base_sha256 string, spans string")
