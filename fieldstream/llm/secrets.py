"""Secret scanning with structural confirmation.

Three base patterns report by their form alone.  On top of them, runs that look
like base64, hex or dotted tokens are decoded, and reported only if what they
hold parses: nested ASN.1 lengths of a key, the length-prefixed fields of an SSH
key, the header of a signed token, or a PEM frame around one of these.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts

# The base patterns, least lengths, and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")

# A run is a candidate for decoding from this length on.
LEAST_BLOB = 40
BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{40,}")
# lines of a wrapped base64 text, without a frame
WRAPPED = re.compile(r"^[ \t]*[A-Za-z0-9+/]{40,128}(?:\r?\n[ \t]*[A-Za-z0-9+/]{1,128}={0,2}(?![A-Za-z0-9+/=]))+", re.MULTILINE)
# possessive, and only from the start of a run: linear in a long run without dots
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
# in a string of a program, line ends are written as a backslash and a letter
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:PRIVATE KEY|CERTIFICATE|PUBLIC KEY))-----((?:\s|\\[rn])*+(?:[A-Za-z-]++: [^\n\\]*+(?:\s|\\[rn])++)*+)((?:[A-Za-z0-9+/=\s]|\\[rn])*+)-----END \1-----")
# what a key file of the older form says of its encryption
LOCKED = re.compile(r"Proc-Type: 4,ENCRYPTED(?:\s|\\[rn])+DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})(?![0-9A-Fa-f])")
LINE_END = re.compile(r"\s|\\[rn]")
SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")
OPENSSH = b"openssh-key-v1\0"
SIGNING = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EDDSA"}


def unbase64(run: str) -> bytes | None:
    """The bytes of a base64 run, in either alphabet, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> int:
    """Number of ASN.1 items if ``data`` is exactly a series of well-formed ones, nested lengths included; else 0."""
    at = found = 0
    while at < len(data):
        tag, at = data[at], at + 1
        if at >= len(data) or tag & 31 == 31 or depth > 16:
            return 0
        size, at = data[at], at + 1
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return 0
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 128:
                return 0
        if at + size > len(data) or (tag == 2 and not size):
            return 0
        found += 1
        if tag & 32:
            inner = der_items(data[at : at + size], depth + 1)
            if size and not inner:
                return 0
            found += inner
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """One outer SEQUENCE that holds at least a version or algorithm and key material."""
    return len(data) >= 24 and data[:1] == b"\x30" and der_items(data) >= 4 and _outer_ends(data)


def _outer_ends(data: bytes) -> bool:
    n = data[1] & 127 if data[1] & 128 else 0
    size = int.from_bytes(data[2 : 2 + n], "big") if n else data[1]
    return 2 + n + size == len(data)


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields to the end, the first one a key type; or the frame of a private key file, whose public keys and private part end with it."""
    if data.startswith(OPENSSH):
        head = _ssh_fields(data[len(OPENSSH) :], 3)  # cipher, derivation of the key, its options
        if head is None:
            return False
        at = len(OPENSSH) + sum(4 + len(x) for x in head)
        n = int.from_bytes(data[at : at + 4], "big")
        rest = _ssh_fields(data[at + 4 :], None)
        return rest is not None and 1 <= n <= 64 and len(rest) == n + 1 and rest[0][4:].startswith(SSH_KINDS)
    fields = _ssh_fields(data, None)
    return bool(fields) and len(fields) >= 2 and fields[0].startswith(SSH_KINDS)


def _ssh_fields(data: bytes, most: int | None) -> list[bytes] | None:
    at, out = 0, []
    while at < len(data) and (most is None or len(out) < most):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out if most is None or len(out) == most else None


def _json_object(part: str) -> dict | None:
    data = unbase64(part) if len(part) >= 4 else None
    if not data or data.lstrip()[:1] != b"{":
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_tokens(run: str) -> Iterator[tuple[int, int]]:
    """Places in a dotted run of header.payload.signature: JSON objects in the first two, a known signing algorithm in the header."""
    parts, at = run.split("."), 0
    objects = [_json_object(p) for p in parts]
    for k, part in enumerate(parts[:-2]):
        header = objects[k]
        if header is not None and objects[k + 1] is not None and len(parts[k + 2]) >= 8 and str(header.get("alg", "")).upper() in SIGNING:
            yield at, at + len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 2
        at += len(part) + 1


def unframed(text: str) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, bytes) of base64 texts wrapped in lines of one length, the last one shorter perhaps; such a line may be the word that follows, so the text is given without it too."""
    for m in WRAPPED.finditer(text):
        lines, at, width, own = m[0].splitlines(keepends=True), m.start(), None, []
        for line in lines:
            body = line.strip()
            width = width or len(body)
            if len(body) <= width:
                own.append((at + line.index(body), at + line.index(body) + len(body), body))
            if len(body) != width:
                break
            at += len(line)
        for part in (own, own[:-1]) if len(own) > 1 and len(own[-1][2]) < width else (own,):
            if len(part) > 1:
                yield part[0][0], part[-1][1], unbase64("".join(b for _, _, b in part))


def confirmed(data: bytes | None) -> str | None:
    """The kind of key that decoded bytes hold."""
    if not data:
        return None
    if is_ssh_key(data):
        return "ssh"
    return "der" if is_der_key(data) else None


def framed_key(m: re.Match) -> bool:
    """Whether a PEM frame holds a key: bytes that parse, or an encrypted body of whole blocks."""
    data, locked = unbase64(LINE_END.sub("", m[3])), LOCKED.search(m[2])
    return bool(confirmed(data) or (locked and data and len(data) % (len(locked[1]) // 2) == 0))


def holds_pem(data: bytes | None) -> bool:
    """Whether decoded bytes are a text with a PEM frame around a key, as a file that was encoded once more."""
    if not data or b"-----BEGIN " not in data or not data.isascii():
        return False
    return any(map(framed_key, PEM.finditer(data.decode("ascii"))))


def may_end(run: str, start: int) -> bool:
    """Whether the lengths that a run has from ``start`` lead to its end: those of an outer ASN.1 sequence, or of up to 16 SSH fields.  Looks at a few bytes only."""

    def peek(at: int, n: int) -> bytes:
        part = run[start + at // 3 * 4 : start + -(-(at + n) // 3) * 4]
        return (unbase64(part) or b"")[at % 3 : at % 3 + n]

    total = (len(run) - start - (run.endswith("=") + run.endswith("=="))) * 3 // 4
    head = peek(0, 6)
    if head[:1] == b"\x30" and len(head) == 6:
        n = head[1] & 127 if head[1] & 128 else 0
        return n <= 4 and 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) == total
    at = 0
    for _ in range(16):
        at += 4 + int.from_bytes(peek(at, 4), "big")
        if at >= total:
            return at == total
    return False


def after_slashes(run: str) -> Iterator[int]:
    """Places behind a slash from which a run may hold a key, as at the end of a path."""
    at = run.find("/") + 1
    while at and len(run) - at >= LEAST_BLOB:
        if (run.startswith("M", at) or run.startswith("AAAA", at)) and may_end(run, at):
            yield at
        at = run.find("/", at) + 1


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of the confirmed ones; code points, end exclusive."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    hexes = [m.span() for m in HEX.finditer(text)]
    base += [(s, 2, e) for s, e in hexes]
    more = []
    for m in ANY_HEX.finditer(text):
        s, e = m.span()
        if (e - s) % 2 == 0 and (kind := confirmed(bytes.fromhex(m[0]))):
            more.append((s, KINDS.index(kind), e))
    framed = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if framed_key(m):
                framed.append(m.span())
                more.append((m.start(), 3, m.end()))
    for m in DOTTED.finditer(text):
        more += [(m.start() + s, 4, m.start() + e) for s, e in signed_tokens(m[0])]
    blobs = list(BLOB.finditer(text))
    for m in blobs:
        data = unbase64(m[0])
        if kind := confirmed(data) or ("pem" if holds_pem(data) else None):
            more.append((m.start(), KINDS.index(kind), m.end()))
        elif "/" in m[0]:
            for at in after_slashes(m[0]):
                if kind := confirmed(unbase64(m[0][at:])):
                    more.append((m.start() + at, KINDS.index(kind), m.end()))
                    break
    if blobs:
        for s, e, data in unframed(text):
            if (kind := confirmed(data) or ("pem" if holds_pem(data) else None)) and not any(a < e and s < b for a, b in framed):
                more.append((s, KINDS.index(kind), e))
    return sorted(base), sorted(set(more))


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(SPAN))])
    for batch in in_parts(batches):
        found = []
        for text in batch.column(1).to_pylist():
            base, more = scan(text)
            rows = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in more]
            found.append([{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, k, e, b in sorted(rows)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.types[1])], schema=schema)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (start, end, kind, base) by start, then kind.

    ``base`` marks the three base patterns; the others are confirmed by structure.
    A null or empty text has none; a very long one is scanned whole, in time that grows with its length.  Each row is scanned on its own: equal rows give
    equal rows, a null doc_id stays null, an empty table gives no rows.  Other columns are not read.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_run, "doc_id long, found array<struct<start: int, end: int, kind: string, base: boolean>>")
