"""Op 13: secrets in whole texts: three kinds by pattern, and keys and signed tokens that their own structure confirms.

What looks like base64 or hex is decoded, and reported only if the bytes parse: a DER private key whose nested lengths add up, a key
container of length-prefixed fields, or a token whose header names its algorithm and whose signature has that algorithm's
length.  Encoded text is decoded and searched in turn.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import id_and_text, null_back, slices

KINDS = ("assign", "access", "hex", "private_key", "signed_token")
BASE = KINDS[:3]
ROWS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

# an encoded DER sequence (first byte 0x30), or the start of the container "openssh-key-v1"
_KEY_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))(?:M[A-P][A-Za-z0-9+/_-]{2}|b3BlbnNzaC1rZXktdjE)(?=[A-Za-z0-9+/_-])")
_KEY_TEXT = re.compile(r"([A-Za-z0-9+/_-]+)|[ \t]*(?:[\r\n]|\\[rn])+[ \t]*")  # encoded bytes, or line breaks, also escaped ones
LONGEST_KEY = 1 << 17  #: a key of over 100 KB is no key
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])30(?:[0-9a-f]{2}){31,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])30(?:[0-9A-F]{2}){31,}(?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){2,4}")
_ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_ENCODED_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){40,}(?![0-9A-Za-z])")

#: Bytes of a signature by algorithm; RSA's are as long as the key, 128 at least.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30  # fixed values: DER tags


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_size(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(where the content of the element at ``at`` begins, where it ends), if its length is in the shortest form."""
    if at + 2 > len(data):
        return None
    n = data[at + 1]
    if n < 0x80:
        return at + 2, at + 2 + n
    k = n & 0x7F
    size = int.from_bytes(data[at + 2 : at + 2 + k], "big")
    if not 1 <= k <= 4 or at + 2 + k > len(data) or size < 0x80 or size >> 8 * (k - 1) == 0:
        return None
    return at + 2 + k, at + 2 + k + size


def der_children(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the elements that fill these bytes exactly, each constructed one filled exactly by its own."""
    out = []
    while begin < end:
        size = der_size(data, begin)
        if size is None or size[1] > end:
            return None
        out.append((data[begin], *size))
        if data[begin] & 0x20 and der_children(data, *size) is None:
            return None
        begin = size[1]
    return out


def is_private_der(data: bytes) -> bool:
    """A private key: its integers alone, an elliptic curve's, in the common wrapping, or encrypted in it."""
    size = der_size(data)
    if not data or data[0] != SEQUENCE or size is None or size[1] != len(data):
        return False
    try:
        parts = der_children(data, *size)
    except RecursionError:
        return False
    if not parts:
        return False
    tags = [t for t, _, _ in parts]

    def algorithm(i: int) -> bool:
        inner = der_children(data, *parts[i][1:]) if tags[i] == SEQUENCE else None
        return bool(inner) and inner[0][0] == OID

    if tags[0] != INTEGER:
        return tags == [SEQUENCE, OCTETS] and algorithm(0) and parts[1][2] - parts[1][1] >= 16
    version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
    if set(tags) == {INTEGER}:  # RSA: version, n, e, d, p, q and three more; DSA: version, p, q, g, y, x
        big = max(e - b for _, b, e in parts) >= 64
        return version == 0 and len(tags) in (6, 9) and big and all(e > b and data[b] < 0x80 for _, b, e in parts)
    if tags[1:2] == [OCTETS]:  # an elliptic curve's
        return version == 1 and parts[1][2] - parts[1][1] >= 20 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and algorithm(1) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])


def container_size(data: bytes) -> int | None:
    """Bytes of a key container: magic, cipher, derivation and its options, the number of keys, public keys, private part."""
    at, fields = 15, []
    if not data.startswith(b"openssh-key-v1\0"):
        return None
    for k in range(3 + 1 + 1 + 1):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            if n != 1:
                return None
            continue
        if at + n > len(data):
            return None
        fields.append(data[at : at + n])
        at += n
    inner = fields[3]  # the public key is fields with lengths again, the first its type
    n = int.from_bytes(inner[:4], "big")
    whole = len(fields) == 5 and fields[0].isascii() and 4 + n <= len(inner) and inner[4 : 4 + n].isascii() and len(fields[4]) >= 8
    return at if whole else None


def key_at(text: str, start: int) -> int | None:
    """Where an encoded private key that begins at ``start`` ends: its own lengths say how far it goes; line breaks may stand inside."""
    pieces, known, at = [], 0, start
    while known < LONGEST_KEY and (m := _KEY_TEXT.match(text, at)):
        at = m.end()
        if m.lastindex:
            pieces.append(m)
            known += m.end() - m.start()
            if known < 8 or len(pieces) == 1 and not _has_length(m.group()):
                return None
    body = "".join(m.group() for m in pieces)
    data = unbase64(body[: len(body) - len(body) % 4]) or b""
    size = der_size(data) if data[:1] == bytes([SEQUENCE]) else container_size(data)
    need = -(-(size[1] if isinstance(size, tuple) else size) * 4 // 3) if size else 0
    data = unbase64(body[:need]) if 0 < need <= len(body) else None
    if not data or not (is_private_der(data) or container_size(data) == len(data)):
        return None
    for m in pieces:
        if need <= m.end() - m.start():
            end = m.start() + need
            break
        need -= m.end() - m.start()
    while end < len(text) and text[end] == "=":
        end += 1
    return end


def _has_length(begin: str) -> bool:
    """Whether the first bytes name a length that a key can have."""
    head = unbase64(begin[:8]) or b""
    size = der_size(head) if head[:1] == bytes([SEQUENCE]) else (0, 40)
    return size is not None and 40 <= size[1] <= LONGEST_KEY


def signed_end(m: re.Match) -> int | None:
    """Where a signed (three parts) or sealed (five) token ends, if its header and its signature's length say that it is one."""
    parts = m.group().split(".")
    head = unbase64(parts[0])
    try:
        header = json.loads(head) if head else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return None
    n = 5 if "enc" in header else 3
    body = [unbase64(p) for p in parts[1:n]]
    if len(parts) < n or None in body:
        return None
    signature, alg = len(body[-1]), header["alg"]
    fits = signature >= 12 if n == 5 else signature >= 128 if alg[:2] in ("RS", "PS") else signature == SIGNATURE[alg] if alg in SIGNATURE else signature >= 16 and alg != "none"
    return m.start() + sum(map(len, parts[:n])) + n - 1 if fits else None


def confirmed(text: str, depth: int = 3) -> list[tuple[str, int, int]]:
    """Keys and signed tokens of ``text``, also inside text that is itself encoded, at most ``depth`` times; the span is the outermost one's."""
    found, after = [], 0
    for m in _KEY_START.finditer(text):
        end = key_at(text, m.start()) if m.start() >= after else None
        if end:
            found.append(("private_key", m.start(), end))
            after = end
    found += [("private_key", m.start(), m.end()) for m in _HEX_KEY.finditer(text) if is_private_der(bytes.fromhex(m.group()))]
    for m in _TOKEN.finditer(text):
        end = signed_end(m)
        if end:
            found.append(("signed_token", m.start(), end))
    for pattern, decode in ((_ENCODED, unbase64), (_ENCODED_HEX, bytes.fromhex)) if depth else ():
        for m in pattern.finditer(text):
            data = decode(m.group())
            if data and data.isascii() and not any(s < m.end() and m.start() < e for _, s, e in found):
                inner = {k for k, _, _ in confirmed(data.decode("ascii"), depth - 1)}
                found += [(k, m.start(), m.end()) for k in sorted(inner)]
    return found


def by_pattern(text: str) -> list[tuple[str, int, int]]:
    """Assignments, access ids and hex strings: leftmost matches that don't overlap, those too short dropped after matching."""
    found = []
    if _KEYWORD.search(text):
        found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    return sorted(set(by_pattern(text) + confirmed(text)), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """The spans of all secrets of every whole text.

    A null or empty text has none; a null doc_id stays null; repeated rows give repeated results; spans of different kinds may
    overlap or begin together, then in the order of ``KINDS``; an empty table gives no rows; extra columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "spans": pd.Series(spans, dtype=object)})

    return null_back(id_and_text(docs).mapInPandas(run, ROWS))
