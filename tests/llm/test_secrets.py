"""Op 13: the base patterns against a plain scan, keys and tokens against encodings built here."""

import base64
import hashlib
import json
import random
import re

import pytest

from scorebook.llm import queries, secret_scan


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(rng, n):
    return der(0x02, bytes([rng.randint(1, 127)]) + rng.randbytes(n - 1))


def field(b):
    return len(b).to_bytes(4, "big") + b


RNG = random.Random(9)
ZERO, ONE = der(0x02, b"\0"), der(0x02, b"\1")
RSA = der(0x30, ZERO, number(RNG, 256), der(0x02, b"\1\0\1"), *(number(RNG, 128) for _ in range(6)))
NAMED = der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")), der(0x05))
WRAPPED = der(0x30, ZERO, NAMED, der(0x04, RSA))
CURVE = der(0x30, ONE, der(0x04, RNG.randbytes(32)), der(0xA0, der(0x06, bytes.fromhex("2a8648ce3d030107"))))
SEALED = der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(0x04, RNG.randbytes(64)))
SHORT = der(0x30, ZERO, der(0x30, der(0x06, b"\x2b\x65\x70")), der(0x04, der(0x04, RNG.randbytes(32))))
PUBLIC = der(0x30, NAMED, der(0x03, b"\0" + der(0x30, number(RNG, 256), ONE)))
BOX = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(field(b"ssh-ed25519") + field(RNG.randbytes(32))) + field(RNG.randbytes(136))


def b64(data, lines=0, end="\n"):
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + lines] for i in range(0, len(text), lines)) if lines else text


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def token(alg, size, **more):
    return ".".join(url64(x) for x in (json.dumps({"alg": alg, "typ": "JWT", **more}).encode(), b'{"sub":"1"}', RNG.randbytes(size)))


def found(text):
    return [(k, text[s:e]) for k, s, e in secret_scan.scan(text) if k not in secret_scan.BASE]


@pytest.mark.parametrize("key", [RSA, WRAPPED, CURVE, SEALED, SHORT, BOX])
@pytest.mark.parametrize("lines,end", [(0, ""), (64, "\n"), (70, "\r\n"), (64, "\\n")])
def test_keys(key, lines, end):
    body = b64(key, lines, end)
    for before, after in (("", ""), ("naïve: ", " and more"), ("-----BEGIN PRIVATE KEY-----" + (end or "\n"), (end or "\n") + "-----END PRIVATE KEY-----"), ("k=", "\nnext line of words")):
        assert found(before + body + after) == [("private_key", body)]


def test_broken_keys_and_public_ones_are_none():
    for data in (PUBLIC, RSA[:-1], RSA[:40], der(0x30, ZERO, number(RNG, 256)), BOX[:-1], b"\x30\x82\x10\x00" + RNG.randbytes(500), der(0x30, ZERO, NAMED, der(0x03, RSA))):
        assert found(b64(data)) == [] and found(data.hex()) == []
    wrong = bytearray(RSA)
    wrong[5] ^= 1  # an inner length
    assert found(b64(bytes(wrong))) == []
    deep = b"\x30\x80" * 3000
    assert found(b64(deep)) == [] and found("MIIE" * 5000) == [] and found("MIIEpAIB\n" * 3000) == []


def test_hex_keys_and_nested_text():
    assert found("x " + RSA.hex() + " y") == [("private_key", RSA.hex())]
    assert found(CURVE.hex().upper()) == [("private_key", CURVE.hex().upper())]
    for inner, kind in ((token("HS256", 32), "signed_token"), ("-----BEGIN RSA PRIVATE KEY-----\n" + b64(RSA, 64) + "\n-----END RSA PRIVATE KEY-----\n", "private_key")):
        once = b64(("data: " + inner).encode())
        for text in (once, ("data: " + inner).encode().hex(), b64(once.encode())):
            assert found(f"see {text} there") == [(kind, text)]


def test_tokens():
    for alg, size in (("HS256", 32), ("HS512", 64), ("RS256", 256), ("ES384", 96), ("EdDSA", 64), ("own", 20)):
        t = token(alg, size)
        assert found(f"Bearer {t}. End.") == [("signed_token", t)]
    sealed = ".".join([url64(b'{"alg":"dir","enc":"A256GCM"}'), url64(b"k" * 20), url64(b"i" * 12), url64(b"c" * 40), url64(b"t" * 16)])
    assert found(f"<{sealed}>") == [("signed_token", sealed)]
    for t in (token("HS256", 31), token("none", 20), token("RS256", 64), "eyJhbGciOi.eyJzdWIi.c2ln", url64(b'["alg"]') + ".e30." + url64(bytes(32)), "eyJ" + "a" * 30 + ".b.c", ".".join(sealed.split(".")[:4])):
        assert found(f"x {t} y") == []


def plain(text):
    """The base rules as they read."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group()) >= n]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_query(spark, as_rows, tmp_path):
    rng = random.Random(4)
    parts = ["password", "PassWd ", "ſecret: abcdefgh1", "api_key", "APIKEY='", "token", " = ", ":", '"', " ", "abc", "12345678", "AKIA", "AKIAABCDEFGH1234", "0a" * 16, "deadbeef", "é🎉", "\n", "A" * 9, "secret=x token:yyyyyyyyy"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "word " * 60000 + 'token="abcdefgh"']
    texts += ["🎉 " + b64(WRAPPED, 64) + " api_key: " + token("HS256", 32), 'token = "' + token("HS256", 32) + '"']
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "secret: 12345678", 0), (7, texts[7], 0), (7, texts[7], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_secret_scan(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        base, r = plain(t or ""), by[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign:", "access:", "hex:")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in secret_scan.BASE] == base
        if i is not None and i < 303:
            assert spans == base
    assert by[303]["spans"].startswith("private_key:2:") and "signed_token" in by[303]["spans"] and by[304]["spans"].startswith("assign:0:")
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0
