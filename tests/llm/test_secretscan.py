import base64
import hashlib
import json
import random
import re

from waymark.llm import queries, secretscan

from .helpers import empty, hard, hard_rows

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    """Base spans, straight from the patterns over code points."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big"))
    return bytes([tag]) + size + body


def number(rng, size):
    return der(2, bytes([rng.randint(1, 127)]) + rng.randbytes(size - 1))


def keys(rng):
    rsa = der(0x30, der(2, b"\0"), *[number(rng, n) for n in (64, 3, 64, 32, 32, 32, 32, 32)])
    oid = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), b"\x05\x00")
    ec = der(0x30, der(2, b"\1"), der(4, rng.randbytes(32)), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
    text = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + text(b"none") + text(b"none") + text(b"") + (1).to_bytes(4, "big") + text(rng.randbytes(51)) + text(rng.randbytes(136))
    return {"rsa": rsa, "pkcs8": der(0x30, der(2, b"\0"), oid, der(4, rsa)), "ed": der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, rng.randbytes(32)))), "ec": ec, "ssh": ssh,
            "dsa": der(0x30, der(2, b"\0"), *[number(rng, n) for n in (64, 20, 64, 64, 20)]), "locked": der(0x30, oid, der(4, rng.randbytes(64)))}


def wrapped(data, width=64):
    s = base64.b64encode(data).decode()
    return "\n".join(s[i : i + width] for i in range(0, len(s), width))


def jwt(rng, header):
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return ".".join([part(json.dumps(header).encode()), part(json.dumps({"sub": "1", "n": rng.randint(1, 9**9)}).encode()), part(rng.randbytes(32))])


def added(text):
    return secretscan.all_spans(text.encode())[1]


def test_patterns_against_brute_force():
    rng = random.Random(1)
    bits = ["password", "PASSWD", "Secret", "toKen", "api_key", "APIKEY", "apikey", "paſſword", "toKen", '"', "'", " ", "   ", ":", "=", "==", "abc", "abcdef", "12345", "AKIA", "AKIA" + "X" * 15, "AKIA" + "Q7" * 8, "0a" * 11, "0a" * 12, "f", "É", "😀", "\n", "\t", ".", "-", "/+", "Z"]
    for _ in range(30_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert secretscan.joined(secretscan.all_spans(text.encode())[0]) == secretscan.joined(brute(text)), text


def test_keys_in_every_encoding():
    rng = random.Random(2)
    for _ in range(20):
        for name, data in keys(rng).items():
            one = base64.b64encode(data).decode()
            armour = f"-----BEGIN {'OPENSSH ' if name == 'ssh' else ''}PRIVATE KEY-----\n{wrapped(data)}\n-----END {'OPENSSH ' if name == 'ssh' else ''}PRIVATE KEY-----"
            for body in (one, wrapped(data), wrapped(data, 76), data.hex(), data.hex().upper(), armour, armour.replace("\n", "\\n"), base64.b64encode(armour.encode()).decode()):
                for before, after in (("", ""), ("é key=", " and on"), ('"', '"\nnext line'), ("text\n", "\n\nmore")):
                    text = before + body + after
                    assert added(text) == [("key", len(before), len(before) + len(body))], (name, text[:60])


def test_broken_structures_are_left_alone():
    rng = random.Random(3)
    for _ in range(40):
        for data in keys(rng).values():
            for bad in (data[:-1], data + b"\0", data[:1] + bytes([data[1] ^ 1]) + data[2:], b"\x31" + data[1:], data[:-9] + rng.randbytes(2)):
                assert not added(base64.b64encode(bad).decode()) and not added(bad.hex())
        public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), b"\x05\x00"), der(3, b"\0" + rng.randbytes(70)))
        assert not added(base64.b64encode(public).decode()) and not added(f"-----BEGIN PUBLIC KEY-----\n{wrapped(public)}\n-----END PUBLIC KEY-----")
        assert not added("M" + base64.b64encode(rng.randbytes(rng.randint(30, 600))).decode()) and not added("30" + rng.randbytes(60).hex())


def test_signed_tokens():
    rng = random.Random(4)
    good = jwt(rng, {"alg": "HS256", "typ": "JWT"})
    assert added(f"Bearer {good}, then") == [("token", 7, 7 + len(good))]
    assert not added(jwt(rng, {"alg": "none"})) and not added(jwt(rng, {"typ": "JWT"})) and not added(good.rsplit(".", 1)[0] + ".") and not added("eyJhbGciOi.eyJhbGciOi.eyJhbGciOi")
    assert not added(good.replace(".", ".x", 1))


def test_operator(spark):
    rows = secretscan.spans(hard(spark)).collect()
    assert sorted((r.id is None, r.id or 0, r.base) for r in rows) == sorted((k is None, k or 0, secretscan.joined(brute(t or ""))) for k, t, *_ in hard_rows())
    assert secretscan.spans(empty(spark)).count() == 0 and secretscan.findings(empty(spark)).count() == 0
    data = keys(random.Random(5))["rsa"]
    df = spark.createDataFrame([(1, "ü password=hunter22 " + data.hex()), (1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in secretscan.findings(df).collect()) == [(1, "assign", 2, 19), (1, "hex", 20, 20 + 2 * len(data)), (1, "key", 20, 20 + 2 * len(data))]


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("M" * 2_000_000, "eyJ." * 500_000, "-----BEGIN PRIVATE KEY-----" * 70_000, "password" * 250_000, "30" * 1_000_000, "AKIA" * 500_000, "M" + "A" * 63 + ("\n" + "A" * 64) * 20_000, "token" + " " * 2_000_000, "eyJ" + "a" * 2_000_000):
        secretscan.all_spans(text.encode())
    assert time.time() - began < 30


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op12_structural_confirmation(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secretscan.joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for kind, *_ in base) for k in secretscan.BASE]
        assert set(filter(None, secretscan.joined(base).split(","))) <= set(r.spans.split(","))
