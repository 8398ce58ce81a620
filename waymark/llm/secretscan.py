"""Secrets by patterns and by the structure of what encoded candidates decode to.

The patterns give the base spans. Beside them, runs of base64 or hex that could open with a key or a signed token are decoded and
parsed, and are reported only if the whole structure holds: every nested length of a private key in DER (PKCS#1, PKCS#8, SEC 1, DSA) or
in the length-prefixed OpenSSH form adds up, or a token's header and payload are JSON objects and the header names its algorithm.
Random runs, public keys, certificates and hashes do not parse and are left alone.

All patterns are ASCII, so that texts are searched as UTF-8 bytes and only spans are counted in code points.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, utf8

BASE = ("assign", "access", "hex")
#: What the structure confirms: a private key and a signed token.
ADDED = ("key", "token")
KINDS = (*BASE, *ADDED)

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")

#: An encoded key opens with a DER sequence (0x30), with the magic word of OpenSSH or with armour, and a token's header with a brace.
ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END \1-----")
BASE64_KEY = re.compile(rb"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]{22}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)[A-Za-z0-9+/]++(?:\r?\n[A-Za-z0-9+/]++)*+={0,2}")
HEX_KEY = re.compile(rb"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd])[0-9A-Fa-f]{30,}")
SIGNED = re.compile(rb"(?<![A-Za-z0-9_-])(e[w-z][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")

MAGIC = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OBJECT = 0x30, 0x02, 0x04, 0x06


# -- structures ------------------------------------------------------------------------------------------------------------


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value of the DER element at `at`, or None if its length does not fit before `end`."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None  # DER asks for the short form
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly, or None."""
    found = []
    while at < end:
        one = element(data, at, end)
        if not one or len(found) > 16:
            return None
        found.append(one)
        at = one[2]
    return found


def private_der(data: bytes, depth: int = 0) -> bool:
    """Whether data is one whole DER sequence with the members of a private key."""
    outer = element(data, 0, len(data))
    if not outer or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    inside = children(data, *outer[1:])
    if not inside or len(inside) < 2:
        return False
    tags = [t for t, *_ in inside]
    algorithm = lambda x: bool(parts := children(data, *x[1:])) and parts[0][0] == OBJECT
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:  # encrypted PKCS#8
        return algorithm(inside[0]) and inside[1][2] - inside[1][1] >= 16
    if tags[0] != INTEGER or inside[0][2] - inside[0][1] != 1 or data[inside[0][1]] > 1:
        return False
    version, rest = data[inside[0][1]], tags[1:]
    if rest[:2] == [SEQUENCE, OCTETS] and all(t in (0xA0, 0x81, 0xA1) for t in rest[2:]):  # PKCS#8 holds another encoding
        a, b = inside[2][1:]
        inner = element(data, a, b)
        return algorithm(inside[1]) and bool(inner) and inner[2] == b and (inner[0] == OCTETS or inner[0] == SEQUENCE and depth < 2 and private_der(data[a:b], depth + 1) or inner[0] == INTEGER)
    if version == 1 and rest[0] == OCTETS:  # SEC 1
        return 16 <= inside[1][2] - inside[1][1] <= 72 and all(t in (0xA0, 0xA1) for t in rest[1:])
    whole = all(b > a and (b - a == 1 or data[a] or data[a + 1] >= 0x80) for _, a, b in inside[1:])
    return version == 0 and whole and rest in ([INTEGER] * 8, [INTEGER] * 5)  # PKCS#1, DSA


def private_openssh(data: bytes) -> bool:
    """Whether data is a whole OpenSSH private key: magic word, three strings, number of keys, public keys, private part."""
    if not data.startswith(MAGIC):
        return False
    at, count = len(MAGIC), 1
    for field in range(5 + count):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if field == 3:
            if size != count:
                return False
            continue
        if at + size > len(data) or field == 0 and not re.fullmatch(rb"[\x21-\x7e]{1,64}", data[at : at + size]):
            return False
        last, at = size, at + size
    return at == len(data) and last >= 32 and last % 8 == 0


def private_key(data: bytes) -> bool:
    return private_openssh(data) if data.startswith(MAGIC) else private_der(data)


def unbase64(run: bytes) -> bytes | None:
    """What a run of base64 (either alphabet, padded or not) decodes to, or None."""
    bare = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(bare) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(bare + b"=" * (-len(bare) % 4), strict_mode=True)
    except binascii.Error:
        return None


def json_object(run: bytes) -> dict | None:
    data = unbase64(run)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: bytes, payload: bytes, signature: bytes) -> bool:
    """Whether the parts are those of a signed token in compact form; one that says that it is not signed has no secret."""
    said = json_object(header)
    return bool(said) and isinstance(said.get("alg"), str) and said["alg"].lower() not in ("", "none") and json_object(payload) is not None and len(unbase64(signature) or b"") >= 16


def _key_end(run: bytes) -> int | None:
    """Where the key that opens a run of base64 lines ends: at the end of one of its lines, after as many characters as its lengths ask for."""
    bare = b""
    first = unbase64(run[:12]) or b""
    outer = element(first + b"\0" * 8, 0, 1 << 40) if first[:1] == b"\x30" else None
    ends = [m.end() for m in re.finditer(rb"[A-Za-z0-9+/]+", run)]
    if outer:
        need, upto = -(-outer[2] * 4 // 3), 0
        for begin, end in zip([0, *ends], ends):
            bare += run[begin:end].strip()
            if len(bare) >= need:
                upto = end
                break
        if len(bare) != need or not private_key(unbase64(bare) or b""):
            return None
        return upto + len(re.match(rb"=*", run[upto:])[0])
    whole = unbase64(re.sub(rb"\s", b"", run)) or b""
    if private_key(whole) or b"-----BEGIN" in whole[:16] and any(armoured(m) for m in ARMOUR.finditer(whole)):
        return len(run)
    return None


def armoured(found: re.Match) -> bool:
    return private_key(unbase64(re.sub(rb"\s|\\[nr]", b"", found[2])) or b"")


# -- spans -------------------------------------------------------------------------------------------------------------------


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes."""
    spans, small = [], text.lower()
    if any(w in small for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of what decodes to a private key or is a signed token; of those that overlap, the first found by armour, token, base64, hex."""
    found = [("key", *m.span()) for m in ARMOUR.finditer(text) if armoured(m)]
    found += [("token", *m.span()) for m in SIGNED.finditer(text) if signed_token(*m.groups())]
    for m in BASE64_KEY.finditer(text):
        if end := _key_end(m[0]):
            found.append(("key", m.start(), m.start() + end))
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0].decode())):
            found.append(("key", *m.span()))
    kept: list[tuple[str, int, int]] = []
    last = -1
    order = {id(s): i for i, s in enumerate(found)}
    for s in sorted(found, key=lambda s: (s[1], order[id(s)])):
        if s[1] >= last:
            kept.append(s)
            last = s[2]
    return kept


def all_spans(text: bytes) -> tuple[list, list]:
    """Base and confirmed spans of a text, in code points."""
    base, more = base_spans(text), confirmed(text)
    if (base or more) and not text.isascii():
        upto = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        base, more = ([(k, int(upto[a]), int(upto[b])) for k, a, b in part] for part in (base, more))
    return base, more


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): base and all spans as kind:start:end (code points, end exclusive), by start and kind, comma-joined.

    A null text is an empty one and has no span. Rows with equal or null ids are judged one by one, each by its own text; an
    empty table gives an empty result; other columns are ignored, whatever their names. Time and memory are linear in a text's length.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [all_spans(t) for t in utf8(batch.column(1))]
            columns = [batch.column(0), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(b + m) for b, m in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "base", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base string, spans string")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end): one row for each span of spans()."""
    parts = F.split("span", ":")
    each = spans(docs, id_col, text_col).where("spans != ''").select("id", F.explode(F.split("spans", ",")).alias("span"))
    return each.select("id", parts[0].alias("kind"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))
