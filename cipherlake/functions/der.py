"""X.509 certificates in DER: a reader of nested (tag, length, value) items and the fields that a scan asks for.

Only what DER allows is read: definite, shortest lengths that stay inside their parent, and nothing behind
the certificate. Anything else is a ValueError, which the scan passes over.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

INTEGER, BITS, OID, UTC_TIME, LONG_TIME, SEQUENCE, SET = 0x02, 0x03, 0x06, 0x17, 0x18, 0x30, 0x31
VERSION = 0xA0

# Object identifiers of keys, curves, signatures and name parts.
RSA_KEYS = {"1.2.840.113549.1.1.1", "1.2.840.113549.1.1.10"}
EC_KEY, DSA_KEY, ED25519_KEY = "1.2.840.10045.2.1", "1.2.840.10040.4.1", "1.3.101.112"
CURVES = {
    "1.2.840.10045.3.1.1": 192, "1.3.132.0.33": 224, "1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.10": 256,
    "1.3.36.3.3.2.8.1.1.7": 256, "1.3.36.3.3.2.8.1.1.11": 384, "1.3.36.3.3.2.8.1.1.13": 512,
}
SIGNATURES = {
    "1.2.840.113549.1.1.4": "RSA with MD5", "1.2.840.113549.1.1.5": "RSA with SHA-1", "1.2.840.113549.1.1.10": "RSA-PSS", "1.2.840.113549.1.1.11": "RSA with SHA-256", "1.2.840.113549.1.1.12": "RSA with SHA-384", "1.2.840.113549.1.1.13": "RSA with SHA-512",
    "1.2.840.10045.4.1": "ECDSA with SHA-1", "1.2.840.10045.4.3.2": "ECDSA with SHA-256", "1.2.840.10045.4.3.3": "ECDSA with SHA-384", "1.2.840.10045.4.3.4": "ECDSA with SHA-512",
    "1.2.840.10040.4.3": "DSA with SHA-1", "2.16.840.1.101.3.4.3.2": "DSA with SHA-256", "1.3.101.112": "Ed25519",
    "2.16.840.1.101.3.4.3.17": "ML-DSA-44", "2.16.840.1.101.3.4.3.18": "ML-DSA-65", "2.16.840.1.101.3.4.3.19": "ML-DSA-87",
}
NAME_PARTS = {"2.5.4.3": "CN", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.6": "C", "2.5.4.9": "STREET", "0.9.2342.19200300.100.1.25": "DC", "0.9.2342.19200300.100.1.1": "UID"}
#: String types by tag: UTF-8, printable, T61, IA5, universal (4 bytes), BMP (2 bytes).
STRINGS = {0x0C: "utf-8", 0x13: "ascii", 0x14: "latin-1", 0x16: "ascii", 0x1C: "utf-32-be", 0x1E: "utf-16-be"}


def item(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(tag, start, stop) of the item at `at`: its value is data[start:stop], the next item begins at stop."""
    if end - at < 2:
        raise ValueError("no item")
    tag, length, start = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        raise ValueError("tag of several bytes")
    if length & 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or end - start < size or data[start] == 0:
            raise ValueError("length")
        length = int.from_bytes(data[start : start + size], "big")
        if length < 0x80:
            raise ValueError("length not the shortest")
        start += size
    if length > end - start:
        raise ValueError("item beyond its parent")
    return tag, start, start + length


def items(data: bytes, start: int, stop: int) -> list[tuple[int, int, int]]:
    """All items of a value, one after the other."""
    out = []
    while start < stop:
        out.append(item(data, start, stop))
        start = out[-1][2]
    return out


def _inside(data: bytes, of: tuple[int, int, int], tag: int) -> list[tuple[int, int, int]]:
    if of[0] != tag:
        raise ValueError("tag")
    return items(data, of[1], of[2])


def _value(data: bytes, of: tuple[int, int, int], tag: int) -> bytes:
    if of[0] != tag or of[1] == of[2]:
        raise ValueError("tag or empty value")
    return data[of[1] : of[2]]


@lru_cache(4096)
def _dotted(value: bytes) -> str:
    if value[-1] & 0x80:
        raise ValueError("object identifier")
    arcs, held = [], 0
    for byte in value:
        held = held << 7 | byte & 0x7F
        if not byte & 0x80:
            arcs.append(held)
            held = 0
    first = min(arcs[0] // 40, 2)
    return ".".join(map(str, [first, arcs[0] - 40 * first, *arcs[1:]]))


def _oid(data: bytes, of: tuple[int, int, int]) -> str:
    return _dotted(_value(data, of, OID))


@lru_cache(65536)
def _moment(tag: int, value: bytes) -> str:
    text = value.decode("ascii")
    if tag == UTC_TIME:
        text = ("19" if text[:2] >= "50" else "20") + text
    elif tag != LONG_TIME:
        raise ValueError("time")
    if len(text) != 15 or not text[:14].isdigit() or text[14] != "Z":
        raise ValueError("time")
    return datetime(int(text[:4]), *(int(text[i : i + 2]) for i in range(4, 14, 2)), tzinfo=timezone.utc).isoformat()


def _time(data: bytes, of: tuple[int, int, int]) -> str:
    return _moment(of[0], _value(data, of, of[0]))


_ESCAPES = str.maketrans({c: "\\" + c for c in '\\"+,;<>'} | {"\0": "\\00"})


def _escaped(text: str) -> str:
    """A value inside a name of one line (RFC 4514)."""
    out = text.translate(_ESCAPES)
    if out[:1] in ("#", " "):
        out = "\\" + out
    if len(text) > 1 and out[-1] == " ":
        out = out[:-1] + "\\ "
    return out


def _name(data: bytes, of: tuple[int, int, int]) -> str:
    """Parts from last to first, several values of one part joined by +."""
    parts = []
    for part in _inside(data, of, SEQUENCE):
        pairs = []
        for pair in _inside(data, part, SET):
            kind, value = _inside(data, pair, SEQUENCE)
            if value[0] not in STRINGS:
                raise ValueError("string type")
            oid = _oid(data, kind)
            pairs.append(NAME_PARTS.get(oid, oid) + "=" + _escaped(data[value[1] : value[2]].decode(STRINGS[value[0]])))
        parts.append("+".join(pairs))
    return ",".join(reversed(parts))


def _bits_of(number: bytes) -> int:
    return int.from_bytes(number, "big").bit_length()


def _key(data: bytes, of: tuple[int, int, int]) -> tuple[str, int]:
    """(algorithm, size in bits) of a public key; a key of another kind, or on a curve without a known size, is Unknown."""
    kind, bits = _inside(data, of, SEQUENCE)
    form = _inside(data, kind, SEQUENCE)
    oid, start = _oid(data, form[0]), bits[1] + 1
    if _value(data, bits, BITS)[0] != 0:
        raise ValueError("bits left over")
    if oid in RSA_KEYS:
        return "RSA", _bits_of(_value(data, _inside(data, item(data, start, bits[2]), SEQUENCE)[0], INTEGER))
    if oid == EC_KEY and len(form) > 1 and form[1][0] == OID and _oid(data, form[1]) in CURVES:
        return "ECDSA", CURVES[_oid(data, form[1])]
    if oid == ED25519_KEY:
        return "Ed25519", 256
    if oid == DSA_KEY and len(form) > 1:
        return "DSA", _bits_of(_value(data, _inside(data, form[1], SEQUENCE)[0], INTEGER))
    return "Unknown", 0


def certificate(data: bytes) -> dict:
    """subject, issuer, serial (hexadecimal), not_before, not_after, algorithm, key_size and signature of one certificate."""
    whole = item(data, 0, len(data))
    if whole[2] != len(data):
        raise ValueError("bytes behind the certificate")
    body, signed, _ = _inside(data, whole, SEQUENCE)
    fields = _inside(data, body, SEQUENCE)
    if fields and fields[0][0] == VERSION:
        fields = fields[1:]
    if len(fields) < 6:
        raise ValueError("fields missing")
    serial, _, issuer, validity, subject, key = fields[:6]
    begin, end = _inside(data, validity, SEQUENCE)
    algorithm, size = _key(data, key)
    oid = _oid(data, _inside(data, signed, SEQUENCE)[0])
    return {
        "subject": _name(data, subject), "issuer": _name(data, issuer), "serial": _value(data, serial, INTEGER).hex(),
        "not_before": _time(data, begin), "not_after": _time(data, end), "algorithm": algorithm, "key_size": size, "signature": SIGNATURES.get(oid, oid),
    }
