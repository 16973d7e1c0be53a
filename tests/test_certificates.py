"""Certificates built byte by byte, broken in each way, and real bundles against the reader of Python's ssl."""

import base64
import ssl
from pathlib import Path

import pytest

from cipherlake.functions import der
from cipherlake.operators import certificates
from cipherlake.sources import certificates as source


def node(tag, *parts):
    value = b"".join(parts)
    n = len(value)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + value


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = b""
    for arc in [first * 40 + second, *rest]:
        part = [arc & 127]
        while arc := arc >> 7:
            part.insert(0, arc & 127 | 128)
        out += bytes(part)
    return node(6, out)


def number(value):
    return node(2, value.to_bytes(value.bit_length() // 8 + 1, "big"))


def name(*pairs, tag=0x0C, coding="utf-8"):
    return node(0x30, *(node(0x31, node(0x30, oid(o), node(tag, v.encode(coding)))) for o, v in pairs))


RSA_KEY = node(0x30, node(0x30, oid("1.2.840.113549.1.1.1"), node(5)), node(3, b"\0", node(0x30, number((1 << 2047) + 1), number(65537))))
P521_KEY = node(0x30, node(0x30, oid("1.2.840.10045.2.1"), oid("1.3.132.0.35")), node(3, b"\0\4" + b"\1" * 132))
DSA_KEY = node(0x30, node(0x30, oid("1.2.840.10040.4.1"), node(0x30, number(1 << 1023), number(5), number(7))), node(3, b"\0", number(9)))
ODD_CURVE = node(0x30, node(0x30, oid("1.2.840.10045.2.1"), oid("1.2.3.4")), node(3, b"\0\4"))
TIMES = node(0x30, node(0x17, b"500101000000Z"), node(0x18, b"20500228235959Z"))


def certificate(key=RSA_KEY, subject=None, times=TIMES, version=True, signature="1.2.840.113549.1.1.11"):
    signed = node(0x30, oid(signature), node(5))
    body = node(0x30, node(0xA0, number(2)) if version else b"", number(77), signed, name(("2.5.4.3", "Root")), times, subject or name(("2.5.4.3", "x")), key)
    return node(0x30, body, signed, node(3, b"\0" + b"\7" * 256))


def test_keys_and_times():
    c = der.certificate(certificate())
    assert (c["algorithm"], c["key_size"], c["signature"], c["serial"]) == ("RSA", 2048, "RSA with SHA-256", "4d")
    assert (c["not_before"], c["not_after"], c["issuer"]) == ("1950-01-01T00:00:00+00:00", "2050-02-28T23:59:59+00:00", "CN=Root")
    for key, want in ((P521_KEY, ("ECDSA", 521)), (DSA_KEY, ("DSA", 1024)), (ODD_CURVE, ("Unknown", 0))):
        c = der.certificate(certificate(key, version=False, signature="1.2.9"))
        assert ((c["algorithm"], c["key_size"]), c["signature"]) == (want, "1.2.9")


def test_names():
    parts = name(("2.5.4.6", "DE"), ("2.5.4.97", "#1"), ("2.5.4.3", ' a,"b"+<c>;=\\d '))
    assert der.certificate(certificate(subject=parts))["subject"] == 'CN=\\ a\\,\\"b\\"\\+\\<c\\>\\;=\\\\d\\ ,2.5.4.97=\\#1,C=DE'
    assert der.certificate(certificate(subject=name(("2.5.4.3", "Ünï"), tag=0x1E, coding="utf-16-be")))["subject"] == "CN=Ünï"
    assert der.certificate(certificate(subject=name(("2.5.4.3", ""))))["subject"] == "CN="


BROKEN = {
    "empty": b"", "one byte": b"\x30", "short": certificate()[:-1], "behind": certificate() + b"\0", "endless": b"\x30\x80" + certificate()[4:] + b"\0\0",
    "long form": b"\x30\x84\0\0" + certificate()[2:4] + certificate()[4:], "text": b"not a certificate", "no month": certificate(times=node(0x30, node(0x17, b"501301000000Z"), node(0x17, b"500101000000Z"))),
    "no fields": node(0x30, node(0x30), node(0x30, oid("1.2.3")), node(3, b"\0")), "open oid": certificate().replace(oid("2.5.4.3"), b"\x06\x03\x55\x04\x83"), "five gigabytes": b"\x30\x85\1\1\1\1\1",
}


@pytest.mark.parametrize("data", BROKEN.values(), ids=BROKEN.keys())
def test_broken_certificates_are_refused(data):
    with pytest.raises((ValueError, IndexError)):
        der.certificate(data)


def test_every_cut_and_changed_byte_is_read_or_refused():
    whole = certificate(P521_KEY)
    for i in range(len(whole)):
        for data in (whole[:i], whole[:i] + bytes([whole[i] ^ 0x80]) + whole[i + 1 :]):
            try:
                der.certificate(data)
            except (ValueError, IndexError):
                pass


def pem(data):
    return b"-----BEGIN CERTIFICATE-----\r\n" + base64.encodebytes(data) + b"-----END CERTIFICATE-----\n"


def test_files_to_findings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "chain.PEM").write_bytes(b"\xff head\n" + pem(certificate()) + pem(b"junk") + b"-----BEGIN CERTIFICATE-----\n!!\n-----END CERTIFICATE-----\n" + pem(certificate(P521_KEY)))
    (tmp_path / "a" / "one.der").write_bytes(certificate(DSA_KEY))
    (tmp_path / "a" / "bad.cer").write_bytes(b"junk")
    (tmp_path / "a" / "none.crt").write_bytes(b"")
    (tmp_path / "a" / "key.txt").write_bytes(pem(certificate()))
    (tmp_path / "node_modules" / "c.crt").write_bytes(pem(certificate()))
    found = certificates.findings(source.read(source.split(source.walk(spark, str(tmp_path))))).orderBy("path", "place").collect()
    assert [(Path(r.path).name, r.place, r.algorithm, r.key_size, r.severity, r.replacement) for r in found] == [
        ("chain.PEM", 1, "RSA", 2048, "CRITICAL", "ML-KEM-768 or ML-DSA-65"), ("chain.PEM", 4, "ECDSA", 521, "CRITICAL", "ML-DSA-65"), ("one.der", 1, "DSA", 1024, "CRITICAL", "ML-DSA-65"),
    ]
    assert found[1].description == "ECDSA P-521 certificate key_size=521"
    assert source.walk(spark, str(tmp_path), max_files=2).count() == 2


def test_null_and_empty_rows(spark):
    rows = spark.createDataFrame([("a", None), (None, bytearray(certificate())), ("b", bytearray())], "path string, content binary")
    assert [(r.path, r.place, r.algorithm) for r in source.read(source.split(rows)).collect()] == [(None, 1, "RSA")]
    assert certificates.findings(source.read(source.split(rows.limit(0)))).count() == 0


def test_expiry(spark):
    rows = source.read(source.split(spark.createDataFrame([("a", bytearray(certificate()))], "path string, content binary")))
    assert certificates.expiring(rows, "2050-02-27", 1).first().days_left == 1
    assert certificates.expiring(rows, "2050-02-26", 1).count() == 0


def bundles():
    paths = [ssl.get_default_verify_paths().cafile, "/etc/ssl/certs/ca-certificates.crt"]
    try:
        from pip._vendor import certifi

        paths.append(certifi.where())
    except ImportError:
        pass
    return [p for p in paths if p and Path(p).exists()]


@pytest.mark.skipif(not bundles() or not hasattr(ssl, "_ssl"), reason="no bundle of real certificates")
def test_real_bundle(tmp_path):
    import re

    blocks = re.findall(r"-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----", Path(bundles()[0]).read_text("utf-8"), re.S)
    assert blocks
    for block in blocks:
        got = der.certificate(ssl.PEM_cert_to_DER_cert(block))
        (tmp_path / "c.pem").write_text(block)
        want = ssl._ssl._test_decode_cert(str(tmp_path / "c.pem"))
        assert int(got["serial"], 16) == int(want["serialNumber"], 16)
        from datetime import datetime

        assert datetime.fromisoformat(got["not_after"]).timestamp() == ssl.cert_time_to_seconds(want["notAfter"])
        assert got["algorithm"] in ("RSA", "ECDSA") and got["key_size"] in (2048, 4096, 256, 384, 521)
        common = [v for part in want["subject"] for k, v in part if k == "commonName"]
        assert all("CN=" + der._escaped(v) in got["subject"] for v in common)
