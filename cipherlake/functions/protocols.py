"""TLS and SSH bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cipher suites, extensions and groups by number; SSH key types (type, algorithm, whether quantum computers break it).
SUITES = [
    (0x1301, "TLS_AES_128_GCM_SHA256"), (0x1302, "TLS_AES_256_GCM_SHA384"), (0x1303, "TLS_CHACHA20_POLY1305_SHA256"), (0xC02B, "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256"), (0xC02C, "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384"), (0xC02F, "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256"), (0xC030, "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384"), (0xC027, "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256"), (0xC028, "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384"),
    (0xCCA8, "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256"), (0xCCA9, "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256"), (0x002F, "TLS_RSA_WITH_AES_128_CBC_SHA"), (0x0035, "TLS_RSA_WITH_AES_256_CBC_SHA"), (0x009C, "TLS_RSA_WITH_AES_128_GCM_SHA256"), (0x009D, "TLS_RSA_WITH_AES_256_GCM_SHA384"),
]
GROUPS = [(0x0017, "secp256r1"), (0x0018, "secp384r1"), (0x0019, "secp521r1"), (0x001D, "x25519"), (0x001E, "x448"), (0x0100, "ffdhe2048"), (0x0101, "ffdhe3072"), (0x6399, "X25519Kyber768Draft00"), (0x639A, "SecP256r1Kyber768Draft00"), (0x4588, "X25519MLKEM768")]
SSH_TYPES = [("ssh-rsa", "RSA", True), ("ssh-dss", "DSA", True), ("ecdsa-sha2-nistp256", "ECDSA-P256", True), ("ecdsa-sha2-nistp384", "ECDSA-P384", True), ("ecdsa-sha2-nistp521", "ECDSA-P521", True), ("ssh-ed25519", "Ed25519", True), ("ssh-ed448", "Ed448", True), ("sntrup761x25519-sha512@openssh.com", "SNTRUP761+X25519", False), ("sk-ssh-ed25519@openssh.com", "Ed25519-SK", True)]
#: Weight of a finding's risk in the system score.
WEIGHTS = {"CRITICAL": 0, "HIGH": 25, "MEDIUM": 60, "SAFE": 100, "INFO": 80}


def number(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian number of `size` bytes from the 0-based place `at`."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, 10).cast("long")


def name_of(table: list[tuple], value: Column) -> Column:
    """The table's name of a number, or Unknown(0x....)."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for row in table for x in row[:2])), value.cast("int"))
    return F.coalesce(found, F.concat(F.lit("Unknown(0x"), F.lpad(F.hex(value), 4, "0"), F.lit(")")))


def handshake(header: Column) -> Column:
    """struct(kind, length) of the four-byte handshake header."""
    return F.struct(number(header, 0, 1).alias("kind"), number(header, 1, 3).alias("length"))


def handshakes(headers: Column) -> Column:
    """struct(kind, length) of one message or several: the first kind, and the sum of the lengths of all four-byte headers in a row; null for null."""
    count = F.floor(F.length(headers) / 4).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: handshake(F.substring(headers, i * 4 + 1, F.lit(4))))
    return F.struct(each[0]["kind"].alias("kind"), F.aggregate(each, F.lit(0).cast("long"), lambda s, h: s + h["length"]).alias("length"))


def server_hello(body: Column) -> Column:
    """struct(version, session_id, suite, compression, extensions) of a ServerHello body; extensions as struct(kind, length), all that the list's own length holds."""
    session = number(body, 34, 1).cast("int")
    after = session + 35
    start = after + 5
    end = start + F.coalesce(number(body, after + 3, 2), F.lit(0)).cast("int")
    empty = F.array().cast("array<struct<kind: bigint, length: bigint>>")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), ((end - start) / 4).cast("int"))),  # an extension has four bytes at least
        F.struct(start.alias("at"), empty.alias("found")),
        lambda s, _: F.when(
            s["at"] + 4 <= end,
            F.struct((s["at"] + 4 + number(body, s["at"] + 2, 2)).cast("int").alias("at"), F.concat(s["found"], F.array(F.struct(number(body, s["at"], 2).alias("kind"), number(body, s["at"] + 2, 2).alias("length")))).alias("found")),
        ).otherwise(s),
    )
    return F.struct(number(body, 0, 2).alias("version"), F.lower(F.hex(F.substring(body, F.lit(36), session))).alias("session_id"), number(body, after, 2).alias("suite"), number(body, after + 2, 1).alias("compression"), walk["found"].alias("extensions"))


def suite_parts(name: Column) -> Column:
    """struct(version, key_exchange, authentication, encryption) of a suite's name; encryption is null where no known cipher is named."""
    new = name.startswith("TLS_AES") | name.startswith("TLS_CHACHA")
    has = name.contains
    kex = F.when(new, "key_share").when(has("ECDHE"), "ECDHE").when(has("DHE"), "DHE").otherwise("RSA")
    auth = F.when(new, "certificate").when(has("ECDSA"), "ECDSA").when(has("RSA"), "RSA")
    gcm = F.when(has("AES_128_GCM"), "AES-128-GCM").when(has("AES_256_GCM"), "AES-256-GCM")
    enc = F.when(new, F.coalesce(gcm, F.when(has("CHACHA20"), "ChaCha20-Poly1305"))).otherwise(F.coalesce(gcm, F.when(has("AES_128_CBC"), "AES-128-CBC").when(has("AES_256_CBC"), "AES-256-CBC").when(has("CHACHA20"), "ChaCha20-Poly1305")))
    return F.struct(F.when(new, "1.3").otherwise("1.2").alias("version"), kex.alias("key_exchange"), auth.alias("authentication"), enc.alias("encryption"))


def ssh_key_bits(kind: Column, blob: Column) -> Column:
    """Key size from a public key's type and blob: RSA's modulus without its leading zero byte, the curve's size, else 0."""
    e_at = number(blob, 0, 4).cast("int") + 4
    n_at = e_at + number(blob, e_at, 4).cast("int") + 4
    rsa = (number(blob, n_at, 4) - 1) * 8
    curve = F.regexp_extract(kind, r"nistp(\d+)$", 1)
    return F.coalesce(F.when(kind == "ssh-rsa", rsa).when(kind.contains("ecdsa"), F.coalesce(F.nullif(curve, F.lit("")).cast("long"), F.lit(256))).when(kind.contains("ed25519"), 256).when(kind.contains("ed448"), 448).when(kind.contains("sntrup"), 761).otherwise(0), F.lit(0)).cast("long")


def public_key(line: Column) -> Column:
    """struct(kind, algorithm, vulnerable, bits, comment) of a line of a public key file."""
    parts = F.split(F.trim(line), r"\s+", 3)
    kind, blob = F.get(parts, F.lit(0)), F.unbase64(F.get(parts, F.lit(1)))
    algorithm = F.try_element_at(F.create_map(*(F.lit(x) for k, a, _ in SSH_TYPES for x in (k, a))), kind)
    broken = F.try_element_at(F.create_map(*(F.lit(x) for k, _, b in SSH_TYPES for x in (k, b))), kind)
    return F.struct(kind.alias("kind"), algorithm.alias("algorithm"), broken.alias("vulnerable"), ssh_key_bits(kind, blob).alias("bits"), F.get(parts, F.lit(2)).alias("comment"))


def system_score(findings: DataFrame, by: str) -> DataFrame:
    """(by, score, grade) of findings with a risk: whole part of the mean weight."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("risk")), F.lit(50))
    out = findings.groupBy(by).agg(F.floor(F.sum(weight) / F.count("*")).cast("long").alias("score"))
    s = F.col("score")
    return out.select(by, "score", F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F").alias("grade"))
