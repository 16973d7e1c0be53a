"""Infrastructure files and how far packages are reached."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of infrastructure files (pattern, algorithm, severity, category), matched whatever the case.
INFRASTRUCTURE = [
    (r"tls_version\s*=\s*[\"']?(TLS1\.0|TLSv1\.0|TLS1\.1|TLSv1\.1|SSLv3)", "Old TLS", "HIGH", "protocol"),
    (r"cipher[_\s]?suites?.*(?:RC4|DES|3DES|NULL|EXPORT|anon)", "Weak cipher", "HIGH", "protocol"),
    (r"key_algorithm\s*=\s*[\"']?RSA", "RSA", "CRITICAL", "key_exchange"),
    (r"algorithm\s*=\s*[\"']?RSA", "RSA", "CRITICAL", "key_exchange"),
    (r"resource\s+\"tls_private_key\".*\{", "RSA", "HIGH", "key_exchange"),
    (r"ssh[_-]key[_-]type\s*[:=]\s*[\"']?rsa", "RSA", "HIGH", "key_exchange"),
    (r"(?:ENV|ARG)\s+.*(?:CIPHER|TLS|SSL).*(?:RC4|DES|MD5|SHA1)", "Weak cipher", "HIGH", "protocol"),
    (r"algorithm:\s*(?:RSA|DSA|ECDSA)", "RSA", "HIGH", "key_exchange"),
    (r"min[_\-]?tls[_\-]?version:\s*[\"']?1\.[01]", "Old TLS", "HIGH", "protocol"),
]
# Names by which packages are imported, by normalised package; others are imported by their own name.
IMPORTS = {
    "cryptography": ["cryptography", "cryptography.hazmat", "cryptography.fernet"], "pycryptodome": ["Crypto", "Crypto.Cipher", "Crypto.PublicKey", "Crypto.Hash"], "pycryptodomex": ["Cryptodome", "Cryptodome.Cipher", "Cryptodome.PublicKey"], "pyopenssl": ["OpenSSL", "OpenSSL.crypto", "OpenSSL.SSL"], "paramiko": ["paramiko"], "pynacl": ["nacl", "nacl.signing", "nacl.public"], "rsa": ["rsa"], "ecdsa": ["ecdsa"], "jwcrypto": ["jwcrypto", "jwcrypto.jwk", "jwcrypto.jws"], "pyjwt": ["jwt"], "bcrypt": ["bcrypt"], "certifi": ["certifi"], "requests": ["requests"], "boto3": ["boto3"], "azure_identity": ["azure.identity"], "google_auth": ["google.auth"],
    "node_rsa": ["node-rsa", "NodeRSA"], "elliptic": ["elliptic"], "node_forge": ["node-forge", "forge"], "jsonwebtoken": ["jsonwebtoken", "jwt"], "crypto_js": ["crypto-js", "CryptoJS"], "tweetnacl": ["tweetnacl"], "crypto/rsa": ["crypto/rsa"], "crypto/ecdsa": ["crypto/ecdsa"], "crypto/elliptic": ["crypto/elliptic"], "golang_org/x/crypto": ["golang.org/x/crypto"], "github_com/cloudflare/circl": ["github.com/cloudflare/circl"], "ring": ["ring"], "rustls": ["rustls"], "p256": ["p256"], "k256": ["k256"], "ed25519_dalek": ["ed25519_dalek", "ed25519"],
}
# Fixed value: what a cryptographic call looks like in a file that imports a package, whatever the case.
CALL = r"generate_private_key|generate_key|GenerateKey|getInstance|Create\s*\(|new\s*\(|encrypt|decrypt|sign|verify|\.md5|\.sha1|\.sha256|MD5|SHA1|SHA256|ECDSA|ECDH|RSA|DiffieHellman|Cipher|KeyPairGenerator|MessageDigest|Signature|PrivateKey|PublicKey|SecretKey"


def scan_infrastructure(lines: DataFrame) -> DataFrame:
    """(..., ord, algorithm, severity, category) of (text, ...) lines of infrastructure files, a row for each matching pattern."""
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike("(?iud)" + p), F.lit(i)) for i, (p, *_) in enumerate(INFRASTRUCTURE))))
    rows = lines.withColumn("ord", F.explode(found))
    of = lambda k: F.get(F.array(*(F.lit(r[k]) for r in INFRASTRUCTURE)), F.col("ord"))
    return rows.withColumns({"algorithm": of(1), "severity": of(2), "category": of(3)})


def imported_names(package: str) -> list[str]:
    """Both the package and the table's keys are normalised before they are compared."""
    return IMPORTS.get(package.lower().replace("-", "_").replace(".", "_"), [package])


def imports(text: Column, package: str) -> Column:
    """Whether a line imports the package in the manner of any of the languages."""
    names = "|".join(re.escape(n) for n in imported_names(package))
    return text.rlike(rf"\b(?:import|from)\s+(?:{names})\b|require\s*\(\s*['\"].*(?:{names}).*['\"]\s*\)|\"\s*(?:{names})\s*\"|\b(?:use|using)\s+(?:{names})")


def reachability(lines: DataFrame, packages: list[str]) -> DataFrame:
    """(package, imports, calls, level, confidence) of the packages over (path, line, text): distinct places of imports, and of cryptographic calls from the first import of the same file on."""
    listed = F.array_compact(F.array(*(F.when(imports(F.col("text"), p), F.lit(p)) for p in packages)))
    marked = lines.select("path", "line", "text", listed.alias("packages"))
    places = marked.select("path", "line", F.explode("packages").alias("package")).distinct()
    firsts = places.groupBy("path", "package").agg(F.min("line").alias("first"))
    called = lines.where(F.col("text").rlike("(?i)" + CALL)).select("path", "line").distinct().join(firsts, "path").where("line >= first").groupBy("package").agg(F.count("*").alias("calls"))
    found = places.groupBy("package").agg(F.count("*").alias("imports")).join(called, "package", "left")
    rows = lines.sparkSession.createDataFrame([(p,) for p in packages], "package string").join(found, "package", "left").fillna(0, ["imports", "calls"])
    level = F.when(F.col("calls") > 0, "CONFIRMED").when(F.col("imports") > 0, "REACHABLE").otherwise("AVAILABLE")
    confidence = F.when(F.col("calls") > 0, F.least(F.lit(100), 70 + 5 * F.col("calls"))).when(F.col("imports") > 0, F.least(F.lit(70), 30 + 10 * F.col("imports"))).otherwise(10) / 100
    return rows.select("package", "imports", "calls", level.alias("level"), confidence.alias("confidence"))
