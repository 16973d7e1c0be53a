"""Queries of fix suggestions over findings put together from `lineitem`; SQL states what each snippet leads to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import dims, templates
from cipherlake.operators import fixes
from cipherlake.plans import corpus
from cipherlake.plans.frames import ctes

#: Snippets: (extension, algorithm of the finding, text, first tier as (before, after, text) or None, number of the template or None).
SNIPPETS = [
    (".py", "MD5", "h = hashlib.md5(b)", ("MD5", "SHA-256", "h = hashlib.sha256(b)"), None),
    (".py", "SHA-1/MD5", "  return hashlib.sha1(dsa.generate_private_key(1024))", ("SHA-1", "SHA-256", "  return hashlib.sha256(dsa.generate_private_key(1024))"), 3),
    (".py", "SHA-256", "h = hashlib.sha1(b)", None, None),
    (".py", "RSA", "    key = RSA.generate_private_key(65537, 2048)", None, 0),
    (".py", "ECDSA", "\tk.sign(d, ec.ECDSA(x), {'a': {1}})", None, 1),
    (".py", "ECDH", "s = k.exchange(ec.ECDH(), peer)", None, 2),
    (".java", "RSA", 'KeyPairGenerator g = KeyPairGenerator.getInstance( "RSA" );', None, 4),
    (".java", "RSA", '  Cipher c = Cipher.getInstance("RSA/ECB/PKCS1Padding"); {', None, 5),
    (".java", "ECDSA", 'Signature s = Signature.getInstance("SHA256withECDSA");', None, 6),
    (".java", "3DES", 'Cipher c = Cipher.getInstance("DESede/CBC");', ("3DES", "AES-256-GCM", 'Cipher c = Cipher.getInstance("AES/GCM/NoPadding");'), None),
    (".go", "RSA", "\t\tk, err := rsa.GenerateKey(rand.Reader, 2048)", None, 7),
    (".go", "ECDSA", "k, err := ecdsa.GenerateKey(c, r)", None, 8),
    (".go", "3DES", "c, err := des.NewCipher(k)", ("3DES", "AES-256", "c, err := aes.NewCipher(k)"), None),
    (".cs", "RSA", "var r = RSA.Create(2048);", None, 9),
    (".kt", "RSA", 'val g = KeyPairGenerator.getInstance("RSA")', None, 10),
    (".cfg", "RC4", "ssl_ciphers HIGH:RC4;", ("RC4", "AES-256-GCM", "ssl_ciphers ECDHE-ECDSA-AES256-GCM-SHA384:ECDHE-RSA-AES256-GCM-SHA384;;"), None),
    (".rs", "RSA", "RsaPrivateKey::new(&mut rng, 2048)", None, None),
    (".js", "RSA", 'KeyPairGenerator.getInstance("RSA")', None, None),
]


def _pick(values: list[str]):
    return F.get(F.array(*map(F.lit, values)), F.col("kind").cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding a row of lineitem."""
    rows = corpus.numbered(corpus.table(spark, sf_dir, "lineitem")).withColumn("kind", (F.col("l_orderkey") * 7 + F.col("line")) % len(SNIPPETS))
    ext, algorithm, snippet = (_pick([s[i] for s in SNIPPETS]) for i in range(3))
    return rows.select((F.col("l_orderkey") % 50).alias("project"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), ext).alias("path"), F.upper(ext).alias("ext"), "line", F.lit(0).alias("ord"), algorithm.alias("algorithm"), snippet.alias("snippet"))


def _suggested(strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fixes.ordered_suggestions(findings(spark, sf_dir), strict).drop("ord")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes.suggestions(findings(spark, sf_dir))
    return fixes.tier_counts(rows.withColumn("ext", F.regexp_extract("path", r"(\.\w+)$", 1)), "ext")


def _real_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the scan's own open findings."""
    rows = fixes.suggestions(corpus.findings(spark, sf_dir).where("NOT suppressed"))
    return fixes.tier_counts(rows, "algorithm_before", "algorithm_after")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"fix_suggestions": _suggested(False), "fix_suggestions_strict": _suggested(True), "fix_tier_counts": _counts, "scan_fix_tiers": _real_counts}


def _expected(strict: bool) -> str:
    """A row a suggestion of each snippet."""
    up = lambda t: t.replace("ML-KEM-768", "ML-KEM-1024").replace("ML-DSA-65", "ML-DSA-87") if strict else t
    rows = []
    for i, (ext, _, text, first, second) in enumerate(SNIPPETS):
        if first:
            rows.append((i, ext, text, 1, "HIGH", *first))
        if second is not None:
            _, _, old, new, lines = templates.TEMPLATES[second]
            body, indent = text.strip(), text[: len(text) - len(text.lstrip())]
            quoted = body.replace("{", "{{").replace("}", "}}")
            rows.append((i, ext, text, 2, "MEDIUM", old, up(new), up("\n".join(indent + line.replace("{original}", quoted) for line in lines))))
    return "expected AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(dims.literal, r)) + ")" for r in rows) + ") AS t(kind, ext, snippet, tier, confidence, algorithm_before, algorithm_after, fixed))"


def _rows(strict: bool) -> str:
    return f"""WITH {_expected(strict)}, n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(corpus.ORDER)}) AS line FROM lineitem),
        s AS (SELECT 'f' || l_orderkey || ext AS path, line, snippet, tier, confidence, algorithm_before, algorithm_after, fixed, ext FROM n JOIN expected e ON e.kind = (l_orderkey * 7 + line) % {len(SNIPPETS)})"""


_PLACED = " SELECT path, line, snippet, tier, confidence, algorithm_before, algorithm_after, fixed, row_number() OVER (ORDER BY tier, path, line) AS place FROM s"
#: What the derived corpus holds of either tier: (extension, part of the snippet, algorithm of the finding, tier, before, after).
_SCANNED = [
    (".py", "hashlib.md5(", "MD5", 1, "MD5", "SHA-256"), (".java", 'getInstance("MD5")', "MD5", 1, "MD5", "SHA-256"), (".py", "rsa.generate_private_key(", "", 2, "RSA", "ML-KEM-768 (hybrid)"), (".java", 'KeyPairGenerator.getInstance("RSA")', "", 2, "RSA", "ML-KEM-768 (BouncyCastle)"),
    (".go", "rsa.GenerateKey(", "", 2, "RSA", "ML-KEM-768 (circl)"), (".go", "des.NewCipher(", "3DES", 1, "3DES", "AES-256"), (".conf", "ssl_protocols TLSv1 ", "Old TLS", 1, "Old TLS", "TLS 1.3"), (".conf", "ssl_ciphers HIGH:RC4", "RC4", 1, "RC4", "AES-256-GCM"),
]

SQL: dict[str, str] = {
    "fix_suggestions": _rows(False) + _PLACED,
    "fix_suggestions_strict": _rows(True) + _PLACED,
    "fix_tier_counts": _rows(False) + " SELECT ext, count(*) AS suggestions, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2 FROM s GROUP BY ext",
    "scan_fix_tiers": ctes("findings") + ", e AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(dims.literal, r)) + ")" for r in _SCANNED) + """) AS t(ext, part, algorithm, tier, algorithm_before, algorithm_after))
        SELECT algorithm_before, algorithm_after, count(*) AS suggestions, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2
        FROM findings f JOIN e ON e.ext = f.ext AND contains(f.snippet, e.part) AND (e.algorithm = '' OR list_contains(string_split(f.algorithm, '/'), e.algorithm)) WHERE NOT suppressed GROUP BY 1, 2""",
}
