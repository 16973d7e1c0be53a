"""Findings of certificates: what a quantum computer breaks, in the columns that reports and scores read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import dims

#: Algorithm of the key -> (severity, text with the size in place of {size}, advice).
RULES = {
    "RSA": ("CRITICAL", "RSA-{size} certificate", "Replace with ML-DSA certificate (FIPS 204)"),
    "ECDSA": ("CRITICAL", "ECDSA P-{size} certificate", "Replace with ML-DSA certificate (FIPS 204)"),
    "Ed25519": ("HIGH", "Ed25519 certificate", "Replace with ML-DSA-44 certificate (FIPS 204)"),
    "DSA": ("CRITICAL", "DSA-{size} certificate", "Replace with ML-DSA certificate (FIPS 204)"),
}
#: Any other key may be quantum-safe, so it is no more than a note.
OTHER = ("INFO", "certificate of another algorithm", "Verify the algorithm; nothing to do if it is ML-DSA, SLH-DSA or LMS")


def _by_rule(place: int) -> Column:
    out = F.lit(OTHER[place])
    for algorithm, rule in RULES.items():
        head, found, tail = rule[place].partition("{size}")
        text = F.concat(F.lit(head), F.col("key_size").cast("string"), F.lit(tail)) if found else F.lit(head)
        out = F.when(F.col("algorithm") == algorithm, text).otherwise(out)
    return out


def findings(certificates: DataFrame) -> DataFrame:
    """Rows of sources.certificates.read with category, severity, description (holding key_size=N where the size is known), recommendation and replacement.

    The replacement is that of the remediation table, null for an algorithm without one.
    """
    sized = F.when(F.col("key_size") > 0, F.concat(F.lit(" key_size="), F.col("key_size").cast("string"))).otherwise("")
    out = certificates.withColumns({"category": F.lit("certificate"), "severity": _by_rule(0), "description": F.concat(_by_rule(1), sized), "recommendation": _by_rule(2)})
    return out.join(F.broadcast(dims.frame(certificates.sparkSession, "replacements")), "algorithm", "left")


def expiring(certificates: DataFrame, as_of: str, days: int) -> DataFrame:
    """Certificates whose last day is within `days` of `as_of`, with days_left (negative once expired)."""
    left = F.datediff(F.to_date(F.substring("not_after", 1, 10)), F.lit(as_of).cast("date")).cast("long")
    return certificates.withColumn("days_left", left).where(F.col("days_left") <= days)
