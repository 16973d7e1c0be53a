"""Pattern matching on code lines: every pattern of the line's language is one literal expression in the same codegen stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.functions import lex


def matches(code: Column, language: Column, patterns: list[tuple] | None = None) -> Column:
    """Array of the ordinals of the patterns that the code of its language holds (case-insensitive search)."""
    by_language: dict[str, list[Column]] = {}
    for i, (lang, pattern, *_) in enumerate(patterns or dims.PATTERNS):
        by_language.setdefault(lang, []).append(F.when(code.rlike("(?iud)" + pattern), F.lit(i)))
    out = None
    for lang, tests in by_language.items():
        found = F.array_compact(F.array(*tests))
        # Most lines hold nothing: one test of all patterns goes before the single ones.
        some = (language == lang) & code.rlike("(?iud)" + "|".join(f"(?:{p})" for name, p, *_ in patterns or dims.PATTERNS if name == lang))
        out = F.when(some, found) if out is None else out.when(some, found)
    return out.otherwise(F.array().cast("array<int>"))


def scan_lines(lines: DataFrame, patterns: list[tuple] | None = None) -> DataFrame:
    """Findings of (language, text, ...) lines: comments stripped, one row for each matching pattern, suppressions marked.

    No regex join: patterns are constants of the plan, and what they say is looked up in constant arrays. Comments are stripped
    once a line: an exploded array of one keeps the optimizer from copying the stripper into every test.
    """
    patterns = patterns or dims.PATTERNS
    found = lines.withColumn("code", F.explode(F.array(lex.code_only(F.col("text"), F.col("language"))))).withColumn("ord", F.explode(matches(F.col("code"), F.col("language"), patterns)))
    of = lambda k: F.get(F.array(*(F.lit(p[k]) for p in patterns)), F.col("ord"))
    found = found.withColumns({"algorithm": of(2), "severity": of(3), "category": of(4)})
    return found.withColumn("snippet", lex.snippet(F.col("text"))).withColumn("suppressed", lex.suppressed(F.col("text"), F.col("algorithm"))).drop("code", "text")


def scan_rules(lines: DataFrame, rules: list[tuple] | None = None, longest: int = 2000) -> DataFrame:
    """Findings of custom rules (id, severity, category, algorithm, pattern, languages): lines over `longest` characters are skipped, comments are not stripped."""
    rules = rules or dims.RULES
    tests = [F.when(F.lower("language").isin(*r[5].split(",")) & F.col("text").rlike("(?d)" + r[4]), F.lit(i)) if "all" not in r[5].split(",") else F.when(F.col("text").rlike("(?d)" + r[4]), F.lit(i)) for i, r in enumerate(rules)]
    found = lines.where(F.length("text") <= longest).withColumn("rule_ord", F.explode(F.array_compact(F.array(*tests))))
    of = lambda k: F.get(F.array(*(F.lit(r[k]) for r in rules)), F.col("rule_ord"))
    return found.withColumns({"rule_id": of(0), "severity": of(1), "category": of(2), "algorithm": of(3)})
