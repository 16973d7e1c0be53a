"""Cryptographic calls of languages without a syntax tree here, as literal patterns on stripped lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import apis
from cipherlake.functions import lex

#: A string argument that names an algorithm decides over the call's own: `getInstance("SHA-1")`.
ARGUMENT = r"""\(\s*["']([^"']+)["']"""


def _pattern(language: str, module: str, function: str) -> str:
    """A call of the function on its module or object, or alone; word boundaries on both sides."""
    tail = module.rsplit("/", 1)[-1]
    call = re.escape(function) + r"(?:\b|$)"
    if language == "Go":
        return rf"\b{re.escape(tail)}\.{call}"
    if language == "JavaScript":
        return rf"(?:\b{re.escape(module)}\.|(?:^|[^A-Za-z_.])){call}\s*\("
    if language == "Rust":
        return rf"\b{call}"
    if language == "Ruby":
        return rf"\b{re.escape(module)}::{call}"
    return rf"\b{re.escape(module)}\.{call}" if module else rf"(?:^|[^A-Za-z_]){call}"


def first_match(code: Column, language: Column) -> Column:
    """Ordinal of the first row of the language's table that the line calls, null where none does."""
    out = F.lit(None).cast("int")
    for name, rows in apis.BY_LANGUAGE.items():
        patterns = ["(?d)" + _pattern(name, m, f) for m, f, *_ in rows]
        found = F.coalesce(*(F.when(code.rlike(p), F.lit(i)) for i, p in enumerate(patterns)))
        # Most lines call nothing: one test of all patterns goes before the single ones.
        out = F.when((language == name) & code.rlike("|".join(f"(?:{p})" for p in patterns)), found).otherwise(out)
    return out


def _row(language: Column, at: Column, column: int) -> Column:
    out = F.lit(None).cast("string")
    for name, rows in apis.BY_LANGUAGE.items():
        out = F.when(language == name, F.get(F.array(*(F.lit(r[column]) for r in rows)), at)).otherwise(out)
    return out


def cipher_mode(text: Column) -> Column:
    """The first of the modes, in fixed order, that a text names."""
    out = F.lit(None).cast("string")
    for mode in reversed(["ECB", "CBC", "CTR", "GCM", "CFB", "OFB", "CCM"]):
        out = F.when(F.upper(text).contains(mode), F.lit(mode)).otherwise(out)
    return out


def transform_parts(text: Column) -> Column:
    """struct(algorithm, mode, padding) of a transformation ALG/MODE/PADDING; missing parts are null."""
    parts = F.split(text, "/")
    return F.struct(F.get(parts, F.lit(0)).alias("algorithm"), F.get(parts, F.lit(1)).alias("mode"), F.get(parts, F.lit(2)).alias("padding"))


def plausible_key(size: Column) -> Column:
    """Severity of a call that gives a key size alone: none below 1024, CRITICAL below 4096, else HIGH."""
    return F.when(size < 1024, F.lit(None).cast("string")).when(size < 4096, "CRITICAL").otherwise("HIGH")


def scan_calls(lines: DataFrame) -> DataFrame:
    """(..., algorithm, severity, category, argument, mode) of (language, text, ...) lines whose code makes a cryptographic call; the first row of the table wins.

    A string argument that names an algorithm gives algorithm and severity; the category stays the call's.
    """
    # An exploded array of one is a barrier: without it the optimizer copies the comment stripper into every pattern's test.
    rows = lines.withColumn("code", F.explode(F.array(lex.code_only(F.col("text"), F.col("language")))))
    rows = rows.withColumn("_at", F.explode(F.array_compact(F.array(first_match(F.col("code"), F.col("language"))))))
    for i, name in ((2, "algorithm"), (3, "severity"), (4, "category")):
        rows = rows.withColumn(name, _row(F.col("language"), F.col("_at"), i))
    argument = F.nullif(F.regexp_extract("code", ARGUMENT, 1), F.lit(""))
    rows = rows.withColumn("argument", argument).withColumn("_name", F.lower(transform_parts(F.col("argument"))["algorithm"]))
    algorithm, severity = (F.try_element_at(F.create_map(*(F.lit(x) for r in apis.STRINGS for x in (r[0], r[k]))), F.coalesce("_name", F.lit(""))) for k in (1, 2))
    rows = rows.withColumns({"algorithm": F.coalesce(algorithm, "algorithm"), "severity": F.coalesce(severity, "severity"), "mode": cipher_mode(F.coalesce("argument", F.lit("")))})
    return rows.drop("code", "_at", "_name")
