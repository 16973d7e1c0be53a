"""Fix suggestions of both tiers: substitutions that can be applied as they are, and templates that a person reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import dims, templates
from cipherlake.operators import reports
from cipherlake.operators.order import placed

def after(ext: str, algorithm: str) -> str:
    """What a substitution leads to."""
    if algorithm in ("MD5", "SHA-1"):
        return "SHA-256"
    if algorithm in ("Old TLS", "SSLv3"):
        return {"Old TLS": "TLS 1.3", "SSLv3": "TLS 1.2+"}[algorithm]
    return "AES-256" if ext in (".py", ".go") else "AES-256-GCM"


def deterministic(snippet: Column, ext: Column, algorithm: Column) -> Column:
    """Tier 1: number in dims.FIXES of the first substitution of the extension and algorithm that changes the snippet; null without one."""
    ext = F.when(ext == ".cfg", ".conf").otherwise(ext)
    named = F.transform(F.split(F.upper(algorithm), "/"), lambda x: F.trim(x))
    return F.coalesce(*(F.when((ext == e) & F.array_contains(named, a.upper()) & snippet.rlike("(?i)" + p) & (F.regexp_replace(snippet, p, n.replace("$", "\\$")) != snippet), F.lit(i)) for i, (e, a, p, n) in enumerate(dims.FIXES)))


def templated(snippet: Column, ext: Column) -> Column:
    """Tier 2: number in templates.TEMPLATES of the first template of the extension that is found in the snippet, whatever the finding's algorithm; null without one.

    The indentation and what follows it may be empty, so they say nothing of whether the rest is found; with them a line without it is read once from each of its places.
    """
    return F.coalesce(*(F.when((ext == e) & snippet.rlike("(?i)" + p.removeprefix(r"(\s*).*")), F.lit(i)) for i, (e, p, *_) in enumerate(templates.TEMPLATES)))


def chosen(findings: DataFrame) -> DataFrame:
    """(path, line, ord, snippet, tier, rule) of findings (path, ext, line, ord, algorithm, snippet): none, one or two narrow rows a finding; rule is a number in the tier's table."""
    ext, snippet = F.lower("ext"), F.col("snippet")
    # The tests are a column of their own: as the generator's own argument they would be left to the interpreter.
    both = findings.select("path", "line", "ord", "snippet", F.array(deterministic(snippet, ext, F.col("algorithm")), templated(snippet, ext)).alias("both"))
    return both.select("path", "line", "ord", "snippet", F.posexplode("both").alias("tier", "rule")).where("rule IS NOT NULL").withColumn("tier", F.col("tier") + 1)


#: Where a template's text has the indentation and the line found; the indentation is filled in first and holds spaces alone.
_INDENT, _FOUND = "\ue000", "\ue001"


def written(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of chosen(), whatever other columns they have, with confidence, algorithm_before, algorithm_after and the fixed text in place of rule.

    A template's lines keep the indentation before what is found, else the snippet's own. Braces of the snippet are
    doubled in the comment that quotes it. strict asks for the parameter sets of CNSA 2.0.
    """
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("rule"))
    either = lambda first, second: F.when(F.col("tier") == 1, first).otherwise(second)
    up = reports.upgraded if strict else lambda c: c
    snippet = F.col("snippet")
    mended = F.regexp_replace(snippet, of([p for _, _, p, _ in dims.FIXES]), of([n.replace("$", "\\$") for *_, n in dims.FIXES]))
    own = F.call_function("regexp_extract", snippet, of(["(?i)" + t[1] for t in templates.TEMPLATES]), F.lit(1))
    quoted = F.replace(F.replace(F.regexp_replace(snippet, r"^\s+|\s+$", ""), F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    text = of(["\n".join(_INDENT + line.replace("{original}", _FOUND) for line in t[4]) for t in templates.TEMPLATES])
    text = F.replace(F.replace(text, F.lit(_INDENT), F.when(own != "", own).otherwise(F.regexp_extract(snippet, r"^(\s*)", 1))), F.lit(_FOUND), quoted)
    names = {
        "confidence": either(F.lit("HIGH"), F.lit("MEDIUM")), "algorithm_before": either(of([f[1] for f in dims.FIXES]), of([t[2] for t in templates.TEMPLATES])),
        "algorithm_after": either(of([after(e, a) for e, a, *_ in dims.FIXES]), up(of([t[3] for t in templates.TEMPLATES]))), "fixed": either(mended, up(text)),
    }
    return rows.withColumns(names).drop("rule")


def suggestions(findings: DataFrame, strict: bool = False) -> DataFrame:
    """(path, line, ord, snippet, tier, confidence, algorithm_before, algorithm_after, fixed) of findings (path, ext, line, ord, algorithm, snippet): none, one or two rows a finding."""
    return written(chosen(findings), strict)


def ordered_suggestions(findings: DataFrame, strict: bool = False) -> DataFrame:
    """The rows of ordered(suggestions(findings)): narrow rows are ordered, and the texts are put together once they have their place."""
    return written(placed(chosen(findings), "tier", "path", "line", "ord"), strict)


def ordered(suggested: DataFrame) -> DataFrame:
    """Suggestions with their place by (tier, path, line, ord), substitutions first."""
    return placed(suggested, "tier", "path", "line", "ord")


def tier_counts(suggested: DataFrame, *by: str) -> DataFrame:
    """Suggestions, in all and by tier."""
    tier = lambda n: F.count(F.when(F.col("tier") == n, 1)).alias(f"tier{n}")
    return suggested.groupBy(*by).agg(F.count("*").alias("suggestions"), tier(1), tier(2))
