"""Lexing as column expressions: comments, string bodies, suppressions, snippets (all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string literal in single or double quotes, in unrolled form: no back-tracking, no deep recursion.
STRING = r""""[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"""
HASH_COMMENT = ["Python", "Ruby", "Config"]
SLASH_COMMENT = ["Java", "Go", "JavaScript", "C/C++", "Rust", "TypeScript", "C#", "Swift", "Kotlin", "Scala", "PHP"]


def strip_line_comment(text: Column, marker: str) -> Column:
    """Takes out marker and what follows on the line; markers in string literals stay."""
    return F.when(text.contains(marker), F.regexp_replace(text, f"({STRING})|{marker}[^\n]*", "$1")).otherwise(text)


def strip_block_comments(text: Column) -> Column:
    """Takes out /* ... */ outside string literals; their line ends stay, so line numbers hold."""
    tokens = F.regexp_extract_all(text, F.lit(STRING + r"|/\*[\s\S]*?\*/|[^\"'/]+|[\s\S]"), F.lit(0))
    stripped = F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("/*") & (F.length(t) >= 4), F.regexp_replace(t, r"[^\n]", "")).otherwise(t)), "")
    return F.when(text.contains("/*"), stripped).otherwise(text)  # most texts hold none


def _line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", "")


def blank_triple_strings(text: Column) -> Column:
    """Takes out triple-quoted strings with their prefix letters; their line ends stay. A triple quote inside another string doesn't open one."""
    triple = r"(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')"
    # Words and what lies between them go in runs, up to a quote or its prefix letters: fewer tokens, and no deep recursion.
    run = r"(?:(?!\b[rRbBuUfF]{1,2}[\"'])[A-Za-z0-9_]+|[^A-Za-z0-9_\"']+){1,64}+"
    tokens = F.regexp_extract_all(text, F.lit(triple + "|" + STRING + "|" + run + r"|[A-Za-z0-9_]+|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^[rRbBuUfF]{0,2}(?:\"\"\"|''')") & (F.length(t) >= 6), _line_ends(t)).otherwise(t)), "")


def strip_ruby_blocks(text: Column) -> Column:
    """Takes out =begin ... =end at line starts; their line ends stay."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?m)^=begin\b[\s\S]*?^=end\b[^\n]*|[^\n]*\n|[^\n]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("=begin"), _line_ends(t)).otherwise(t)), "")


def strip_markup_comments(text: Column) -> Column:
    """Takes out <!-- ... -->; their line ends stay."""
    tokens = F.regexp_extract_all(text, F.lit(r"<!--[\s\S]*?-->|[^<]+|<"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("<!--") & t.endswith("-->"), _line_ends(t)).otherwise(t)), "")


def strip_blocks(text: Column, language: Column) -> Column:
    """Block comments of the language's family taken out, line ends kept; unknown languages stay as they are."""
    return (
        F.when(language == "Python", blank_triple_strings(text))
        .when(language == "Ruby", strip_ruby_blocks(text))
        .when(language.isin("Config", "HTML", "XML"), strip_markup_comments(text))
        .when(language.isin(SLASH_COMMENT), strip_block_comments(text))
        .otherwise(text)
    )


def code_only(text: Column, language: Column) -> Column:
    """Text without comments, by the language's family; unknown languages stay as they are."""
    return (
        F.when(language.isin(HASH_COMMENT), strip_line_comment(text, "#"))
        .when(language.isin(SLASH_COMMENT) & text.contains("/*"), F.transform(F.array(strip_block_comments(text)), lambda t: strip_line_comment(t, "//"))[0])
        .when(language.isin(SLASH_COMMENT), strip_line_comment(text, "//"))
        .otherwise(text)
    )


def blank_strings(text: Column) -> Column:
    """String literals with empty bodies."""
    return F.regexp_replace(F.regexp_replace(text, r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"', '""'), r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'", "''")


def suppressed(line: Column, algorithm: Column) -> Column:
    """Whether a line carries '# pqc-ignore', alone or with a bracketed list that names the algorithm."""
    listed = F.regexp_extract(line, r"(?i)#\s*pqc-ignore\s*\[([^\]]*)\]", 1)
    has = line.rlike(r"(?i)#\s*pqc-ignore")
    names = F.transform(F.split(F.upper(listed), ","), lambda x: F.trim(x))
    return has & ((listed == "") | F.array_contains(names, F.upper(algorithm)))


def snippet(line: Column, length: int = 120) -> Column:
    return F.substring(F.regexp_replace(line, r"^\s+|\s+$", ""), 1, length)


def glob_regex(glob: str) -> str:
    """Regular expression of a file glob whose * crosses folders."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "_/" else "\\" + c) for c in glob) + "$"


def relative_path(path: Column, root: Column) -> Column:
    """The path below root; outside it, or without one, the path's last three parts."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    parts = F.split(path, "/")
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(-3), -F.size(parts)), 3), "/")
    return F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(tail)


def fingerprint(path: Column, line: Column, algorithm: Column, category: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), algorithm, category)


#: Secret patterns that must match, in their order; a key block goes up to its end line where there is one.
SECRETS = [
    r"-----BEGIN[^-]*-----(?:[\s\S]*?-----END[^-]*-----)?",
    r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][^"']+["']""",
    r"""(?i)(secret|api[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*["'][^"']+["']""",
    r"""(?i)(aws_secret_access_key|aws_access_key_id)\s*[:=]\s*["'][^"']+["']""",
    "ghp_[A-Za-z0-9]{30,}",
    "sk-[A-Za-z0-9]{30,}",
    "xox[baprs]-[A-Za-z0-9-]{10,}",
]


def redact_secrets(text: Column) -> Column:
    """The reference's secrets replaced by its marker, in its order; what else looks like one stays (see redact)."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED-SECRET]")
    return text


def redact(text: Column) -> Column:
    """Secrets replaced by markers: the reference's patterns, then bare assignments, long hexadecimal and base64 runs, addresses."""
    out = redact_secrets(text)
    out = F.regexp_replace(out, r"(?i)(password|secret|api_key|token)\s*[:=]\s*\S+", "$1=[REDACTED]")
    out = F.regexp_replace(out, r"\b[0-9a-fA-F]{32,}\b", "[HEX]")
    # Mixed case and a digit: not a long word, path or number.
    run = "[A-Za-z0-9+/]"
    out = F.regexp_replace(out, rf"(?<!{run})(?={run}*[a-z])(?={run}*[A-Z])(?={run}*[0-9]){run}{{40,}}={{0,2}}", "[BASE64]")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
