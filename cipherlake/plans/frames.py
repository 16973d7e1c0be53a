"""The oracle's base frames: the derived corpus and its findings as common table expressions, beside those of plans.corpus."""

from __future__ import annotations

from cipherlake import dims
from cipherlake.functions import lex
from cipherlake.plans import corpus

_STR = lex.STRING.replace("'", "''")


def _patterns_cte() -> str:
    rows = ", ".join(f"({i}, {', '.join(map(dims.literal, p))})" for i, p in enumerate(dims.PATTERNS))
    return f"patterns AS (SELECT * FROM (VALUES {rows}) AS t(ord, language, pattern, algorithm, severity, category))"


def _rules_cte() -> str:
    rows = ", ".join(f"({i}, {', '.join(map(dims.literal, r))})" for i, r in enumerate(dims.RULES))
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS t(rule_ord, rule_id, severity, category, algorithm, pattern, languages))"


_HASH = ", ".join(map(dims.literal, lex.HASH_COMMENT))
_SLASH = ", ".join(map(dims.literal, lex.SLASH_COMMENT))
#: Base frames for the oracle: name -> (frames it needs, common table expressions).
ORACLE_FRAMES: dict[str, tuple[list[str], str]] = {
    "lines": (
        ["languages", "templates"],
        f"""lines AS (
  WITH numbered AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(corpus.ORDER)}) AS line FROM lineitem),
  counts AS (SELECT DISTINCT language, n_templates FROM templates)
  SELECT o.o_custkey % 50 AS project, n.l_orderkey AS file, n.line, g.language, g.ext,
    'p' || CAST(o.o_custkey % 50 AS VARCHAR) || '/' || CASE WHEN n.l_orderkey % 5 = 0 THEN 'tests/' ELSE 'src/' END || 'f' || CAST(n.l_orderkey AS VARCHAR) || g.ext AS path, t.text, n.l_returnflag AS flag
  FROM numbered n JOIN orders o ON o.o_orderkey = n.l_orderkey JOIN languages g ON g.lang_no = n.l_orderkey % 8 JOIN counts c ON c.language = g.language
  JOIN templates t ON t.language = g.language AND t.template_no = (n.l_partkey * 31 + n.l_suppkey) % c.n_templates)""",
    ),
    "findings": (
        ["lines"],
        _patterns_cte()
        + f""", findings AS (
  WITH block AS (SELECT *, CASE WHEN language IN ({_SLASH}) THEN array_to_string(list_transform(regexp_extract_all(text, '{_STR}|/\\*[\\s\\S]*?\\*/|[^"''/]+|[\\s\\S]', 0), lambda t: CASE WHEN t LIKE '/*%' AND length(t) >= 4 THEN regexp_replace(t, '[^\\n]', '', 'g') ELSE t END), '') ELSE text END AS c FROM lines),
  code AS (SELECT *, CASE WHEN language IN ({_HASH}) THEN regexp_replace(c, '({_STR})|#[^\\n]*', '\\1', 'g') WHEN language IN ({_SLASH}) THEN regexp_replace(c, '({_STR})|//[^\\n]*', '\\1', 'g') ELSE c END AS code FROM block),
  hit AS (SELECT k.project, k.file, k.path, k.line, k.language, k.ext, p.ord, p.algorithm, p.severity, p.category, k.text, k.flag, regexp_extract(k.text, '(?i)#\\s*pqc-ignore\\s*\\[([^\\]]*)\\]', 1) AS listed FROM code k JOIN patterns p ON p.language = k.language AND regexp_matches(k.code, '(?i)' || p.pattern))
  SELECT project, file, path, line, language, ext, ord, algorithm, severity, category, flag, substr(trim(text), 1, 120) AS snippet,
    regexp_matches(text, '(?i)#\\s*pqc-ignore') AND (listed = '' OR list_contains(list_transform(string_split(upper(listed), ','), lambda x: trim(x)), upper(algorithm))) AS suppressed FROM hit)""",
    ),
    "rule_findings": (
        ["lines"],
        _rules_cte() + ", rule_findings AS (SELECT k.project, k.file, k.line, k.language, r.rule_id, r.severity, r.category, r.algorithm FROM lines k JOIN rules r ON list_contains(string_split(r.languages, ','), lower(k.language)) AND regexp_matches(k.text, r.pattern) WHERE length(k.text) <= 2000)",
    ),
}


def ctes(*names: str) -> str:
    """WITH and the expressions that these frames and reference tables need, each once."""
    parts: list[str] = []
    done: set[str] = set()

    def need(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for other in ORACLE_FRAMES.get(name, ([], ""))[0]:
            need(other)
        parts.append(ORACLE_FRAMES[name][1] if name in ORACLE_FRAMES else dims.values_sql(name))

    for name in names:
        need(name)
    return "WITH " + ", ".join(parts)
