"""Rule files of users: YAML lists of regular expressions, read by the driver."""

from __future__ import annotations

import re
from pathlib import Path

try:
    import yaml
except ModuleNotFoundError:  # without the library there are no rule files
    yaml = None

NAMES = [".pqcrules.yml", ".pqcrules.yaml", "pqcrules.yml"]
SEVERITIES = {"critical", "high", "medium", "low", "info"}
CATEGORIES = {"key_exchange", "signature", "symmetric", "hash", "certificate", "protocol", "dependency"}
LANGUAGES = ["python", "java", "go", "javascript", "typescript", "rust", "c"]


def rule_of(entry: dict) -> tuple | None:
    """(id, severity, category, algorithm, pattern, languages) as operators.match takes it; None without an id, a pattern or with a bad one."""
    if not isinstance(entry, dict) or not entry.get("id") or "pattern" not in entry:
        return None
    try:
        re.compile(entry["pattern"])
    except (re.error, TypeError):
        return None
    severity, category = str(entry.get("severity", "medium")).lower(), str(entry.get("category", "symmetric")).lower()
    languages = entry.get("languages") or LANGUAGES
    return str(entry["id"]), severity.upper() if severity in SEVERITIES else "MEDIUM", category if category in CATEGORIES else "symmetric", str(entry.get("algorithm", "Custom")), "(?i)" + entry["pattern"], ",".join(map(str, languages))


def read_rules(path: str) -> list[tuple]:
    """The good rules of a file; none of a file that can't be read."""
    if yaml is None:
        return []
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError):
        return []
    entries = data.get("rules") if isinstance(data, dict) else None
    return [r for e in entries or [] if (r := rule_of(e))]


def find_rules(target: str) -> list[tuple]:
    """Rules of the rule files in a folder and up to three above it."""
    at = Path(target).resolve()
    at = at.parent if at.is_file() else at
    return [r for folder in [at, *list(at.parents)[:3]] for n in NAMES if (folder / n).is_file() for r in read_rules(str(folder / n))]
