"""Backward slices: the last assignment of a variable before a line, through aliases, in one pass over the sorted lines of blocks of a file."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that are looked back from a line, and passes: a slice resolves through one alias less.
WINDOW, PASSES = 48, 3
#: Binary places of a line's number within its block. A block has the assignments of the WINDOW x PASSES lines before it as well.
SPAN_BITS = 12
_VAR, _QUOTED = r"([A-Za-z_][A-Za-z0-9_.]*)", r"""["']([^"']+)["']"""
#: Forms at a line's start, first match wins: (form, pattern after the variable and =, value type, confidence).
FORMS = [
    (1, _QUOTED, "string", "HIGH"),
    (2, r"(\d+)", "integer", "HIGH"),
    (3, r"([a-zA-Z_]\w*)\s*$", "alias", ""),
    (4, r"""\w+\.get\s*\(\s*["'][^"']*["']\s*,\s*["']([^"']+)["']\)""", "string", "MEDIUM"),
    (5, r"""\w+\[["']([^"']+)["']\]""", "variable", "LOW"),
]


def assignments(lines: DataFrame) -> DataFrame:
    """(path, line, var, form, value, value_type, confidence) of (path, line, text): the seven forms in which a line gives a variable a value.

    Forms 1 to 5 stand at the line's start: a string, a number, another variable, a look-up with a default, a look-up without one
    (whose value is unknown). Forms 6 and 7 are defaults, strings or numbers, on a line that defines a function. A line may give
    a variable several forms, of which the first counts. Variables are whole names.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = lines.select("path", "line", F.explode(F.array(text)).alias("t")).where(F.col("t").contains("="))
    var, rest = F.regexp_extract("t", rf"^{_VAR}\s*=", 1), F.regexp_replace("t", rf"^{_VAR}\s*=\s*", "")
    head = F.lit(None)
    for form, pattern, kind, sure in reversed(FORMS):
        head = F.when(F.col("rest").rlike(f"^{pattern}"), F.struct(F.col("var").alias("var"), F.lit(form).alias("form"), F.regexp_extract("rest", f"^{pattern}", 1).alias("value"), F.lit(kind).alias("value_type"), F.lit(sure).alias("confidence"))).otherwise(head)
    defaults = F.transform(F.regexp_extract_all("t", F.lit(rf"""{_VAR}\s*=\s*(?:["'][^"']+["']|\d+)"""), F.lit(0)), lambda m: F.regexp_replace(m, r"\s*=\s*", "="))
    defines = F.col("t").contains("def ") | F.col("t").contains("function ")
    parts = F.transform(defaults, lambda m: F.struct(F.split(m, "=", 2)[0].alias("var"), F.when(m.rlike(r"=\d+$"), 7).otherwise(6).alias("form"), F.regexp_replace(F.split(m, "=", 2)[1], "^[\"']|[\"']$", "").alias("value"), F.when(m.rlike(r"=\d+$"), "integer").otherwise("string").alias("value_type"), F.lit("MEDIUM").alias("confidence")))
    rows = rows.withColumns({"var": var, "rest": rest})
    rows = rows.withColumn("e", F.explode(F.concat(F.array_compact(F.array(F.when(F.col("var") != "", head))), F.when(defines, parts).otherwise(F.array().cast("array<struct<var: string, form: int, value: string, value_type: string, confidence: string>>")))))
    return rows.select("path", "line", "e.*")


def _resolved(known: dict[str, list[tuple]], here: int, now: str) -> tuple | None:
    """(value, value_type, source_line, confidence) of a variable before a line; known: (line, form, value, value_type, confidence) by variable, lines ascending."""
    met = [now]
    for _ in range(PASSES):
        given = known.get(now, [])
        i = bisect_left(given, (here,))
        while i and given[i - 1][0] >= here - WINDOW:
            at, form, value, kind, sure = given[i - 1]
            if form != 3:
                return None if form == 5 else value, kind, at, sure
            if value not in met:
                break
            i -= 1
        else:
            return None
        met.append(value)
        here, now = at, value
    return None


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of rows that are sorted by path, block and line, targets (form 0) first, equal ones beside each other."""
    schema = pa.schema([("path", pa.string()), ("line", pa.int64()), ("var", pa.string()), ("value", pa.string()), ("value_type", pa.string()), ("source_line", pa.int64()), ("confidence", pa.string())])
    where, last, known = None, None, {}
    for batch in batches:
        out = []
        for path, block, line, form, var, value, kind, sure in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
            if (path, block) != where:
                where, last, known = (path, block), None, {}
            if form:
                given, e = known.setdefault(var, []), (line, form, value, kind, sure)
                if given and given[-1][0] == line:
                    given[-1] = min(given[-1], e)
                else:
                    given.append(e)
            elif (line, var) != last:
                last = line, var
                if found := _resolved(known, line, var):
                    out.append((path, line, var, *found))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema, strict=True)], schema=schema)


def backward_slices(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, line, var, value, value_type, source_line, confidence) of the targets (path, line, var) that can be resolved.

    From a target's line the nearest of the WINDOW lines before it that gives the variable a value decides. An alias goes on with
    the other variable from its own line, at most PASSES passes in all; an alias that leads back to a name already met is passed
    over. A look-up without a default has value null. Targets and assignments are dealt by (path, block of lines) and sorted, so
    a task holds the assignments of one block at a time, however long a file. Repeated targets count once; null columns resolve
    to nothing. Paths are strings, lines longs.
    """
    block, place = F.shiftright("line", SPAN_BITS), F.col("line").bitwiseAND(F.lit((1 << SPAN_BITS) - 1))
    blocks = F.when(place >= (1 << SPAN_BITS) - WINDOW * PASSES, F.array(block, block + 1)).otherwise(F.array(block))
    known = assignments(lines).dropna(subset=["path", "line"]).select("path", F.explode(blocks).alias("block"), "line", "form", "var", "value", "value_type", "confidence")
    none = F.lit(None).cast("string")
    asked = targets.dropna(subset=["path", "line", "var"]).select("path", block.alias("block"), "line", F.lit(0).alias("form"), "var", none.alias("value"), none.alias("value_type"), none.alias("confidence"))
    rows = known.unionByName(asked).repartition("path", "block").sortWithinPartitions("path", "block", "line", "form", "var")
    return rows.mapInArrow(_slice, "path string, line long, var string, value string, value_type string, source_line long, confidence string")
