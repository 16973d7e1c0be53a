"""Calls by structure without a grammar: tokens of whole files, brackets matched by depth, arguments and enclosing functions by running sums.

A file is read as tokens in order. The nesting depth is a running sum over them, so a bracket and its partner are neighbours
among the brackets of one depth, an argument's number is a running count of commas inside one bracket, and a function's body is
the span of its braces. Spark deals out the files; inside a task the sums and neighbours of some files at a time are columns of
numpy, so a token is never a row of a shuffle and a task holds CHUNK characters at once, or one file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import apis
from cipherlake.functions import lex
from cipherlake.operators.calls import cipher_mode, plausible_key, transform_parts

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
TOKEN = rf"{lex.STRING}|`[^`]*`|0[xX][0-9a-fA-F_]+|\d[\d_]*|{NAME}(?:(?:\.|::|->){NAME})*|[(){{}}\[\],;:=*&>]|\n"
#: Characters of code whose tokens a task holds at once; a longer file is held alone.
CHUNK = 1 << 20
#: Words before a function's name, and words before which a bracket opens that are neither calls nor functions.
DEFINES = {"Go": ["func"], "JavaScript": ["function"], "TypeScript": ["function"], "Rust": ["fn"], "Kotlin": ["fun"], "Swift": ["func"], "PHP": ["function"], "Scala": ["def"]}
TYPED = ["Java", "C#", "C/C++"]
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "match", "func", "function", "fn", "fun", "def", "sizeof", "synchronized", "foreach", "elseif", "guard", "select", "new", "throw", "else", "do", "case", "defer", "go", "await", "yield"]
#: Calls whose key size is the argument of that number; argument names that give one.
SIZE_AT = [("Go", "GenerateKey", 1), ("C/C++", "RSA_generate_key_ex", 1)]
SIZE_NAMES = ["key_size", "keySize", "modulusLength", "bits"]
#: Languages whose calls take the first number inside their brackets as the key size.
SIZE_FIRST = ["C#", "PHP", "Kotlin", "Swift", "Scala", "Java"]


CALLS = pa.schema([("path", pa.string()), ("language", pa.string()), ("pos", pa.int64()), ("line", pa.int64()), ("callee", pa.string()), ("args", pa.map_(pa.int32(), pa.string())), ("string", pa.string()), ("number", pa.int64()), ("named", pa.int64()), ("owners", pa.list_(pa.string()))])
FUNCTIONS = pa.schema([("path", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("open", pa.int64()), ("close", pa.int64())])


def _number(tok: str) -> int:
    """The value of a decimal token that a long holds, else -1."""
    n = int(tok.replace("_", "")) if re.fullmatch(r"[0-9][0-9_]*", tok) else -1
    return n if n < 1 << 63 else -1


def _next(marks: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each token the next marked one behind it in its file, else -1; last is the place of its file's last token."""
    places = np.append(np.flatnonzero(marks), len(marks))
    found = places[np.searchsorted(places[:-1], np.arange(len(marks)), side="right")]
    return np.where(found <= last, found, -1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all values of the ranges begin to end - 1, in order."""
    size = np.maximum(end - begin, 0)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]


def _offsets(groups: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(groups, np.arange(n + 1)), pa.int32())


def _structure(paths: list, languages: list, codes: list) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The calls and functions of some files; see calls_and_functions."""
    token = re.compile(TOKEN.replace(r"\\.", r"\\[^\n\r\u0085\u2028\u2029]"), re.ASCII)
    each = [token.findall(c) for c in codes]
    text = pa.array([t for ts in each for t in ts], pa.large_string())
    file = np.repeat(np.arange(len(each)), [len(ts) for ts in each])
    coded = text.dictionary_encode()
    code, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
    mark = lambda test: np.array([test(w) for w in words], dtype=bool)
    newline = mark(lambda w: w == "\n")[code]
    if newline.all():
        return pa.RecordBatch.from_pylist([], CALLS), pa.RecordBatch.from_pylist([], FUNCTIONS)
    begins = np.searchsorted(file, np.arange(len(each)))
    ends = np.cumsum(newline)
    line = 1 + ends - (ends - newline)[np.minimum(begins, len(file) - 1)][file]
    file, code, line = file[~newline], code[~newline], line[~newline]
    n = len(file)
    at, begins = np.arange(n), np.searchsorted(file, np.arange(len(each)))
    first, last = begins[file], np.append(begins[1:], n)[file] - 1
    of = lambda test: mark(test)[code]
    opens, closes, comma = of(lambda w: w in ("(", "[", "{")), of(lambda w: w in (")", "]", "}")), of(lambda w: w == ",")
    step = opens.astype(np.int64) - closes
    depth = np.cumsum(step)
    depth -= (depth - step)[first]
    # Partners: neighbours among the brackets of one level of a file.
    brackets = np.flatnonzero(opens | closes)
    level = (depth + closes)[brackets]
    order = np.lexsort((level, file[brackets]))
    b, same = brackets[order], np.zeros(len(order), bool)
    same[:-1] = (file[b[1:]] == file[b[:-1]]) & (level[order][1:] == level[order][:-1])
    partner = np.full(n + 1, -1)
    partner[b[same]] = b[1:][same[:-1]]
    partner[:-1][~opens] = -1
    # The bracket that a token stands in: the last one that opened at its depth.
    order = np.lexsort((depth, file))
    group = np.ones(n, bool)
    group[1:] = (file[order][1:] != file[order][:-1]) | (depth[order][1:] != depth[order][:-1])
    seen = np.maximum.accumulate(np.where(opens[order] | group, at, 0))
    own = np.empty(n, np.int64)
    own[order] = np.where(opens[order][seen], order[seen], -1)
    values = np.array([_number(w) for w in words], dtype=np.int64)[code]
    sized, equals = of(lambda w: w in SIZE_NAMES), of(lambda w: w in ("=", ":"))
    named = np.zeros(n, bool)
    named[2:] = sized[:-2] & equals[1:-1] & (values[2:] >= 0) & (first[2:] <= at[2:] - 2)
    string, number, named, stop = (_next(m, last) for m in (of(lambda w: w[0] in "\"'`"), values >= 0, named, of(lambda w: w in ("{", ";"))))
    round_, body = of(lambda w: w == "("), of(lambda w: w == "{")
    name = of(lambda w: re.match(NAME, w) is not None and w not in NOT_CALLS)
    close = np.append(partner[1:-1], -1)  # of the bracket behind a token
    calls = np.flatnonzero(name & np.append(round_[1:], False) & (at < last) & (close >= 0))
    calls = calls[of(lambda w: w == ")")[close[calls]]]
    close = close[calls]
    # Which of them define functions: a keyword, a receiver or a type before, a brace behind.
    before, behind, braced = np.where(calls > first[calls], calls - 1, -1), np.where(close < last[close], close + 1, -1), stop[close]
    lang = np.array(languages, dtype=object)[file[calls]]
    is_in = lambda places, test: (places >= 0) & of(test)[places]
    defines = np.zeros(len(calls), bool)
    for language, keywords in DEFINES.items():
        defines |= (lang == language) & is_in(before, lambda w, k=keywords: w in k)
    defines |= (lang == "Go") & is_in(before, lambda w: w == ")") & (line[before] == line[calls]) & (braced >= 0) & (line[braced] == line[close])
    typed = is_in(before, lambda w: w in ("*", "&", ">", "]") or (re.fullmatch(NAME, w) is not None and w not in NOT_CALLS))
    defines |= np.isin(lang.astype(str), TYPED) & typed & is_in(behind, lambda w: w in ("{", "throws", "const", "noexcept", "override"))
    defines &= (braced >= 0) & body[braced]
    fn, fn_open = calls[defines], braced[defines]
    fn, fn_open, fn_close = (x[partner[fn_open] >= 0] for x in (fn, fn_open, partner[fn_open]))
    pos = at - first + 1
    taken = lambda values, places: pa.array(values, pa.string()).take(pa.array(places))
    spelled = taken(words, code)
    functions = [taken(paths, file[fn]), spelled.take(pa.array(fn)), pa.array(line[fn]), pa.array(pos[fn_open]), pa.array(pos[fn_close])]
    calls, close = calls[~defines], close[~defines]
    # Arguments: the tokens whose bracket is a call's, numbered by the commas before them.
    rank = np.full(n, -1)
    rank[calls + 1] = np.arange(len(calls))
    inner = np.flatnonzero((own >= 0) & (rank[own] >= 0))
    inner = inner[np.argsort(rank[own[inner]], kind="stable")]
    call = rank[own[inner]]
    nth = np.cumsum(comma[inner])
    starts = np.searchsorted(call, np.arange(len(calls)))
    nth = nth - (nth - comma[inner])[starts[call]] if len(inner) else nth
    held = ~(comma | opens | closes)[inner]
    inner, call, nth = inner[held], call[held], nth[held]
    cuts = np.flatnonzero(np.append(True, (call[1:] != call[:-1]) | (nth[1:] != nth[:-1]))) if len(inner) else np.zeros(0, np.int64)
    parts = spelled.take(pa.array(inner)).to_pylist()
    args = ["".join(parts[i:j]) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts)])]
    has = np.isin(np.arange(len(calls)), call)
    offsets = pa.array(np.searchsorted(call[cuts], np.arange(len(calls) + 1)), pa.int32(), mask=np.append(~has, False))
    maps = pa.MapArray.from_arrays(offsets, pa.array(nth[cuts], pa.int32()), pa.array(args, pa.string()))
    # Functions around a call: those whose braces lie on both sides of it.
    owner, around = _ranges(np.searchsorted(calls, fn_open, side="right"), np.searchsorted(calls, fn_close))
    by_call = np.argsort(around, kind="stable")
    owners = pa.ListArray.from_arrays(_offsets(around[by_call], len(calls)), functions[1].take(pa.array(owner[by_call])))
    bodies = pa.array([w[1:-1] for w in words], pa.string())

    def inside(places: np.ndarray, values: pa.Array) -> pa.Array:
        found = places[calls]
        return values.take(pa.array(np.where((found >= 0) & (found < close), found, 0), mask=~((found >= 0) & (found < close))))

    numbers = pa.array(values)
    rows = [taken(paths, file[calls]), taken(languages, file[calls]), pa.array(pos[calls]), pa.array(line[calls]), spelled.take(pa.array(calls)), maps, inside(string, bodies.take(pa.array(code))), inside(number, numbers), inside(named, numbers), owners]
    return pa.RecordBatch.from_arrays(rows, schema=CALLS), pa.RecordBatch.from_arrays(functions, schema=FUNCTIONS)


def calls_and_functions(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (path, language, pos, line, callee, args, string, number, named, owners) and functions (path, name, line, open, close) of (path, language, content).

    args holds each argument's own tokens in order, without what is nested in them; string and number are the first ones anywhere
    inside the call's brackets, named the first number after one of SIZE_NAMES. open and close are the places of a body's braces,
    owners the names of the functions whose braces a call stands in. A call inside a string or a comment is none. A bracket that
    is never closed makes no call. Null and empty contents give no rows.
    """
    files = sources.select("path", "language", lex.code_only(F.coalesce("content", F.lit("")), F.col("language")).alias("code"))

    def part(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.asarray(pc.fill_null(pc.binary_length(batch.column("code")), 0), dtype=np.int64)
                chunk = np.cumsum(size) // CHUNK
                cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
                for i, j in zip(cuts, cuts[1:]):
                    rows = batch.slice(i, j - i)
                    yield _structure(*(rows.column(c).to_pylist() for c in ("path", "language")), [c or "" for c in rows.column("code").to_pylist()])[k]

        return run

    calls = "path string, language string, pos long, line long, callee string, args map<int,string>, string string, number long, named long, owners array<string>"
    return files.mapInArrow(part(0), calls), files.mapInArrow(part(1), "path string, name string, line long, open long, close long")


def edges(calls: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(caller, callee), distinct: the calls inside each function's body, those of nested functions counting for the outer ones too; a caller is module.name.

    Calls name the functions around them, so functions itself is not read.
    """
    module = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    inside = calls.select("path", F.explode("owners").alias("name"), "callee")
    return inside.select(F.concat(module, F.lit("."), "name").alias("caller"), "callee").distinct()


def imports(lines: DataFrame) -> DataFrame:
    """(path, language, line, alias, module) of Go's import specs and Rust's use paths, from (path, language, line, text)."""
    code = F.trim(lex.code_only(F.col("text"), F.col("language")))
    go, use = r'^(?:import\s+)?(?:([A-Za-z_.][A-Za-z0-9_]*)\s+)?"([A-Za-z0-9_./-]+)"$', r"^(?:pub\s+)?use\s+([^;]+);"
    # Only lines that can hold one are stripped of comments, which takes the most time.
    may = F.col("text").contains("/*") | F.when(F.col("language") == "Go", F.col("text").contains('"')).otherwise(F.col("text").contains("use"))
    rows = lines.where(F.col("language").isin("Go", "Rust") & may).withColumn("code", F.explode(F.array(code)))
    module = F.when(F.col("language") == "Go", F.regexp_extract("code", go, 2)).otherwise(F.regexp_extract("code", use, 1))
    alias = F.coalesce(F.nullif(F.regexp_extract("code", go, 1), F.lit("")), F.element_at(F.split(module, "/"), -1))
    rows = rows.select("path", "language", "line", F.when(F.col("language") == "Go", F.when(alias != "import", alias).otherwise(F.element_at(F.split(module, "/"), -1))).alias("alias"), module.alias("module"))
    return rows.where("module <> ''")


def _table(spark: SparkSession) -> DataFrame:
    """The tables of all languages as rows (language, ord, module, function, algorithm, severity, category): a constant, small enough to broadcast."""
    rows = [(language, i, *row) for language, table in apis.BY_LANGUAGE.items() for i, row in enumerate(table)]
    rows.append(("Java", len(apis.JAVA), "", "initialize", "RSA", "", "key_exchange"))  # by its size alone
    return F.broadcast(spark.createDataFrame(rows, "language string, ord int, module string, function string, algorithm string, severity string, category string"))


def import_findings(found: DataFrame) -> DataFrame:
    """(path, line, algorithm, severity, category) of imported modules: HIGH, for each row of the table that shares the module; Rust's by whole words of the path."""
    table = _table(found.sparkSession).where("function <> 'initialize'")
    words = F.array_distinct(F.when(F.col("language") == "Go", F.array("module")).otherwise(F.split("module", r"[^A-Za-z0-9_]+")))
    rows = found.select("path", "language", "line", F.explode(words).alias("word")).join(table.withColumn("word", F.when(F.col("language") == "Go", F.col("module")).otherwise(F.col("function"))), ["language", "word"])
    return rows.select("path", "line", "algorithm", F.lit("HIGH").alias("severity"), "category").distinct()


def crypto_calls(calls: DataFrame, found: DataFrame) -> DataFrame:
    """(path, line, callee, algorithm, severity, category, key_size, argument, mode): the calls that the language's table names; its first row that fits wins.

    Go's packages are resolved by the file's own imports, renamed ones too, and count as imported where a file has none. A string
    argument that names an algorithm gives algorithm and severity. Java's initialize(size) is a finding by its size alone.
    """
    alias = found.where("language = 'Go'").groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("alias", "module"))).alias("aliases"))
    rows = calls.withColumn("parts", F.split("callee", r"\.|::|->"))
    last, obj = F.element_at("parts", -1), F.coalesce(F.get("parts", F.size("parts") - 2), F.lit(""))
    rows = rows.withColumns({"fn": last, "obj": obj})
    size = F.col("named")
    for language, function, n in SIZE_AT:
        size = F.coalesce(size, F.when((F.col("language") == language) & (F.col("fn") == function), F.try_element_at("args", F.lit(n)).try_cast("long")))
    size = F.coalesce(size, F.when(F.col("language").isin(SIZE_FIRST), F.col("number")))
    rows = rows.select("path", "language", "pos", "line", "callee", "string", size.alias("key_size"), "fn", "obj", F.explode(F.array_distinct("parts")).alias("function"))
    # By the constant table first: what it doesn't name is never shuffled.
    rows = rows.join(_table(calls.sparkSession), ["language", "function"]).join(alias, "path", "left")
    rows = rows.withColumn("known", F.when(F.col("aliases").isNotNull(), F.coalesce(F.try_element_at("aliases", F.col("obj")), F.lit("?"))))
    own, module, tail = F.col("function") == F.col("fn"), F.col("module") == F.col("obj"), F.element_at(F.split("module", "/"), -1)
    fits = (
        F.when(F.col("language") == "Go", own & F.when(F.col("known").isNull(), tail == F.col("obj")).otherwise(F.col("module") == F.col("known")))
        .when(F.col("language") == "JavaScript", own & (module | (F.col("obj") == "")))
        .when(F.col("language") == "Rust", F.lit(True))
        .when(F.col("language") == "C/C++", F.col("callee") == F.col("function"))
        .when(F.col("function") == "initialize", own & plausible_key(F.col("key_size")).isNotNull())
        .otherwise(F.when(F.col("module") == "", own).otherwise(module))
    )
    severity = F.when(F.col("function") == "initialize", plausible_key(F.col("key_size"))).otherwise(F.col("severity")).alias("severity")
    first = rows.where(fits).groupBy("path", "pos").agg(F.min(F.struct("ord", "line", "callee", "algorithm", severity, "category", "key_size", "string")).alias("hit")).select("path", "hit.*")
    name = F.lower(transform_parts(F.coalesce("string", F.lit("")))["algorithm"])
    algorithm, severity = (F.try_element_at(F.create_map(*(F.lit(x) for r in apis.STRINGS for x in (r[0], r[k]))), name) for k in (1, 2))
    return first.select("path", "line", "callee", F.coalesce(algorithm, "algorithm").alias("algorithm"), F.coalesce(severity, "severity").alias("severity"), "category", "key_size", F.col("string").alias("argument"), cipher_mode(F.coalesce("string", F.lit(""))).alias("mode"))
