"""Python sources by their syntax trees: cryptographic calls and call edges.

Trees are built where the files are: whole sources go through mapInArrow, one at a time.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake import apis


def parsed(source: str | None) -> ast.AST | None:
    """The tree of a source; null and unparsable ones have none."""
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def dotted(node: ast.expr) -> str | None:
    """a.b.c of a chain of attributes on a name; a chain on anything else keeps its attributes only, a bare other node has no name."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.insert(0, node.id)
    return ".".join(parts) or None


def _in_order(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes, each before its children, in the order of the source."""
    stack = [node]
    while stack:
        top = stack.pop()
        yield top
        stack.extend(reversed(list(ast.iter_child_nodes(top))))


def _texts(call: ast.Call) -> Iterator[str]:
    for value in [*call.args, *(k.value for k in call.keywords)]:
        if isinstance(value, ast.Constant) and isinstance(value.value, str):
            yield value.value


def _hash_call(call: ast.Call, name: str) -> tuple | None:
    if name in apis.PYTHON_HASHES:
        return apis.PYTHON_HASHES[name]
    first = call.args[0] if name == "new" and call.args else None
    return apis.PYTHON_STRINGS.get(first.value.lower()) if isinstance(first, ast.Constant) and isinstance(first.value, str) else None


def _attribute_call(call: ast.Call, modules: dict[str, str], names: dict[str, str]) -> tuple | None:
    owner, name = dotted(call.func.value), call.func.attr
    if owner is None:
        return None
    if "hashlib" in (owner, modules.get(owner, owner)):
        return _hash_call(call, name)
    rows = [r for r in apis.PYTHON_CALLS if r[1] == name]
    source = names.get(owner, "")
    # By the object's own name first, then by where the name was imported from.
    tests: list[Callable[[str], bool]] = [lambda p: owner == p or owner.endswith("." + p), source.endswith]
    return next((r[2:] for test in tests for r in rows if test(r[0])), None)


def crypto_calls(source: str | None) -> list[tuple[int, str, str, str]]:
    """(line, algorithm, severity, category) of the cryptographic calls of a source.

    An import counts from its place on, the last one of a name wins. Each call gives at most one row
    for what it calls, and one for each string argument that names an algorithm: hashlib.new("md5")
    gives two.
    """
    tree = parsed(source)
    modules: dict[str, str] = {}
    names: dict[str, str] = {}
    out = []
    for node in _in_order(tree) if tree is not None else ():
        if isinstance(node, ast.Import):
            modules.update({a.asname or a.name.rsplit(".", 1)[-1]: a.name for a in node.names})
        elif isinstance(node, ast.ImportFrom) and node.module is not None:
            for a in node.names:
                names[a.asname or a.name], modules[a.asname or a.name] = f"{node.module}.{a.name}", node.module
        elif isinstance(node, ast.Call):
            found = None
            if isinstance(node.func, ast.Attribute):
                found = _attribute_call(node, modules, names)
            elif isinstance(node.func, ast.Name):
                found = next((r[1:] for r in apis.PYTHON_MODULES if names.get(node.func.id, "").startswith(r[0])), None)
            rows = ([found] if found else []) + [r for t in _texts(node) if (r := apis.PYTHON_STRINGS.get(t.lower().strip()))]
            out += [(node.lineno, *r) for r in rows]
    return out


def _calls_by_function(source: str | None) -> list[tuple[str, str]]:
    """(function, callee), distinct: the calls inside each function, those of nested functions counting for the outer ones too."""
    tree = parsed(source)
    found = {}
    for node in ast.walk(tree) if tree is not None else ():
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for inner in ast.walk(node):
                if isinstance(inner, ast.Call) and (name := dotted(inner.func)):
                    found[node.name, name] = None
    return list(found)


def call_edges(module: str, source: str | None) -> list[tuple[str, str]]:
    """(caller, callee), distinct, of a module's source; a caller is module.function."""
    return [(f"{module}.{function}", callee) for function, callee in _calls_by_function(source)]


#: Equal contents meet in so many tasks at most, so that a very frequent one is no single task's work.
PLACES = 4
#: Characters of contents whose rows a task remembers.
REMEMBERED = 8 << 20


def _rows(sources: DataFrame, schema: str, kinds: list[pa.DataType], each: Callable[[str | None], list[tuple]], of: Callable[[str | None, list[tuple]], list[tuple]] = lambda _, rows: rows) -> DataFrame:
    """path and of(path, each(content)) of each source; equal contents are dealt to the same tasks, and a tree is built once for those that a task remembers."""
    names = ["path", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list[tuple]] = {}
        held, collects = 0, gc.isenabled()
        gc.disable()  # trees have no cycles, and going through them again and again takes as long as building them
        try:
            for batch in batches:
                rows = []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    if content not in known:
                        held += len(content or "")
                        if held > REMEMBERED:
                            known, held = {}, len(content or "")
                        known[content] = each(content)
                    rows += [(path, *r) for r in of(path, known[content])]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), *kinds])], names=names)
        finally:
            if collects:
                gc.enable()

    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.select("path", "content").repartition(parts, F.xxhash64("content"), F.pmod(F.xxhash64("path"), F.lit(PLACES)))
    return dealt.mapInArrow(run, f"path string, {schema}")


def scan_sources(sources: DataFrame) -> DataFrame:
    """(path, line, nth, algorithm, severity, category) of (path, content) rows; nth numbers a file's findings in order."""
    return _rows(sources, "line long, nth long, algorithm string, severity string, category string", [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], lambda c: [(r[0], i + 1, *r[1:]) for i, r in enumerate(crypto_calls(c))])


def edges_of(sources: DataFrame) -> DataFrame:
    """(path, caller, callee) of (path, content) rows; the module is the file's name without its extension."""

    def named(path: str | None, rows: list[tuple]) -> list[tuple]:
        module = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return [(f"{module}.{function}", callee) for function, callee in rows]

    return _rows(sources, "caller string, callee string", [pa.string(), pa.string()], _calls_by_function, named)
