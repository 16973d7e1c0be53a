"""Calls by structure, imports, backward slices and whole-scan documents on small fixtures, and the findings store over changing tables."""

import random
import re
import shutil

import pytest

from cipherlake.operators import slicing, structure
from cipherlake.plans import catalog, corpus

SF = "/root/testdata/sf0.001"


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, language string, content string")


def lines(spark, *files):
    rows = [(p, lang, i + 1, t) for p, lang, c in files if c for i, t in enumerate(c.split("\n"))]
    return spark.createDataFrame(rows, "path string, language string, line long, text string")


def test_arguments_across_lines_and_nested_functions(spark):
    go = 'package m\nfunc (s *Key) outer(a int) error {\n  inner := func() {\n    x.Load(a, [2]int{3, 4},\n      "b(" , g(7))\n  }\n}\n'
    js = "function a() {\n  function b() {\n    f(1, 'x', g(2));\n  }\n  h();\n}\nf(;"
    calls, functions = structure.calls_and_functions(sources(spark, ("p/m.go", "Go", go), ("p/w.js", "JavaScript", js), ("e.js", "JavaScript", None), ("n.js", "JavaScript", "")))
    got = {(r.path, r.callee): r for r in calls.collect()}
    load = got["p/m.go", "x.Load"]
    assert load.line == 4 and load.args == {0: "a", 1: "int", 2: '"b("', 3: "g"} and load.string == "b(" and load.number == 2
    assert got["p/w.js", "f"].args == {0: "1", 1: "'x'", 2: "g"} and ("p/w.js", "f") in got and got["p/w.js", "g"].number == 2
    assert {(r.path, r.name, r.line) for r in functions.collect()} == {("p/m.go", "outer", 2), ("p/w.js", "a", 1), ("p/w.js", "b", 2)}
    edges = {tuple(r) for r in structure.edges(calls, functions).collect()}
    assert edges == {("m.outer", "x.Load"), ("m.outer", "g"), ("w.a", "f"), ("w.a", "g"), ("w.a", "h"), ("w.b", "f"), ("w.b", "g")}


def test_sizes_by_position_keyword_and_alone(spark):
    rows = [
        ("a.go", "Go", 'import r "crypto/rsa"\nfunc f() { r.GenerateKey(rand.Reader, 4096); rsa.GenerateKey(q, 1) }'),
        ("b.go", "Go", "func f() { rsa.GenerateKey(rand.Reader,\n 2048) }"),
        ("c.java", "Java", "void f() { k.initialize(1023); k.initialize(1024); k.initialize(4096); }"),
        ("d.js", "JavaScript", "crypto.generateKeyPair('ec', { modulusLength: 1024 });"),
        ("e.c", "C/C++", "RSA_generate_key_ex(r, 512, e, 0); // RSA_new()"),
        ("f.cs", "C#", 'var r = RSA.Create(3072); var s = "RSA.Create(1)";'),
    ]
    calls, _ = structure.calls_and_functions(sources(spark, *rows))
    got = sorted((r.path, r.callee, r.key_size or 0, r.severity) for r in structure.crypto_calls(calls, structure.imports(lines(spark, *rows))).collect())
    assert got == [
        ("a.go", "r.GenerateKey", 4096, "CRITICAL"), ("b.go", "rsa.GenerateKey", 2048, "CRITICAL"), ("c.java", "k.initialize", 1024, "CRITICAL"), ("c.java", "k.initialize", 4096, "HIGH"),
        ("d.js", "crypto.generateKeyPair", 1024, "CRITICAL"), ("e.c", "RSA_generate_key_ex", 512, "CRITICAL"), ("f.cs", "RSA.Create", 3072, "CRITICAL"),
    ]


def plain_slice(text, target, var):
    """A slice by plain loops over the lines."""
    rows, met, now = text.split("\n"), {var}, var
    quoted = r"""["']([^"']+)["']"""
    for _ in range(3):
        hop = None
        for i in range(target - 2, max(-1, target - 50), -1):
            line, head = rows[i].strip(), rf"^{re.escape(now)}\s*=\s*"
            for pattern, kind, sure in ((quoted, "string", "HIGH"), (r"(\d+)", "integer", "HIGH")):
                if m := re.match(head + pattern, line):
                    return m[1], kind, i + 1, sure
            if (m := re.match(head + r"([a-zA-Z_]\w*)\s*$", line)) and m[1] not in met:
                met.add(m[1])
                hop = m[1], i + 1
                break
            if m := re.match(head + rf"""\w+\.get\s*\(\s*["'][^"']*["']\s*,\s*{quoted}\)""", line):
                return m[1], "string", i + 1, "MEDIUM"
            if re.match(head + rf"\w+\[{quoted}\]", line):
                return None, "variable", i + 1, "LOW"
            if "def " in line or "function " in line:
                for pattern, kind in ((quoted, "string"), (r"(\d+)", "integer")):
                    if m := re.search(rf"\b{re.escape(now)}\s*=\s*{pattern}", line):
                        return m[1], kind, i + 1, "MEDIUM"
        if hop is None:
            return None
        now, target = hop
    return None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slices_against_plain_loops(spark, seed):
    g = random.Random(seed)
    forms = ['{a} = "x{n}"', "{a} = {n}", "{a} = {b}", "{a} = {b}", '{a} = conf.get("k", "d{n}")', "{a} = conf['k']", 'def f({a}="t", {b}={n}):', "function f({a}=1, {b}='w') {{", "use({a})", "{a} == '{n}'", "{a} = {b} + 1", "  {a}={b}  ", ""]
    files = {f"f{k}": "\n".join(g.choice(forms).format(a=g.choice("pqrs"), b=g.choice("pqrs"), n=g.randrange(99)) for _ in range(g.choice([3, 60, 200]))) for k in range(6)}
    files["sparse"] = "\n".join(["p = q"] + ["-"] * 46 + ["q2 = p"] + ["-"] * 47 + ["r = q2", "-"])
    targets = [(p, i, v) for p, c in files.items() for i in range(1, c.count("\n") + 2) for v in ("p", "q", "r", "nothing")]
    rows = spark.createDataFrame([(p, i + 1, t) for p, c in files.items() for i, t in enumerate(c.split("\n"))], "path string, line long, text string")
    got = sorted((tuple(r) for r in slicing.backward_slices(rows, spark.createDataFrame(targets + targets[:5], "path string, line long, var string")).collect()), key=str)
    want = sorted(((p, i, v, *s[:2], s[2], s[3]) for p, i, v in targets if (s := plain_slice(files[p], i, v))), key=str)
    assert got == want and {w[6] for w in want} == {"HIGH", "MEDIUM", "LOW"}


def test_findings_follow_their_tables(spark, tmp_path):
    for t in ("lineitem", "orders"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    run = lambda: sum(r.n for r in catalog.queries()["severity_summary"](spark, str(tmp_path)).collect())
    columns = catalog.queries()["severity_summary"](spark, str(tmp_path)).columns
    count = next(c for c in columns if c not in ("project", "severity"))
    run = lambda: sum(r[count] for r in catalog.queries()["severity_summary"](spark, str(tmp_path)).collect())
    whole = run()
    half = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 2 = 0").toPandas()
    half.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    spark.catalog.clearCache()
    assert 0 < run() < whole
    assert run() == corpus.scan(spark, str(tmp_path)).where("NOT suppressed").count()
