"""What the findings of round 3 named, on small fixtures."""

import math

from pyspark.sql import functions as F

from cipherlake.functions import lex, residues
from cipherlake.functions import protocols as p
from cipherlake.operators import graph, pyast, structure
from cipherlake.plans import corpus, protocols


def test_f6_lengths_beyond_three_bytes(spark, tmp_path):
    ids = [0, 255, 2_396_745, 2_396_746, 6_000_000, 40_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.kind, r.length) for r in protocols.QUERIES["tls_handshake"](spark, str(tmp_path)).collect()}
    assert got == {i: (i % 256, i * 7) for i in ids}
    row = spark.range(1).select(p.handshakes(F.unhex(F.lit("02FFFFFF02000003"))).alias("a"), p.handshakes(F.unhex(F.lit("0B00010A"))).alias("b"), p.handshakes(F.lit(None).cast("binary")).alias("c")).first()
    assert tuple(row.a) == (2, 16_777_218) and tuple(row.b) == (11, 266) and row.c.length is None


def test_f1_f4_tokens_are_no_rows_and_no_call_is_lost(spark):
    rows = [("a.go", "Go", "f(1)"), ("b.go", "Go", "/* g( */\n\nfunc h() {\n k(x[1], 2)\n}\n}}\n(("), ("c.java", "Java", None)]
    calls, functions = structure.calls_and_functions(spark.createDataFrame(rows, "path string, language string, content string"))
    assert [(r.path, r.pos, r.line, r.callee, r.args, r.owners) for r in calls.orderBy("path").collect()] == [("a.go", 1, 1, "f", {0: "1"}, []), ("b.go", 6, 4, "k", {0: "x", 1: "2"}, ["h"])]
    assert [tuple(r) for r in functions.collect()] == [("b.go", "h", 3, 5, 15)]
    for part in (calls, functions):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan


def test_f2_f3_f8_sources_are_parsed_once(spark):
    rows = [("a/m.py", "def f(x):\n    rsa.new(x)\n"), ("b/m.py", "def f(x):\n    rsa.new(x)\n"), ("n.py", None), ("o.py", "def main(:")]
    edges = pyast.edges_of(spark.createDataFrame(rows, "path string, content string"))
    assert sorted(tuple(r) for r in edges.collect()) == [("a/m.py", "m.f", "rsa.new"), ("b/m.py", "m.f", "rsa.new")]
    edges = edges.select("caller", "callee")
    entries, sinks = graph.entry_points(edges, ["main"]), graph.sinks(edges, [("rsa", "RSA")])
    assert [r.node for r in entries.collect()] == ["m.f"] and [tuple(r) for r in sinks.collect()] == [("rsa.new", "RSA")]
    found = spark.createDataFrame([("m", "RSA", "a/m.py", 2, 1)], "module string, algorithm string, file string, line long, ord long")
    both = graph.sinks_with_findings(edges, [("rsa", "RSA")], found)
    assert sorted(map(str, (tuple(r) for r in both.collect()))) == ["('m.f', 'RSA', 'a/m.py', 2)", "('rsa.new', 'RSA', None, None)"]
    for df in (entries, sinks, both):
        assert df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1


def test_f12_residues_take_as_many_steps_as_their_bits(spark):
    rows = spark.createDataFrame([(a, n) for n in (1, 3, 15, 105, 2**31 - 1) for a in (0, 1, 2, n - 1, 7 * n + 4, 2_000_000_011)], "a long, n long")

    def jacobi(a, n):
        a, t = a % n, 1
        while a:
            while a % 2 == 0:
                a, t = a // 2, -t if n % 8 in (3, 5) else t
            a, n, t = n, a, -t if a % 4 == 3 and n % 4 == 3 else t
            a %= n
        return t if n == 1 else 0

    inverse = lambda a, n: pow(a, -1, n) if math.gcd(a, n) == 1 else None
    got = rows.select("a", "n", residues.jacobi(F.col("a"), F.col("n")).alias("j"), residues.inverse(F.col("a"), F.col("n")).alias("i")).collect()
    assert [(r.j, r.i) for r in got if r.n > 1] == [(jacobi(r.a, r.n), inverse(r.a, r.n)) for r in got if r.n > 1]
    powers = [4, 5, 2**52, 3**33, 3**33 - 1, 7**18, 94_906_265**2, 94_906_265**2 - 1, 10**15, 6**20]
    best = {n: max(((round(n ** (1 / k)), k) for k in range(2, 53) if round(n ** (1 / k)) ** k == n), key=lambda x: x[1], default=None) for n in powers}
    found = spark.createDataFrame([(n,) for n in powers], "n long").select("n", residues.perfect_power(F.col("n")).alias("p")).collect()
    assert {r.n: r.p and tuple(r.p) for r in found} == best
    assert "sequence(1, 128" not in str(residues.jacobi(F.col("a"), F.col("n")))


def test_f12_f20_rows_are_spread_and_words_go_in_runs(spark):
    assert corpus.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 16
    texts = ["a = r'''x\ny''' + b\"\"\"z\n\"\"\"", "xr\"\"\"a\nb\"\"\"", "bar \"'''\" r'q' '''u\n", "rb'''\n''' f\"\"\"\n\n\"\"\" rr", "word " * 500 + "'''\n\n'''", "r", ""]
    want = ["a = \n + \n", "xr\n", texts[2], "\n \n\n rr", "word " * 500 + "\n\n", "r", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    assert [r.x for r in df.select(lex.blank_triple_strings(F.col("t")).alias("x")).collect()] == want
    code = ["x // y", "s = \"//\" /* a\n*/ // b", "/* // */ k", "a / b * c"]
    df = spark.createDataFrame(list(enumerate(code)), "k int, t string").orderBy("k")
    assert [r.x for r in df.select(lex.code_only(F.col("t"), F.lit("Go")).alias("x")).collect()] == ["x ", "s = \"//\" \n ", " k", "a / b * c"]
