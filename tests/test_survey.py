"""Scores, parsers, syntax trees, lexers and stores on small fixtures with known answers."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.functions import ciphers, lex, protocols
from cipherlake.operators import calls, graph, history, pyast, reports, scoring
from cipherlake.plans import dependencies
from cipherlake.sources import files, manifests

AS_OF = "2026-03-23"


def findings(spark, *rows):
    return spark.createDataFrame([(1, i, 1, 0, *r) for i, r in enumerate(rows)], "project long, file long, line long, ord long, algorithm string, severity string, category string, description string")


RSA = ("RSA", "CRITICAL", "key_exchange", "rsa")


def test_one_rsa_finding(spark):
    f = findings(spark, RSA)
    q = scoring.qars(f).first()
    assert round(q.score, 1) == 91.4 and q.grade == "F" and q.highest_risk_algo == "RSA"
    r = scoring.readiness(f, AS_OF).first()
    assert r.score <= 74 and r.grade in "CDF" and (r.shor, r.overdue, r.violations) == (1, 0, 1)
    assert {g.gate: g.passed for g in scoring.gate_results(f, AS_OF, ["pqc-ready", "no-critical", "nonsense"]).collect()} == {"pqc-ready": False, "no-critical": False, "nonsense": False}
    assert scoring.risk_score(findings(spark, RSA, *[("MD5", "HIGH", "hash", "")] * 3)).first().risk == 80


@pytest.mark.parametrize("row,check", [(("MD5", "HIGH", "hash", "md5"), lambda r: r.grade in "CDF"), (("AES-256", "INFO", "symmetric", ""), lambda r: r.algorithm_score == 100), (("RSA", "HIGH", "signature", "key_size=1024)"), lambda r: r.key_score == 70), (("RSA", "HIGH", "signature", "key_size=3072, x"), lambda r: r.key_score == 100), (("X", "LOW", "certificate", "mode=ecb"), lambda r: r.key_score == 80)])
def test_readiness_rules(spark, row, check):
    assert check(scoring.readiness(findings(spark, row), AS_OF).first())


def test_qars_parameters(spark):
    f = findings(spark, RSA, ("SHA-1", "MEDIUM", "hash", ""))
    score = lambda **o: scoring.qars(f, **o).first().score
    assert score(sensitivity="restricted", shelf=1, migration=1, threat=20) > score(sensitivity="public", shelf=1, migration=1, threat=20)
    assert score(shelf=20, migration=5, threat=10) > score(shelf=1, migration=1, threat=20)
    assert scoring.gate_results(findings(spark, ("SHA-1", "MEDIUM", "hash", "")), AS_OF, ["no-critical"]).first().passed


def test_deadlines(spark):
    d = scoring.deadlines(findings(spark, RSA, RSA, ("AES-256", "INFO", "symmetric", "")), AS_OF).collect()
    assert [(r.algorithm, r.category, r.deadline, r.days, r.urgency) for r in d] == [("RSA", "software_signing", "2030-12-31", 1744, "DISTANT")]
    late = scoring.deadlines(findings(spark, RSA, ("ECDSA", "HIGH", "signature", "")), "2031-06-01").collect()
    assert {r.algorithm: r.urgency for r in late} == {"RSA": "OVERDUE", "ECDSA": "APPROACHING"}


def test_manifest_folder(spark, tmp_path):
    texts = {
        "a/requirements.txt": "# no\n-r x\nPyCryptodome==3.1\nmy-rsa\n", "a/package.json": '{"dependencies": {"node-rsa": "1"}, "peerDependencies": {"jose": "2"}}', "b/pom.xml": "<groupId>org.bouncycastle</groupId>\n<artifactId>bcprov</artifactId><version>1.7</version>",
        "b/go.mod": "module x\n\ngo 1.21\nrequire (\n\tgolang.org/x/crypto v0.1.0 // indirect\n)", "c/Cargo.toml": "[dependencies]\nrsa = \"1\"\n[build-dependencies]\ncc = \"1\"\n[profile]\nring = 1", "c/yarn.lock": '"@scope/x@^1":\n  version "1"\nelliptic@^6.0.0, elliptic@^6.1:\n  version "6.5"\n',
        "c/package-lock.json": '{"dependencies": {"elliptic": {"version": "6.5"}}}', "node_modules/package.json": '{"dependencies": {"elliptic": "1"}}', "d/Pipfile.lock": "{broken",
    }
    for name, body in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = manifests.dependencies(manifests.read_manifests(spark, f"file://{tmp_path}"))
    known = {(r.path.rsplit("/", 1)[1], r.package, r.version, r.line, r.known, r.risk, r.is_transitive) for r in manifests.crypto_dependencies(found).collect()}
    assert known == {
        ("requirements.txt", "pycryptodome", "3.1", 3, "pycryptodome", "HIGH", False), ("requirements.txt", "my_rsa", None, 4, "rsa", "CRITICAL", False), ("package.json", "node-rsa", "1", 0, "node_rsa", "CRITICAL", False), ("package.json", "jose", "2", 0, "jose", "HIGH", False),
        ("pom.xml", "org.bouncycastle:bcprov", "1.7", 0, "org_bouncycastle", "HIGH", False), ("go.mod", "golang.org/x/crypto", "0.1.0", 5, "golang_org/x/crypto", "HIGH", False), ("Cargo.toml", "rsa", None, 2, "rsa", "CRITICAL", False), ("yarn.lock", "elliptic", "6.5", 4, "elliptic", "CRITICAL", True), ("package-lock.json", "elliptic", "6.5", 0, "elliptic", "CRITICAL", True),
    }


def test_bill_of_materials(spark):
    good = spark.createDataFrame([(1, '{"bomFormat": "CycloneDX", "components": [{"name": "Paramiko", "version": "3"}, {"name": "left-pad", "version": "1"}]}')], "doc long, content string")
    got = dependencies.enriched(dependencies.read_sbom(good)).collect()
    assert [(r.name, r.algorithms, r.status, r.risk) for r in got] == [("Paramiko", "ECDSA,Ed25519,RSA", "quantum-vulnerable", "critical")]
    with pytest.raises(Exception, match="not a bill of materials"):
        dependencies.read_sbom(spark.createDataFrame([(1, "{}")], "doc long, content string")).collect()


SOURCE = '''
import hashlib as h
from Crypto.PublicKey import RSA as R
from cryptography.hazmat.primitives.asymmetric.rsa import generate_private_key as g
def outer():
    def inner():
        return h.new("MD5")
    R.generate(2048)
    g(65537)
    pick(algorithm="rc4")
    x.y.rsa.generate_private_key()
    make()().md5()
'''


def test_syntax_tree(spark):
    rows = spark.createDataFrame([("src/m.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    got = [(r.line, r.algorithm, r.severity) for r in pyast.scan_sources(rows).orderBy("nth").collect()]
    assert got == [(7, "MD5", "HIGH"), (7, "MD5", "HIGH"), (8, "RSA", "CRITICAL"), (9, "RSA", "CRITICAL"), (10, "RC4", "HIGH"), (11, "RSA", "CRITICAL")]
    edges = {(r.caller, r.callee) for r in pyast.edges_of(rows).collect()}
    assert ("m.outer", "h.new") in edges and ("m.inner", "h.new") in edges and ("m.outer", "x.y.rsa.generate_private_key") in edges and ("m.inner", "R.generate") not in edges


def test_chains_and_orphans(spark):
    edges = spark.createDataFrame([("app.main", "auth.login"), ("auth.login", "crypto.sign"), ("auth.login", "crypto.md5"), ("crypto.sign", "RSA.generate"), ("app.main", "z"), ("z", "RSA.generate"), ("a.md5x", "b")], "caller string, callee string")
    starts = graph.entry_points(edges, ["main"])
    assert {r.node for r in starts.collect()} == {"app.main", "a.md5x"}
    paths = {r.node: (r.depth, r.path) for r in graph.shortest_paths(edges, starts).collect()}
    assert paths["RSA.generate"] == (2, "app.main>z>RSA.generate") and paths["crypto.md5"][0] == 2
    assert {(r.node, r.algorithm) for r in graph.sinks(edges, [("RSA.generate", "RSA"), ("md5", "MD5")]).collect()} == {("RSA.generate", "RSA"), ("crypto.md5", "MD5"), ("a.md5x", "MD5")}
    found = spark.createDataFrame([("auth", "RSA", "auth.py", 3, 1), ("auth", "MD5", "auth.py", 9, 1), ("app", "Unknown", "app.py", 1, 1)], "module string, algorithm string, file string, line long, ord long")
    got = {r.node: (r.algorithm, r.line) for r in graph.sinks_with_findings(edges, [("RSA.generate", "RSA"), ("md5", "MD5")], found).collect()}
    assert got["auth.login"] == ("MD5", 9) and got["RSA.generate"] == ("RSA", None) and "app.main" not in got


@pytest.mark.parametrize("language,text,want", [("Java", 'Cipher.getInstance("DESede/CBC/X")', ("3DES", "HIGH", "CBC")), ("Java", '// Cipher.getInstance("RSA")', None), ("Ruby", "k = OpenSSL::PKey::RSA.new(2048)", ("RSA", "CRITICAL", None)), ("PHP", "$x = md5($y);", ("MD5", "HIGH", None)), ("PHP", "$x = my_md5($y);", None), ("C#", "var k = RSA.Create();", ("RSA", "CRITICAL", None)), ("Swift", "P256.Signing.PrivateKey()", ("ECDSA", "CRITICAL", None)), ("Kotlin", 'MessageDigest.getInstance("SHA-1")', ("SHA-1", "MEDIUM", None)), ("Go", "x := mycrypto.Sign(y)", None)])
def test_calls_of_other_languages(spark, language, text, want):
    got = [(r.algorithm, r.severity, r.mode) for r in calls.scan_calls(spark.createDataFrame([(language, text)], "language string, text string")).collect()]
    assert got == ([want] if want else [])


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("function,text,kept", [(lex.blank_triple_strings, 'x = r"""a\nb"""\ny = "\'\'\'"', "x = \n\ny = \"'''\""), (lex.strip_ruby_blocks, "a\n=begin\nb\n=end\nc", "a\n\n\n\nc"), (lex.strip_markup_comments, "<a><!-- x\ny --></a><!-", "<a>\n</a><!-"), (lex.blank_triple_strings, "", "")])
def test_comment_families(spark, function, text, kept):
    assert one(spark, text, function(F.col("t"))) == kept


def test_relative_paths(spark):
    got = lambda path, root: spark.createDataFrame([(path, root)], "p string, r string").select(lex.relative_path(F.col("p"), F.col("r"))).first()[0]
    assert (got("/a/b/c.py", "/a/"), got("/x/y/z/c.py", "/a"), got("c.py", "/a"), got("/ab/c.py", "/a")) == ("b/c.py", "y/z/c.py", "c.py", "/ab/c.py")


def test_digests_and_numbers(spark):
    assert one(spark, "text ü", ciphers.hmac_sha256(F.lit("key"), F.col("t"))) == hmac.new(b"key", "text ü".encode(), hashlib.sha256).hexdigest()
    h = lambda b: hashlib.sha256(b).digest()
    leaves = [h(x.encode()) for x in "abc"]
    root = h(h(leaves[0] + leaves[1]) + h(leaves[2] + leaves[2])).hex()
    trees = spark.createDataFrame([(1, i, x) for i, x in enumerate("abc")] + [(2, 0, "z")], "tree long, pos long, text string")
    assert {r.tree: r.root for r in ciphers.merkle_roots(trees).collect()} == {1: root, 2: h(b"z").hex()}
    n = spark.createDataFrame([(7,), (1,), (561,), (2_147_483_647,), (25,)], "n long")
    assert [r[0] for r in n.select(ciphers.is_prime(F.col("n"))).collect()] == [True, False, False, True, False]
    assert {r.n: r.factors for r in ciphers.factors(n).collect()} == {7: [7], 1: [], 561: [3, 11, 17], 2_147_483_647: [2_147_483_647], 25: [5, 5]}
    row = n.limit(1).select(ciphers.gcd(F.lit(84), F.lit(36)), ciphers.power_mod(F.lit(3), F.lit(200), F.lit(13)), ciphers.inverse_mod(F.lit(3), F.lit(11)), ciphers.order_mod(F.lit(2), F.lit(7))).first()
    assert tuple(row) == (12, pow(3, 200, 13), 4, 3)


def test_ssh_keys_and_suites(spark):
    import base64
    import struct

    blob = struct.pack(">I", 7) + b"ssh-rsa" + struct.pack(">I", 3) + b"\1\0\1" + struct.pack(">I", 257) + b"\0" * 257
    r = one(spark, f"ssh-rsa {base64.b64encode(blob).decode()} me@host", protocols.public_key(F.col("t")))
    assert (r.algorithm, r.vulnerable, r.bits, r.comment) == ("RSA", True, 2048, "me@host")
    assert one(spark, "TLS_RSA_WITH_CAMELLIA_256", protocols.suite_parts(F.col("t"))).encryption is None


def test_history_store(spark, tmp_path):
    folder = f"file://{tmp_path}/history"
    assert history.read(spark, folder).isEmpty()
    older = spark.createDataFrame([('{"scan_id": 1, "scan_date": "2024-01-02T03:04:05.6", "scan_path": "/srv/p", "risk_score": 9, "algorithms": {"RSA": 2}}',), ("{oops",), ('{"scan_id": 2, "scan_date": "never", "scan_path": "/srv/p"}',)], "value string")
    assert history.migrate(history.import_json(older), folder) and not history.migrate(history.import_json(older), folder)
    rows = history.read(spark, folder).orderBy("ts").collect()
    assert [(r.scan_id, r.project, r.risk, r.algorithms) for r in rows] == [(2, "p", 0, []), (1, "p", 9, ["RSA"])]
    assert history.trends(history.read(spark, folder)).first().direction == "declining" and history.retained(history.read(spark, folder), 1).first().scan_id == 1
    values = spark.createDataFrame([(list(range(40)),), ([5, 5],)], "v array<long>")
    assert [r[0] for r in values.select(history.sparkline(F.col("v"))).collect()][1] == "  "


def test_csv_and_diff(spark):
    assert one(spark, 'a "b", c', reports.csv_line(F.col("t"), F.lit(1), F.lit(None))) == '"a ""b"", c",1,'
    assert one(spark, "x", reports.unified_diff(F.lit("s/a.py"), F.lit(4), F.col("t"), F.lit("y"))) == "--- a/a.py\n+++ b/a.py\n@@ -4,1 +4,1 @@\n-x\n+y\n"
    assert one(spark, "ML-KEM-768 or MLKEM768", reports.upgraded(F.col("t"))) == "ML-KEM-1024 or MLKEM1024"
    assert one(spark, "ssl_protocols TLSv1 TLSv1.2;", reports.fixed_text(F.col("t"), F.lit(".cfg"), F.lit("Old TLS"))) is not None


def test_first_files_are_chosen_before_reading(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.py").write_bytes(b"x = 1 # \xff\n")
    got = files.walk(spark, f"file://{tmp_path}", max_files=2).orderBy("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["f0.py", "f1.py"] and got[0].content == "x = 1 # \n"
    assert files.walk(spark, f"file://{tmp_path}").count() == 5 and len(dims.COMPLIANCE) == 42
