"""The command line on small folders: exit codes, documents, baselines, rule files, ignore files, gates."""

import json

import pytest

from cipherlake import __main__ as cli
from cipherlake.operators import reports
from cipherlake.sources import baseline, documents, rules

RSA = "key = rsa.generate_private_key(public_exponent=65537, key_size=2048)\n"
SHA1 = "digest = hashlib.sha1(data)\n"


@pytest.fixture
def project(tmp_path):
    at = tmp_path / "project"
    (at / "src").mkdir(parents=True)
    (at / "src" / "clean.py").write_text("print('hello')\n")
    return at


def run(*arguments):
    return cli.main(["scan", *map(str, arguments)])


def test_exit_codes_and_gates(spark, project, capsys):
    assert run(project) == 0
    (project / "src" / "b.py").write_text(SHA1)
    assert run(project) == 1 and "SHA-1 at " in capsys.readouterr().out
    assert run(project, "--severity", "critical") == 0
    (project / "src" / "a.py").write_text(RSA)
    assert run(project) == 2
    (project / ".pqcignore").write_text("# generated\n\na.py\n")
    assert run(project) == 1
    assert run(project, "--ignore", "b.py") == 0


def test_gate_judges_what_the_report_leaves_out(spark, project):
    (project / "src" / "b.py").write_text(RSA)
    assert run(project, "--baseline", project / "none.json") == 2
    assert run(project, "--format", "json", "--output", project / "was.json") == 2
    assert run(project, "--baseline", project / "was.json") == 0
    assert run(project, "--baseline", project / "was.json", "--gate", "no-critical") == 3


def test_baseline_new_existing_fixed(spark, project, capsys):
    (project / "src" / "a.py").write_text(RSA + SHA1)
    run(project, "--format", "json", "--output", project / "was.json")
    data = json.loads((project / "was.json").read_text())
    assert data["summary"]["CRITICAL"] >= 1 and sum(data["summary"].values()) == len(data["findings"])
    (project / "src" / "a.py").write_text("\n" + RSA + "x = 1\n")
    capsys.readouterr()
    assert run(project, "--baseline", project / "was.json") == 2
    assert f"0 existing, {len({(f['line'], f['algorithm'], f['category']) for f in data['findings']})} fixed" in capsys.readouterr().out
    # A document that names files by another root and key, whole on several lines.
    old = {"findings": [{"file": f["path"].replace("file:", ""), "line": f["line"], "algorithm": f["algorithm"], "category": f["category"]} for f in data["findings"]]}
    (project / "old.json").write_text(json.dumps(old, indent=2))
    assert baseline.read_baseline(spark, f"file://{project}/old.json").count() == len(data["findings"])
    for bad in ("no json", "[]", ""):
        (project / "bad.json").write_text(bad)
        assert baseline.read_baseline(spark, f"file://{project}/bad.json").count() == 0


def test_rule_files_are_added_without_merging(spark, project):
    yaml = pytest.importorskip("yaml")
    (project / "src" / "a.py").write_text("token = mycipher(1) or mycipher(2)\n")
    entries = [{"id": "one", "pattern": "mycipher", "severity": "critical", "algorithm": "Mine"}, {"id": "two", "pattern": "MYCIPHER", "algorithm": "Mine"}, {"id": "bad", "pattern": "("}, {"pattern": "x"}, {"id": "go", "pattern": "mycipher", "languages": ["go"]}]
    (project / ".pqcrules.yml").write_text(yaml.safe_dump({"rules": entries}))
    assert [r[0] for r in rules.find_rules(str(project / "src"))] == ["one", "two", "go"]
    rows = cli.scan(spark, str(project)).where("algorithm = 'Mine'").collect()
    assert sorted(r.severity for r in rows) == ["CRITICAL", "MEDIUM"]


def test_rules_without_a_file():
    assert rules.rule_of({"id": "x", "pattern": "a", "severity": "odd", "category": "odd"}) == ("x", "MEDIUM", "symmetric", "Custom", "(?i)a", ",".join(rules.LANGUAGES))
    assert rules.rule_of({"id": "x", "pattern": None}) is None and rules.rule_of("x") is None and rules.read_rules("/nowhere") == []


def test_whole_scan_sarif_is_one_document(spark, tmp_path):
    rows = [(f"p{i % 7}/f{i % 40}.py", i % 90 + 1, i % 3, ["RSA", "MD5", "AES-128", 'o"dd'][i * 7 % 4], ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"][i % 5], "hash", f'say "{i}"\t,\\') for i in range(1000)]
    found = spark.createDataFrame(rows, "path string, line long, ord int, algorithm string, severity string, category string, snippet string").distinct()
    documents.write_parts(reports.scan_sarif(found.repartition(5)), f"file://{tmp_path}/parts")
    documents.merge_parts(spark, f"file://{tmp_path}/parts", f"file://{tmp_path}/scan.sarif")
    run_ = json.loads((tmp_path / "scan.sarif").read_text())["runs"][0]
    names = [r["name"] for r in run_["tool"]["driver"]["rules"]]
    place = lambda r: r["locations"][0]["physicalLocation"]
    got = [(place(r)["artifactLocation"]["uri"], place(r)["region"]["startLine"], names[r["ruleIndex"]], place(r)["region"]["snippet"]["text"]) for r in run_["results"]]
    want = sorted({(r[0], r[1], r[2], r[3], r[6]) for r in rows})
    assert sorted(got) == sorted((a, b, d, e) for a, b, _, d, e in want) and [g[:2] for g in got] == [w[:2] for w in want]
    assert names == list(dict.fromkeys(w[3] for w in want))
    documents.write_parts(reports.scan_sarif(found.limit(0)), f"file://{tmp_path}/none")
    documents.merge_parts(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/none.sarif")
    assert json.loads((tmp_path / "none.sarif").read_text())["runs"][0]["results"] == []
