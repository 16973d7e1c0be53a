"""File sources, manifest parsers, bit functions and streams on small fixtures."""

from pyspark.sql import functions as F

from cipherlake.functions import bits
from cipherlake.operators.match import scan_lines
from cipherlake.sources import files
from cipherlake.streaming import continuous


def test_walk_and_scan(spark, tmp_path):
    for name, body in {"src/a.py": "# md5\nk = rsa.generate_private_key(65537)\n", "node_modules/b.py": "hashlib.md5(x)", "c.txt": "RSA", "gen/d.go": "import \"crypto/rsa\"", "e.c": "/* RSA_new\n */\nMD5_Init(&c);"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = scan_lines(files.lines_of(files.walk(spark, f"file://{tmp_path}", ignore=["gen/*"]))).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.line, r.algorithm) for r in found) == [("a.py", 2, "RSA"), ("e.c", 3, "MD5")]
    (tmp_path / "ignore").write_text("# no\n\n gen/* \n*.min.js\n")
    assert files.ignore_patterns(spark, f"file://{tmp_path}/ignore") == ["gen/*", "*.min.js"]


def lines(spark, text):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text.split("\n"))], "path string, line long, text string")


def test_manifests(spark):
    got = files.requirements(lines(spark, "# x\n-r y\nrsa==4.9\npynacl\n jose[a] >= 1.2 ; x")).orderBy("line").collect()
    assert [(r.package, r.version) for r in got] == [("rsa", "4.9"), ("pynacl", None), ("jose", "1.2")]
    got = files.toml_lock(lines(spark, 'a = 1\n[[package]]\nname = "x"\nversion = "1"\n[[package]]\nname = "y"\nversion = "2"')).orderBy("line").collect()
    assert [(r.line, r.package, r.version) for r in got] == [(2, "x", "1"), (5, "y", "2")]
    assert files.go_sum(lines(spark, "m v1.0.0 h1:a\nm v1.0.0/go.mod h1:b\nn v2.0.0 h1:c")).count() == 2
    one = spark.createDataFrame([("p", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}')], "path string, content string")
    assert sorted((r.package, r.version) for r in files.package_json(one).collect()) == [("a", "1"), ("b", "2")]


def test_bits(spark):
    a, b = (F.transform(F.split(F.lit(t), ""), lambda c: F.ascii(c)) for t in ("this is a test", "wokka wokka!!!"))
    row = spark.range(1).select(bits.hamming(a, b).alias("h"), bits.unpadded(F.array(*map(F.lit, [1] * 12 + [4] * 4))).alias("ok"), bits.unpadded(F.array(*map(F.lit, [1] * 13 + [5, 5, 4]))).alias("bad"), bits.repeated_blocks(F.array_repeat(F.lit(1), 32)).alias("rep"), bits.cipher_suite(F.lit("TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256")).alias("c"), bits.tls_record(F.unhex(F.lit("1603010200"))).alias("t"), bits.pqc_groups(F.array(F.lit("X25519MLKEM768"), F.lit("x25519"))).alias("g")).first()
    assert row.h == 37 and row.ok == [1] * 12 and row.bad is None and row.rep and (row.c.kex, row.c.auth, row.c.encryption) == ("ECDHE", "RSA", "AES_128_GCM_SHA256") and (row.t.kind, row.t.length) == (22, 512) and row.g == ["X25519MLKEM768"]


def test_stream_counts(spark):
    sf = "/root/testdata/sf0.001"
    got = continuous.run_once(continuous.tumbling_counts(continuous.event_stream(spark, sf)))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
