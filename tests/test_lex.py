"""Lexing expressions on small literal lines."""

import pytest
from pyspark.sql import functions as F

from cipherlake.functions import lex


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("text,language,kept", [("x = 1  # md5", "Python", "x = 1  "), ("s = '# no'  # yes", "Python", "s = '# no'  "), ("a(); // rsa", "Java", "a(); "), ('s = "/* in */";', "Java", 's = "/* in */";'), ("a /* x\ny */ b", "Go", "a \n b"), ("# kept", "Unknown", "# kept")])
def test_comments(spark, text, language, kept):
    assert one(spark, text, lex.code_only(F.col("t"), F.lit(language))) == kept


@pytest.mark.parametrize("line,algorithm,expected", [("x  # pqc-ignore", "RSA", True), ("x  # pqc-ignore[rsa, MD5]", "RSA", True), ("x  # pqc-ignore[MD5]", "RSA", False), ("x", "RSA", False)])
def test_suppression(spark, line, algorithm, expected):
    assert one(spark, line, lex.suppressed(F.col("t"), F.lit(algorithm))) is expected


def test_blank_strings_and_snippet(spark):
    assert one(spark, "f('RSA', \"MD5\")", lex.blank_strings(F.col("t"))) == "f('', \"\")"
    assert one(spark, "  a b \t", lex.snippet(F.col("t"))) == "a b"
    assert one(spark, "token = abc", lex.redact(F.col("t"))) == "token=[REDACTED]"


BODY = "MIIEow9+" * 8
GONE = "[REDACTED-SECRET]"


@pytest.mark.parametrize("text,kept", [
    (f"a -----BEGIN RSA PRIVATE KEY-----\n{BODY}\nMIIb\n-----END RSA PRIVATE KEY----- b", f"a {GONE} b"), ("-----BEGIN X----- b", f"{GONE} b"),
    ("passwd = 'two words' x", f"{GONE} x"), ('pwd: "p"', GONE), ("password='a b'", GONE), ("api-key = 'k 1'", GONE), ("auth_token: 'k'", GONE), ("aws_access_key_id = 'AKIA 1'", GONE),
    ("x ghp_" + "a1" * 15, f"x {GONE}"), ("x sk-" + "a1" * 15, f"x {GONE}"), ("x xoxb-12345-abcde", f"x {GONE}"), (f"x {BODY}== y", "x [BASE64] y"), ("a" * 32 + " me@a.org", "[HEX] [EMAIL]"), ("lower/case/path/" * 4, "lower/case/path/" * 4), (None, None),
])
def test_redaction(spark, text, kept):
    assert spark.createDataFrame([(text,)], "t string").select(lex.redact(F.col("t"))).first()[0] == kept
