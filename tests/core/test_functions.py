"""Truth tables of the scalar functions and predicates."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import predicates as p
from palisade.functions import registry, text


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", f("c").alias("x")).orderBy("i").collect()]


CASES = [
    (text.trim, ["\t a \n", "\u00a0b ", ""], ["a", "b", ""]),
    (text.dominant_eol, ["a\r\nb\n", "a\r\nb\r\nc\n", "", "x\n"], ["\n", "\r\n", "\n", "\n"]),
    (text.has_trailing_newline, ["a\n", "a", ""], [True, False, False]),
    (lambda c: text.reencode_eol(c, F.lit("\r\n")), ["a\nb\r\n", "x"], ["a\r\nb\r\n", "x"]),
    (text.lines, ["a\r\nb\n", "a\n\nb", "", "\n"], [["a", "b"], ["a", "", "b"], [], [""]]),
    (lambda c: text.join_lines(text.lines(c), F.col(c)), ["a\r\nb\r\n", "a\nb", "a\r\nb\n"], ["a\r\nb\r\n", "a\nb", "a\nb\n"]),
    (lambda c: text.rel_path(c, F.lit("/r/")), ["/r/a/b", "/x/a"], ["a/b", "/x/a"]),
    (text.path_depth, ["a", "a/b/c"], [1, 3]),
    (text.ext, ["a/b.test.js", ".env", "Makefile", "x.PY"], ["js", None, None, "PY"]),
    (text.strip_tag, ["cli-v1.2.3", "v1", "1"], ["1.2.3", "1", "1"]),
    (text.parse_version, ["v1.2.3", "1.x", "2"], [[1, 2, 3], None, [2]]),
    (lambda c: text.is_newer(F.lit("1.2"), F.col(c)), ["1.2.1", "1.10", "1.2.0.9", "1.1.9", "x"], [True, True, False, False, False]),
    (text.unquote, ['"a"', "'b'", '"', "'a\"", "a"], ["a", "b", '"', "'a\"", "a"]),
    (text.mask_key, ["pg_live_abcdefgh", "pg_abcdef", "pg_abcd", "secretkey", "abc", ""], ["pg_live_…efgh", "pg_…cdef", "*******", "…tkey", "***", ""]),
    (lambda c: text.truncate_chars(c, 2), ["éàx", "a"], ["éà", "a"]),
    (p.is_valid_key, ["pg_live_demo_0123", "pg_demo_01234567", "sk_live_abc123456", "", "pg_ 0123456789012"], [True, True, False, False, False]),
    (p.is_loopback, ["http://127.9.0.1/x", "http://[::1]:8080", "http://LOCALHOST:3", "http://127.0.0.1.evil.com", "nonsense"], [True, True, True, False, False]),
    (p.is_valid_proxy_url, ["https://a.b/c", "http://localhost:8080", "http://a.b", "https://a b", 'https://a"b', "ftp://a"], [True, True, False, False, False, False]),
    (p.is_trusted_host, ["https://api.example.com/v1", "http://localhost", "https://api.example.com.evil.net"], [True, True, False]),
    (p.is_allowed_target, ["https://api.example.com/x", "http://api.example.com/x", "http://127.0.0.1:1", "https://evil.net"], [True, False, True, False]),
    (p.is_safe_env_path, [".env", "a/.env", "../.env", "/etc/x", "C:\\x", "\\\\s\\x", "a\\..\\b", "a..b"], [True, True, False, False, False, False, False, True]),
    (p.is_valid_backup_ext, [".bak", "bak", ".", ".b/k", ".b\n"], [True, False, False, False, False]),
    (p.is_valid_env_name, ["API_KEY", "_A1", "a", "1A", "A-B", ""], [True, True, False, False, False, False]),
    (lambda c: p.has_env_key(c, "K"), ["K=1", "export K=", " K=1", "AK=1", "x\nK=2"], [True, True, False, False, True]),
    (lambda c: p.is_ignored(c, ".env"), [".env", "a\n /.env \nb", ".env.local", "#.env"], [True, True, False, False]),
    (p.is_api_related, ["DATABASE_URL", "my_token", "NAME"], [True, True, False]),
    (registry.parse_provider, ["HF", "google", "aws-bedrock", "AWS", "openai", "x"], ["huggingface", "gemini", "bedrock", "bedrock", "openai", None]),
    (registry.has_runtime, ["openai", "groq"], [True, False]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_function(spark, case):
    f, given, want = CASES[case]
    assert apply(spark, f, given) == want


def test_retryable(spark):
    rows = [("GET", 503, None, True), ("GET", 429, None, False), ("GET", None, "timeout", True), ("POST", 503, None, False), ("POST", None, "connect", True), ("POST", None, "timeout", False)]
    df = spark.createDataFrame(rows, "m string, s int, k string, want boolean")
    assert df.filter(p.is_retryable("m", "s", "k") != F.col("want")).count() == 0


def test_percent(spark):
    assert apply(spark, lambda c: text.pct(F.col(c).cast("double"), 1), ["0.956", "1"]) == ["95.6%", "100.0%"]
    assert apply(spark, lambda c: text.pct(F.col(c).cast("double"), 0), ["0.956"]) == ["96%"]


def test_host_split(spark):
    df = spark.createDataFrame([("env", "config", "https://evil.net", False, True), ("config", "config", "https://evil.net", False, False), ("env", "config", "http://localhost", False, False), ("env", "config", "https://evil.net", True, False)], "k string, u string, url string, ok boolean, want boolean")
    assert df.filter(p.is_host_split("k", "u", "url", "ok") != F.col("want")).count() == 0


def test_providers(spark):
    assert registry.providers(spark).count() == 7 and registry.providers(spark).filter("ts_base_url_param is null").count() == 2
