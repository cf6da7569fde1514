import pytest
from pyspark.sql import functions as F

from topolane.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, n", [("", 0), (None, None), ("fn render_map(a: &str) -> Result<()> {", 14), ("🔐 secret", 5), (" ", 2), ("a" * 300, 105)])
def test_estimate(spark, text, n):
    assert one(spark, X.estimate_tokens, text) == n


def test_redaction(spark):
    text = "a\nXAI_KEY=abc\nAuthorization: Bearer q\n" + "x" * 200 + "\n" * 20
    lines = one(spark, X.redact_text, text).split("\n")
    assert lines[:3] == ["a", "[REDACTED]", "[REDACTED]"] and len(lines[3]) == 160 and len(lines) == 12


@pytest.mark.parametrize("pattern, path, hit", [("*.rs", "lib.rs", True), ("*.rs", "src/lib.rs", False), ("**/*.rs", "src/a/lib.rs", True), ("**/*.rs", "lib.rs", True), ("src/?.rs", "src/a.rs", True), ("src/?.rs", "src/ab.rs", False)])
def test_glob(spark, pattern, path, hit):
    assert one(spark, lambda c: X.glob_matches(c, pattern), path) is hit


@pytest.mark.parametrize("path, normal", [("./src\\core/", "src/core"), ("/", ""), ("a/b", "a/b"), ("././x", "x"), (None, None)])
def test_normal_path(spark, path, normal):
    assert one(spark, X.normalize_path, path) == normal


def test_words_and_suffixes(spark):
    assert one(spark, X.identifier_words, "AnalysisHost_v2") == ["analysis", "host", "v2"]
    assert one(spark, X.suffix_keys, "A::B::c") == ["A::B::c", "B::c", "c"]
    assert one(spark, lambda c: X.truncate(c, 4), "abcdef") == "abc…"


@pytest.mark.parametrize("q, intent", [("please continue", "resume"), ("what tests are affected", "change"), ("How does a reach b", "flow"), ("show code of x", "inspect"), ("where is x", "locate")])
def test_intent(spark, q, intent):
    assert one(spark, X.classify_intent, q) == intent
