"""Scalar functions on small hand-made values."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import names, scoring, text
from wardline.operators import rules


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(column).first()[0]


@pytest.mark.parametrize("value,bits", [("", 0.0), ("aaaa", 0.0), ("abcd", 2.0), ("aab", 0.9183), ("a\nb\n", 1.5), ("é😀", 1.0)])
def test_entropy(spark, value, bits):
    assert one(spark, text.char_entropy(F.col("s")), s=value) == bits
    assert one(spark, text.document_entropy(F.col("s")), s=value) == bits


def test_entropy_case(spark):
    assert one(spark, text.char_entropy_ci(F.col("s")), s="aAbB") == 1.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=40))
def test_entropy_matches_definition(spark, s):
    n = len(s)
    want = -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0
    assert one(spark, text.domain_entropy(F.col("s")), s=s) == pytest.approx(want, abs=1e-9)


def test_byte_entropy(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(b""),), (bytearray(b"aabb"),)], "b binary")
    assert [r[0] for r in df.select(text.byte_entropy(F.col("b"))).collect()] == [8.0, 0.0, 1.0]


def test_bigram_and_consonants(spark):
    assert one(spark, text.bigram_score(F.col("s")), s="a") == 0.5
    assert one(spark, text.bigram_score(F.col("s")), s="123") == 0.0
    assert one(spark, text.bigram_score(F.col("s")), s="the") == 1.0  # (3.56 + 3.07) / 2 / 2 is above 1
    assert one(spark, text.consonant_ratio(F.col("s")), s="123") == 0.5
    assert one(spark, text.consonant_ratio(F.col("s")), s="abc") == pytest.approx(2 / 3)


@pytest.mark.parametrize("message,want", [
    ("powershell -enc " + "RwBlAHQALQBEAGEAdABlAA==", "Get-Date"),
    ("powershell -e RwBlAHQALQBEAGEAdABlAA", "Get-Date"),
    ("powershell -enc short", None), ("nothing", None),
    ("x -enc AAAAAAAAAAAAAAAAAAAAA", None)])
def test_decode_powershell(spark, message, want):
    assert one(spark, text.decode_powershell(F.col("s")), s=message) == want


def test_decode_replaces_malformed_units(spark):
    assert one(spark, text.decode_powershell(F.col("s")), s="-enc RwBlAHQALQBEAGEAdABlAGE=").endswith("\ufffd")


def test_sensitive_data(spark):
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111 and 123-45-6789"), (2, "nothing")], "id int, body string")
    out = rules.sensitive_data_scan(df, "body")
    assert "body" not in out.columns
    assert {p["pattern"]: p["count"] for p in out.first()["patterns_found"]} == {"credit_card": 1, "ssn": 1}
    assert out.count() == 1


def test_names(spark):
    assert one(spark, names.base_domain(F.col("s")), s="a.b.example.com.") == "example.com"
    assert one(spark, names.base_domain(F.col("s")), s="localhost") == "localhost"
    assert one(spark, names.subdomain(F.col("s")), s="a.b.example.com") == "a.b"
    assert one(spark, names.subdomain(F.col("s")), s="example.com") == ""
    parts = one(spark, names.url_parts(F.col("s")), s="Example.com:8080/p/a?x=1#f")
    assert (parts.host, parts.path, parts.query, parts.port) == ("example.com", "/p/a", "x=1", 8080)
    assert one(spark, names.brand_similarity(F.col("s")), s="paypa1.com") == pytest.approx(0.8333)
    assert one(spark, names.dga_confidence(F.col("s")), s="xkqzvbwpjtrm9f.com") >= 0.6
    assert one(spark, names.dga_confidence(F.col("s")), s="google.com") == 0.0


def test_jaccard(spark):
    df = spark.createDataFrame([([], []), (["a"], ["b"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(text.jaccard_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, pytest.approx(2 / 3)]


def test_priority_and_route(spark):
    p = lambda *a, **k: one(spark, scoring.priority(F.lit(a[0]), F.lit(a[1]), **k))
    assert p("critical", 0.9) == 90.0 and p("low", 0.3) == 6.0
    assert p("high", 1.0, context=2.0, intel=2.0) == 100.0
    routes = [one(spark, scoring.route_priority(F.lit(v))) for v in (80, 79.99, 60, 30, 29.9)]
    assert routes == ["fullscreen", "toast", "toast", "tray", "log"]


def test_ja3(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    none = F.array().cast("array<int>")
    assert one(spark, text.ja3_string(F.lit(771), a(1, 2), none, a(29), a(0))) == "771,1-2,,29,0"


def test_anonymize(spark):
    assert one(spark, text.anonymize_text(F.col("s")), s="at c:\\users\\Ann\\x and C:\\Users\\bo\\y") == "at c:\\users\\<USER>\\x and C:\\Users\\<USER>\\y"
