import hashlib
import json
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import hashing, numeric, privacy, quality, text
from millrace.operators import dedupe
from millrace.operators.clean import alias_map
from millrace.operators.shape import flatten_json


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


NESTED = {"user": {"name": "John Doe", "address": {"street": "1 Main", "city": "New York"}}, "items": ["a", "b", "c"], "score": 5}


def test_flatten_json():
    flat = flatten_json(NESTED)
    assert flat["user.name"] == "John Doe" and flat["user.address.city"] == "New York" and flat["score"] == 5
    assert json.loads(flat["items"]) == ["a", "b", "c"]
    assert flatten_json({}) == {} and flatten_json(None) == {} and flatten_json({"a": {}}) == {} and flatten_json(3, "v") == {"v": 3}


@settings(deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers() | st.text(max_size=5) | st.none(), max_size=5))
def test_flatten_keeps_flat_rows(row):
    assert flatten_json(row) == row


def signature(words, hashes=64):
    if not words:
        return [0] * hashes
    return [min(int.from_bytes(hashlib.sha256(f"{w}|{s}".encode()).digest()[:8], "big") for w in words) for s in range(hashes)]


def windows(value, k=5):
    value = value.lower()
    return {value[i : i + k] for i in range(len(value) - k + 1)}


CASES = ["John Smith john@example.com", "abcde", "abc", "", "Ünïcödé Straße", "aaaaaaaa", "x" * 60]


def test_minhash_is_bit_exact(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "v string").select("v", hashing.minhash(hashing.shingles(F.col("v"))).alias("s"))
    for r in rows.collect():
        assert [int(x) for x in r["s"]] == signature(windows(r["v"]))


def test_buckets(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "v string").withColumn("s", hashing.minhash(hashing.shingles(F.col("v")))).select("v", hashing.lsh_buckets(F.col("s")).alias("b"), hashing.lsh_buckets(F.slice("s", 1, 8), 16, 8).alias("one"))
    for r in rows.collect():
        sig = signature(windows(r["v"]))
        assert r["b"] == [hashlib.md5(str(sig[k * 4 : k * 4 + 4]).encode()).hexdigest() for k in range(16)]
        assert r["one"] == [hashlib.md5(str(sig[:8]).encode()).hexdigest()]


@pytest.mark.parametrize("value,want", [("  Alice  ", "Alice"), ("\t bob\n", "bob"), ("", ""), (None, None)])
def test_strip(spark, value, want):
    assert one(spark, value, text.strip) == want


@pytest.mark.parametrize("value,want", [("  Hello,   WORLD!! ", "hello, world"), ("***", ""), ("Élan — vital", "élan — vital"), (None, None)])
def test_clean_text(spark, value, want):
    assert one(spark, value, text.clean_text) == want


@pytest.mark.parametrize("value,n", [("a b  c", 3), ("", 0), (None, 0), ("  x ", 1)])
def test_token_count(spark, value, n):
    assert one(spark, value, text.token_count) == n


@pytest.mark.parametrize("value,like,looks", [("1", True, True), (" 2.5 ", True, True), ("1e5", True, True), ("nan", False, False), ("none", False, False), ("", False, False), ("1,000", False, True), ("$5", False, True), ("1.0d", False, False), ("1_000", False, False), ("inf", True, False), (None, False, False)])
def test_numeric(spark, value, like, looks):
    assert one(spark, value, numeric.numeric_like) is like
    assert one(spark, value, numeric.looks_numeric) is looks


@pytest.mark.parametrize("value,want", [("12%", 12.0), ("(5)", -5.0), ("$1,234.5", 1234.5), ("abc", None), ("", None), (None, None)])
def test_parse_enhanced(spark, value, want):
    assert one(spark, value, numeric.parse_enhanced) == want


@pytest.mark.parametrize("value,want", [(1.5, 1.5), (float("inf"), None), (float("-inf"), None), (float("nan"), None), (None, None)])
def test_finite(spark, value, want):
    assert one(spark, value, numeric.finite, "double") == want


def test_change_kind_and_confidence(spark):
    rows = spark.createDataFrame([(None, "x"), ("a", "b"), ("a", "a"), (None, None), ("a", None)], "o string, n string").select(quality.change_kind(F.col("o"), F.col("n")).alias("k")).collect()
    assert [r["k"] for r in rows] == ["imputation", "normalization", None, None, "normalization"]
    got = spark.createDataFrame([(i, n, e) for i in (False, True) for n in (False, True) for e in (False, True)], "i boolean, n boolean, e boolean").select(quality.confidence(F.col("i"), F.col("n"), F.col("e")).alias("c")).collect()
    assert [round(r["c"], 4) for r in got] == [1.0, 0.0, 0.85, 0.0, 0.9, 0.0, 0.765, 0.0]


def test_redact(spark):
    assert one(spark, "a.b@c.org +1 (555) 123-4567 123-45-6789 4111 1111 1111 1111", privacy.redact) == "<EMAIL> <PHONE> <SSN> <CARD>"


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12)), min_size=1, max_size=5))
def test_ratio(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", dedupe.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert r["r"] == SequenceMatcher(None, *pairs[r["i"]]).ratio()


def test_alias_map():
    found = alias_map(["active", "actives", "pending", "inactive"])
    assert found["actives"] == "active" and found["pending"] == "pending" and found["active"] == "active"
