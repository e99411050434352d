import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T


def value(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} {'string' if a is None or isinstance(a, str) else 'int'}" for i, a in enumerate(args)))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize(("text", "n"), [("公司財報", 6), ("hello", 1), ("公司ABC", 3), ("あいう", 0), ("", 0)])
def test_token_estimate(spark, text, n):
    assert value(spark, T.estimate_tokens, text) == n


@pytest.mark.parametrize(("chunk", "prefix", "mismatch"), [("財報", "report", True), ("財報", "財報 report", False), ("report", "x", False), ("財報", "", True), ("財報", "12345", True), ("한국어", "korean", True)])
def test_script_mismatch(spark, chunk, prefix, mismatch):
    assert value(spark, T.script_mismatch, chunk, prefix) is mismatch


def test_context_prefix(spark):
    assert value(spark, T.contextualize, "財報", "english", "f.txt") == "f.txt\n\n財報"
    assert value(spark, T.contextualize, "text", "about " + "x" * 200, "f.txt") == "about " + "x" * 144 + "\n\ntext"
    assert value(spark, T.contextualize, "text", None, "f.txt") == "f.txt\n\ntext"


@pytest.mark.parametrize(("text", "low"), [("", True), (None, True), ("​ ﻿", True), ("# --- |", True), ("A picture\n\n```", True), ("A body that is certainly long enough to be kept in any case\n```", False), ("short", False)])
def test_low_value(spark, text, low):
    assert value(spark, T.is_low_value, text) is low


def test_clean_text(spark):
    assert value(spark, T.clean_text, "a\x01b\tc\nd\re\x0bf") == "ab\tc\nd\ref"


def test_tokens(spark):
    assert value(spark, T.tokenize, "Hello, WORLD_1 x") == ["hello", "world_1", "x"]
    assert value(spark, T.tokenize, "公司ABC") == ["公", "司", "公司", "abc"]
    assert value(spark, T.or_query, "!!") == ["!!"]


def test_transcripts(spark):
    said = value(spark, T.clean_transcript, "請回座 請回座，請回座 請回座")
    assert (said.text, said.n) == ("請回座", 3)
    noisy = value(spark, T.clean_transcript, "詞・作曲・編曲 李宗盛")
    assert (noisy.text, noisy.n) == ("", 1)
    clean = value(spark, T.clean_transcript, "今天開會")
    assert (clean.text, clean.n) == ("今天開會", 0)


@pytest.mark.parametrize(("a", "b", "rate"), [("abcdefgh", "abcdefgh", 0), ("abcdefgh", "abcdefgx", 0.125), ("ab", "abc", 0.5), ("abc", "ab", 1 / 3), ("a,b。", "ab", 0), ("", "x", 1), ("", "", 0)])
def test_error_rate(spark, a, b, rate):
    assert value(spark, T.cer, a, b) == pytest.approx(rate)


def test_owner_key(spark):
    import base64
    import hashlib

    claims = base64.urlsafe_b64encode(b'{"jti":"k-1"}').decode().rstrip("=")
    assert value(spark, T.owner_key, f"x.{claims}.y") == "k-1"
    assert value(spark, T.owner_key, "opaque") == hashlib.sha256(b"opaque").hexdigest()


def test_model_answers(spark):
    assert value(spark, T.parse_grades, "so [true, false]", 3) == [True, False, False]
    assert value(spark, T.parse_grades, "none", 2) == [True, True]
    scores = value(spark, T.parse_scores, 'x {"faithfulness": 3, "relevance": -1}')
    assert tuple(scores) == (1.0, 0.0)
    assert value(spark, T.normalize_citations, "a 【1†x】 b") == "a [1] b"


@pytest.mark.parametrize(("name", "safe"), [("a b.txt", True), ("公司.pdf", True), (".x", False), ("a..b", False), ("a/b", False), ("", False), (None, False)])
def test_safe_names(spark, name, safe):
    assert value(spark, T.is_safe_name, name) is safe
