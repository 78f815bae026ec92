"""Column functions against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X


def _one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_hash_share(spark):
    df = spark.range(20_000).select(X.hash_share("id").alias("s"))
    rows = [r.s for r in df.collect()]
    assert rows[17] == int(hashlib.sha1(b"17").hexdigest()[:8], 16) / 0xFFFFFFFF
    assert 0.015 < sum(s < 0.02 for s in rows) / len(rows) < 0.025
    assert _one(spark, "a", X.stable_seed("x", F.lit(3))) == int(hashlib.sha1(b"a|3").hexdigest()[:8], 16)


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), (" a\tb\n\nc d ", 4), ("x", 1)])
def test_word_count(spark, text, n):
    assert _one(spark, text, X.word_count("x")) == n


@pytest.mark.parametrize(
    ("title", "want"),
    [("The Harbour Podcast", "harbour"), ("Tides the Podcast", "tides"), ("Night Ferry [season two]", "night ferry"), ("Ferry (a) talk (b)  ", "ferry a talk"), ("Café_Día!", "café día"), ("(only)", "only"), (None, ""), ("Podcast", "podcast"), ("the podcast", "the"), ("(Un)said", "un said")],
)
def test_show_names(spark, title, want):
    got = _one(spark, title, X.normal_show("x"))
    assert got == want


def test_small_forms(spark):
    assert _one(spark, "Ann Lee-Smith", X.normal_name("x")) == "ann lee smith" and _one(spark, "Ann", X.normal_name("x")) == ""
    assert _one(spark, " Not - Sure ", X.normal_answer("x")) == "not_sure"
    assert _one(spark, "Well (er) my fr~ friend's 'ere; twice!", X.alignment_words("x")) == ["well", "er", "my", "fr", "friend's", "'ere", "twice"]
    assert _one(spark, "then i think i'll row", X.surface("x")) == "Then I think I'll row." and _one(spark, "  ", X.surface("x")) == ""
    assert _one(spark, "a (b] c [d) e [f (g) h]", X.without_non_speech("x")) == "a (b] c [d) e [f h]" and _one(spark, f"({'n' * 41}) ()", X.without_non_speech("x")) == f"({'n' * 41}) ()"
    assert _one(spark, "i", X.surface("x")) == "I." and _one(spark, "is it i?", X.surface("x")) == "Is it I?"
    assert _one(spark, ">> >>Hi", X.without_change_marks("x")) == "Hi" and _one(spark, "oars [splash] down (coughs)  now", X.without_non_speech("x")) == "oars down now"
    assert _one(spark, "a: b: c", F.array(X.role_of("x"), X.said_of("x"))) == ["a", "b: c"] and _one(spark, "abc", F.array(X.role_of("x"), X.said_of("x"))) == ["abc", ""]
    assert _one(spark, "[NAME] and [PLACE_1] [X_Y]", X.placeholders("x")) == 2
    assert _one(spark, "One. Two? Three", X.sentences("x")) == ["One.", "Two?", "Three"]


@pytest.mark.parametrize(("n", "bucket", "stratum"), [(None, "unknown", None), (0, "unknown", "0-4k"), (2048, "<=2k", "0-4k"), (3999, "2-4k", "0-4k"), (4000, "2-4k", "4-8k"), (15_999, "8-16k", "12-16k"), (16_000, "8-16k", None)])
def test_buckets(spark, n, bucket, stratum):
    assert _one(spark, n, X.length_bucket("x"), "int") == bucket and _one(spark, n, X.stratum("x"), "int") == stratum


def test_passages(spark):
    text = " ".join(f"w{i % 40}" for i in range(120)) + " It's"
    words = text.lower().split()
    want = {h for i in range(len(words) - 7) if (h := zlib.crc32(" ".join(words[i : i + 8]).encode())) % 8 == 0}
    assert set(_one(spark, text, X.passages("x"))) == want and _one(spark, "too few", X.passages("x")) == [] and _one(spark, None, X.passages("x")) == []


def test_lines(spark):
    df = spark.createDataFrame([(["a: b", "c: d", "e"], [1, 3])], "lines array<string>, cited array<int>")
    r = df.select(X.numbered("lines"), X.numbered("lines", "dotted"), X.blank_cited("lines", "cited"), X.keep_cited("lines", "cited"), X.jaccard("cited", F.array(F.lit(3), F.lit(4)))).first()
    assert tuple(r) == (["1: a: b", "2: c: d", "3: e"], ["1. a:b", "2. c:d", "3. e:"], ["a: ", "c: d", "e: "], ["a: b", "e"], 1 / 3)
    assert _one(spark, [], X.jaccard("x", "x"), "array<int>") is None
    thirds = spark.range(1, 7).select(X.third_of("id", F.lit(6)).alias("t")).collect()
    assert [r.t for r in thirds] == ["first", "first", "middle", "middle", "last", "last"]
