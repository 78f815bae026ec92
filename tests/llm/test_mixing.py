"""Raking against a plain loop, the sample's proportions, odd inputs."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def _plain(cells, power):
    """Raked weights of {(a, b, c): w}."""
    fitted = {k: float(w) for k, w in cells.items()}
    targets = []
    for i in range(3):
        sums = Counter()
        for k, w in cells.items():
            sums[k[i]] += w
        raised = {v: w**power for v, w in sums.items()}
        targets.append({v: w / sum(raised.values()) for v, w in raised.items()})
    for _ in range(200):
        for i in range(3):
            sums = Counter()
            for k, w in fitted.items():
                sums[k[i]] += w
            fitted = {k: w * targets[i][k[i]] / sums[k[i]] for k, w in fitted.items()}
    return fitted, targets


def _docs(n=600):
    return [(i, "w " * (i % 37), f"s{i * i % 5}", ("en", "de", None)[i % 7 % 3], "ab"[i % 2]) for i in range(n)]


def _mix(df, **more):
    return mixing.mix(df, F.col("source"), F.col("lang"), F.col("topic"), mixing.word_count(F.col("text")), **more)


SCHEMA = "doc_id long, text string, source string, lang string, topic string"


def test_equal_to_a_plain_loop(spark):
    rows = _docs()
    cells = Counter()
    for _, text, s, lang, t in rows:
        cells[s, lang or "", t] += text.count("w")
    cells = {k: w for k, w in cells.items() if w}
    fitted, targets = _plain(cells, 0.5)
    ratio = {k: fitted[k] / w for k, w in cells.items()}
    most = max(ratio.values())
    want = {}
    for i, text, s, lang, t in rows:
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        if text and u < ratio[s, lang or "", t] / most:
            want[i] = ratio[s, lang or "", t] / most
    got = {r.doc_id: r.mix.probability for r in _mix(spark.createDataFrame(rows, SCHEMA), power=0.5).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in got)
    for i in range(3):
        sums = Counter()
        for k, w in fitted.items():
            sums[k[i]] += w
        assert all(sums[v] == pytest.approx(t) for v, t in targets[i].items())


def test_expected_tokens_stand_in_proportion(spark):
    df = spark.createDataFrame([(i, "w " * 10, "big" if i % 10 else "small", "en", "t") for i in range(4000)], SCHEMA)
    n = {r.source: r["count"] for r in _mix(df, power=0.5).groupBy("source").count().collect()}
    assert n["small"] == 400 and abs(n["big"] / n["small"] - 3) < 0.4


def test_odd_inputs(spark):
    rows = [(None, "a b", None, None, None), (None, None, "x", "en", "t"), (1, "", "x", "en", "t"), (2, "c", "x", "en", "t"), (2, "c", "x", "en", "t"), (3, "w " * 50_000, "y", "en", "t")]
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], SCHEMA + ", w int, mix_source string")
    out = _mix(df, taken="drawn")
    assert out.columns == [*df.columns, "drawn"]
    got = out.collect()
    assert all(r.drawn.n_tokens > 0 for r in got) and sum(r.doc_id == 2 for r in got) in (0, 2)
    assert _mix(df.where("false")).count() == 0
    assert _mix(df.where("doc_id = 1")).count() == 0


def test_topics_and_words(spark):
    df = spark.createDataFrame([("",), (None,), (" \t",), ("a\nb\nc",), ("a b c",), ("w " * 300,), ("w " * 900,), ("x y z",)], "text string")
    n = mixing.word_count(F.col("text"))
    assert [tuple(r) for r in df.select(n, mixing.form_topic(F.col("text"), n)).collect()] == [(0, "empty"), (0, "empty"), (0, "empty"), (3, "list"), (3, "note"), (300, "article"), (900, "long"), (2, "note")]


def test_both_ways_of_raking_agree(spark):
    rng = __import__("random").Random(3)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", "ab"[k], rng.randint(1, 999)) for i in range(6) for j in range(3) for k in range(2) if rng.random() < 0.8], "source string, language string, topic string, w long")
    targets = {m: mixing.tempered_targets(cells, m, 0.5) for m in ("source", "language", "topic")}
    one, two = ({tuple(r)[:3]: r.fitted for r in mixing.rake(cells, targets, row_cells=n).collect()} for n in (512, 0))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)
    assert mixing.rake(cells.where("false"), targets).count() == 0
