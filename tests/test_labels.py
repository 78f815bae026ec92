"""Label parsing, upserts, truncation, selection and probes."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import labels, probes, selection


def test_strict_labels(spark):
    texts = ['{"answer": "a", "evidence": [2, 1], "summary": "s", "confidence": 1.7}', ' {"answer": 3, "evidence": [true]} ', '{"answer": "a"} extra', "[1]", "", None, '```{"answer": "a"}```']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(labels.strict_label("t").alias("l"))
    got = [tuple(r.l) for r in df.collect()]
    assert got[0] == ("a", [2, 1], "s", 1.0) and all(g == (None,) * 4 for g in got[1:])
    names = spark.createDataFrame([("['A', \"B c\"]",), ("{'x': 1}",), ("not [",), (None,), ("7",)], "t string").select(labels.literal_names("t").alias("n"))
    assert [r.n for r in names.collect()] == [["A", "B c"], ["x"], [], [], []]


def test_targets_and_templates(spark):
    rows = [("pass", [1, 3], 'a "quote" é\n'), ("none", [], "")]
    df = spark.createDataFrame(rows, "a string, e array<int>, s string").select(labels.target_json(F.col("a"), F.col("e"), F.col("s")).alias("t"), labels.fill_template("Q: {a}! {s}", {"a": F.col("a"), "s": F.col("s")}).alias("p"))
    for r, (a, e, s) in zip(df.collect(), rows):
        assert r.t == json.dumps({"answer": a, "evidence": e, "summary": s}, ensure_ascii=False) and r.p == f"Q: {a}! {s}"
    with pytest.raises(KeyError):
        labels.fill_template("{x}", {})


def test_upsert_truncation_and_pairs(spark):
    cache = spark.createDataFrame([(1, "model", "m"), (2, "rule", "r"), (3, "model", "x")], "id int, kind string, v string")
    new = spark.createDataFrame([(1, "rule", "n"), (2, "model", "no"), (4, "model", "y"), (3, "model", "z")], "id int, kind string, v string")
    got = {r.id: r.v for r in labels.upsert_by_rank(cache, new, "id", F.when(F.col("kind") == "rule", 0).otherwise(1)).collect()}
    assert got == {1: "n", 2: "r", 3: "z", 4: "y"}
    lines = spark.createDataFrame([(d, i, "w " * n) for d, ns in ((1, (3, 3, 9, 1)), (2, (20,))) for i, n in enumerate(ns)], "d int, i int, l string")
    cut = labels.truncate_head(lines, "d", "i", "l", F.lit(2), 10, F.size(F.split(F.trim("l"), " "))).collect()
    assert [(r.d, r.kept) for r in cut] == [(1, 2)]
    q = "id string, answer string, text string, description string, options array<string>"
    a = spark.createDataFrame([("r1", "x", "t", None, ["x"]), ("r2", "x", "t", "d", ["x"])], q)
    b = spark.createDataFrame([("r1", "y", "t", None, ["x"]), ("r2", "y", "t", "other", ["x"])], q)
    assert [tuple(r) for r in labels.same_question_pairs(a, b).collect()] == [("r1", "x", "y")]
    calls = spark.createDataFrame([(1, "a"), (2, "b")], "c int, dataset string")
    bank = spark.createDataFrame([("q1", ["a", "b", "a"]), ("q2", ["b"])], "q string, dataset_allow_list array<string>")
    assert sorted((r.c, r.q) for r in labels.applicable(calls, bank).collect()) == [(1, "q1"), (2, "q1"), (2, "q2")]


def test_windows_and_hosts(spark):
    t = spark.createDataFrame([(1, i, "rare" if i in (50, 51, 52) else "ab"[i % 2], "x y") for i in range(120)], "d int, i int, r string, s string")
    got = {r.i for r in labels.cited_window(t, "d", "i", "r", 10, 5).collect()}
    assert got == set(range(10)) | set(range(115, 120)) | {50, 51}
    named = spark.createDataFrame([(1, "a"), (1, "rare")], "d int, r string")
    assert {r.r: r.host for r in labels.host_coverage(t, "d", "r", "s", named, 0.03).collect()} == {"a": True, "b": False, "rare": False}
    p = spark.createDataFrame([("k", ["um", "a", "b"], ["a"])], "k string, ref array<string>, hyp array<string>")
    assert {r.side: (r.words, r.fillers_per_1000, r.length_ratio) for r in labels.distribution_table(p, ["k"], "ref", "hyp").collect()} == {"ref": (3, 333.333, 1.0), "hyp": (1, 0.0, 0.3333)}


def test_selection(spark):
    groups = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(90)], "g int, s string")
    best = selection.best_draw(groups, "g", "s", 30, 40, 1).groupBy("s").count().collect()
    assert sum(r["count"] for r in best) == 30 and max(abs(r["count"] - 10) for r in best) <= 2
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 5) for i in range(100)], "i int, s string, p int")
    quotas = spark.createDataFrame([("a", 7), ("b", 3)], "s string, quota int")
    drawn = selection.quota_draw(rows, "i", "s", "p", quotas, 4, 2).collect()
    assert sum(r.s == "a" for r in drawn) == 7 and sum(r.s == "b" for r in drawn) == 3 and all(sum(r.p == p for r in drawn) <= 4 for p in range(5))
    sides = spark.createDataFrame([("g1", "train"), ("g1", "val"), ("g2", "val")], "g string, side string")
    assert [r.g for r in selection.straddles(sides, "g", "side").collect()] == ["g1"]


def test_probes(spark):
    df = spark.createDataFrame([(i, f"alpha beta {'gamma' if i % 2 else 'delta'} w{i % 7}", i % 2, float(i % 2) + (i % 5) / 4) for i in range(120)], "g int, t string, y int, n double")
    assert probes.gate_auc(df, "t", "y", "g", folds=2, features=256) > 0.95
    real, null = probes.shortcut_probe(df, ["n"], "y", "g", folds=2)
    assert real > 0.8 and abs(null - 0.5) < 0.25
    real, null = probes.opening_probe(df, "t", "y", "g", words=3, folds=2, features=256)
    assert real > 0.95 and abs(null - 0.5) < 0.25
    assert probes.opening_probe(df, "t", "y", "g", words=2, folds=2, features=256)[0] < 0.8  # the third word tells
    assert spark.createDataFrame([("abc",)], "t string").select(probes.char_grams(F.col("t")).alias("g")).first().g == [" ab", "abc", "bc ", " abc", "abc ", " abc "]
