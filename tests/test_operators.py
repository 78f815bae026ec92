"""Operators against plain Python on small inputs, edges included."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import agreement, alignment, grouping, intervals, moments, podcasts, ranks, scoring, splits, turns
from millrace.operators.components import components


def test_nearest_ranks(spark):
    values = [5, 1, 1, 9, 7, 7, 7, 2, 0, 3]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4), ("b", None)], "k string, v int")
    got = {r.k: r for r in ranks.nearest_ranks(df, ["k"], "v").collect()}
    s = sorted(values)
    assert [got["a"][c] for c in ("min", "p50", "p90", "p99", "max")] == [0, s[5], s[9], s[9], 9] and tuple(got["b"])[1:] == (1, 4, 4, 4, 4, 4)


@pytest.mark.parametrize(("n", "counts", "want"), [(10, [1, 1, 1], [4, 3, 3]), (7, [6, 1], [6, 1]), (0, [2, 3], [0, 0])])
def test_allocation(spark, n, counts, want):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate(counts)], "g string, cell int, n int")
    assert [r.seats for r in ranks.allocate(df, n, ["g"], "cell", "n").orderBy("cell").collect()] == want


def test_cuts_and_bins(spark):
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = sorted(values)
    cuts = ranks.quantile_cuts(df.withColumn("k", F.lit(1)), ["k"], "v", 5).first().cuts
    assert cuts == [s[len(s) * i // 5] for i in range(1, 5)]
    from bisect import bisect_right

    got = df.select("v", ranks.bin_right(F.col("v"), F.array(*map(F.lit, cuts))).alias("b")).collect()
    assert all(r.b == bisect_right(cuts, r.v) for r in got)


def test_choices_are_nested_and_free_of_order(spark):
    df = spark.createDataFrame([(d, f"q{i}") for d in range(5) for i in range(9)], "d int, q string")
    two, four = ({(r.d, r.q) for r in ranks.choose_per_key(df.orderBy(F.rand(k)), "d", "q", k, 3).collect()} for k in (2, 4))
    assert two < four and len(two) == 10
    want = sorted(range(9), key=lambda i: hashlib.sha1(f"3|0|q{i}".encode()).hexdigest())[:2]
    assert {q for d, q in two if d == 0} == {f"q{i}" for i in want}


def test_batch_plan(spark):
    rng = random.Random(1)
    sizes = {i: rng.randint(1, 50) for i in range(53)}
    df = spark.createDataFrame(list(sizes.items()), "i long, n long")
    rows = ranks.batch_plan(df, "i", "n", 8, 2, 100, 4).collect()
    order = sorted(sizes, key=lambda i: (hashlib.sha1(f"4|{i}".encode()).hexdigest(), i))
    want = set()
    for step in range(len(order) // 8):
        batch = sorted(order[step * 8 : step * 8 + 8], key=lambda i: (-sizes[i], i))
        for rank in range(2):
            micro, held, longest = -1, 0, 0
            for i in batch[rank::2]:
                if held and longest * (held + 1) <= 100:
                    held += 1
                else:
                    micro, held, longest = micro + 1, 1, sizes[i]
                want.add((step, rank, micro, held - 1, i, sizes[i]))
    assert {tuple(r) for r in rows} == want


def test_transcript_checks(spark):
    said = {
        1: [("a", "x y z")], 2: [("a", "w " * 40), ("b", "c")], 3: [("a", "same words here"), ("b", "same words here"), ("a", "same words here"), ("b", "q r s")],
        4: [("a", "w " * 30), ("b", "v " * 10)], 5: [(r, f"t{i} u v") for i, r in enumerate("abababab")],
    }
    df = spark.createDataFrame([(d, i, r, t) for d, ts in said.items() for i, (r, t) in enumerate(ts)], "d int, i int, r string, t string")
    got = {r.d: r.reason for r in turns.transcript_checks(df, "d", "i", "r", "t").collect()}
    assert got == {1: "one speaker", 2: "monologue", 3: "repetition loop", 4: "collapsed transcript", 5: None}


def test_merged_fragments_and_long_turns(spark):
    said = [("a", "so"), ("a", "so"), ("a", "so"), ("a", "so"), ("a", "[Music]"), ("b", "this is a loop"), ("b", "this is a loop"), ("a", "end (laughs) here")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "d int, turn int, r string, t string")
    got = [(r.r, r.said) for r in turns.merge_fragments(df, "d", "turn", "r", "t").orderBy("turn").collect()]
    assert got == [("a", "so so"), ("b", "this is a loop"), ("a", "end here")]
    long = " ".join(f"w{i}" for i in range(7)) + ". " + " ".join(f"v{i}" for i in range(12)) + ". a b"
    parts = spark.createDataFrame([(long,), ("a b",)], "x string").select(turns.over_long("x", 5).alias("p")).collect()
    assert [len(p.split()) for p in parts[0].p] == [5, 2, 5, 5, 4] or all(len(p.split()) <= 5 for p in parts[0].p)
    assert " ".join(parts[0].p).split() == long.split() and parts[1].p == ["a b"]


def test_speaker_labels_refuse_clashes(spark):
    t = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (1, 3, "x")], "d int, i int, r string")
    pick = lambda *names: spark.createDataFrame([(1, n) for n in names] or [], "d int, r string")
    got = {r.r: r.label for r in turns.speaker_labels(t, "d", "i", "r", pick("z", "y"), pick("y", "x")).collect()}
    assert got == {"x": "guest_1", "y": "host_1", "z": "host_2"}
    bad = spark.createDataFrame([(1, 0, "Host A")], "d int, i int, r string")
    with pytest.raises(Exception, match="generated label"):
        turns.speaker_labels(bad, "d", "i", "r", pick("q"), pick("w")).collect()


def test_macro_f1_and_majority(spark):
    rows = spark.createDataFrame([(1, "pass", "pass"), (1, "fail", "pass"), (1, "fail", "fail")], "k int, gold string, pred string")
    assert scoring.macro_f1(rows, ["k"], options=None).first().macro_f1 == pytest.approx(2 / 3)
    votes = spark.createDataFrame([(1, a) for a in "baab"], "k int, a string")
    assert scoring.majority(votes, ["k"], "a").first().majority == "a"


def test_kappa(spark):
    rows = [("same", "x", "x")] * 3 + [("chance", a, b) for a in "xy" for b in "xy"] + [("never", "x", "y")] * 2
    got = {r.k: r.kappa for r in agreement.kappa(spark.createDataFrame(rows, "k string, a string, b string"), ["k"], "a", "b").collect()}
    assert got == {"same": 1.0, "chance": 0.0, "never": 0.0}


def test_scores_of_odd_answers(spark):
    rows = [(None, ["a"], "a", None, [1], 3), ("a", ["a"], "a", [2, 1], [1], 3), ("A ", ["a"], "a", [4], [1], 3), ("a", ["a"], "a", [], [], 0)]
    df = spark.createDataFrame(rows, "answer string, options array<string>, gold string, evidence array<int>, gold_evidence array<int>, n_lines int")
    got = [(r.status, r.pred, r.ev_valid, r.ev_f1, r.ev_exact) for r in scoring.score_pairs(df).collect()]
    assert got == [("invalid", "invalid", False, 0.0, 0.0), ("exact", "a", False, 0.0, 0.0), ("recovered", "invalid", False, 0.0, 0.0), ("exact", "a", True, 1.0, 1.0)]


def test_alignment(spark):
    pairs = [("a b c", "a x c"), ("a b", "a b c"), ("a b c", "a c")]
    df = spark.createDataFrame([("k", a.split(), b.split()) for a, b in pairs], "k string, ref array<string>, hyp array<string>")
    r = alignment.error_rates(df, ["k"]).first()
    assert (r.n_files, r.n_ref, r.n_hyp, r.wer) == (3, 8, 8, 0.375)
    got = {(x.op, x.ref, x.hyp): x.n for x in alignment.alignment_counts(df, ["k"]).collect()}
    assert got == {("replace", "b", "x"): 1, ("insert", None, "c"): 1, ("delete", "b", None): 1, ("span", "b", "x"): 1, ("span", "b", None): 1, ("phrase", None, "c"): 1, ("involved", "b", None): 2}
    assert alignment.spans(alignment.edit_script("gonna go".split(), "going to go".split())) == [(0, 1, 0, 2)]
    empty = spark.createDataFrame([("e", [], [])], "k string, ref array<string>, hyp array<string>")
    assert alignment.error_rates(empty, ["k"]).first().wer == 0.0


def test_edit_distance_is_least():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        script = alignment.edit_script(a, b)
        assert len(script) == row[-1]
        made, at = [], 0
        for op, i, j in script:
            made += a[at:i] + ([b[j]] if op != "delete" else [])
            at = i + (op != "insert")
        assert made + a[at:] == b


def test_nearest_turn_of_a_long_key(spark):
    """One key with all its turns at the start, and with turns all along: as many words as a quadratic frame would not end."""
    t = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 2.0, 3.0)], "key string, turn int, start double, end double")
    w = spark.range(60_000).select(F.lit("a").alias("key"), F.col("id").alias("w"), (F.col("id") / 100).alias("start"), (F.col("id") / 100).alias("end"))
    got = {r.turn: r["count"] for r in intervals.nearest_turn(w, t, "key").groupBy("turn").count().collect()}
    assert got == {0: 151, 1: 59_849}
    many = spark.range(3_000).select(F.lit("a").alias("key"), F.col("id").alias("turn"), F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"))
    wrong = intervals.nearest_turn(w.where("w < 300000"), many, "key").where(F.col("turn") != F.least(F.lit(2999), F.floor(F.col("start") + 0.2499)))
    assert wrong.count() == 0


def test_nearest_turn(spark):
    words = spark.createDataFrame([("k", w, s, e) for w, s, e in (("a", 0.0, 1.0), ("gap-early", 2.0, 2.4), ("gap-late", 3.2, 3.8), ("b", 4.0, 5.0), ("c", 9.5, 9.9), ("tie", 2.5, 3.5))], "key string, w string, start double, end double")
    t = spark.createDataFrame([("k", 1, 0.5, 2.0), ("k", 2, 4.0, 5.0)], "key string, turn long, start double, end double")
    got = {r.w: r.turn for r in intervals.nearest_turn(words, t, "key").collect()}
    assert got == {"a": 1, "gap-early": 1, "gap-late": 2, "b": 2, "c": 2, "tie": 1}


def test_components_and_bands(spark):
    edges = [(1, 2), (3, 2), (5, 6), (9, 9), (7, 8), (8, 3), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 5: 5, 6: 5}
    d = spark.createDataFrame([(1, "t", 10.0), (2, "t", 11.5), (3, "t", 13.0), (4, "t", 20.0), (5, "u", 10.0), (6, "", 10.0), (7, "", 10.0)], "id long, k string, x double")
    got = {r.id: r.root for r in grouping.groups(d, "id", grouping.band_links(d, "id", F.col("k"), "x")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_overlap_counts_boilerplate_in_sizes(spark):
    rows = [(d, 1000 + h) for d in range(60) for h in range(4)] + [(0, 1), (1, 1), (1, 2)]
    got = grouping.overlap_pairs(spark.createDataFrame(rows, "d int, h int"), "d", "h", least=0.1).collect()
    assert [(r.a, r.b, r.shared, r.share) for r in got] == [(0, 1, 1, 0.2)]


def test_sides_and_assertions(spark):
    r = spark.createDataFrame([("e1", "q"), ("e2", "h"), ("e3", "h")], "e string, q string")
    s = spark.createDataFrame([("e1", "train"), ("e2", "benchmark"), ("e3", "val")], "e string, side string")
    got = {x.e: (x.side, x.cell) for x in splits.assign_sides(r, s, "e", F.col("q") == "h").collect()}
    assert got == {"e1": ("train", None), "e2": ("benchmark", "unseen_q"), "e3": ("drop", None)}
    with pytest.raises(Exception, match="the split lacks"):
        splits.assign_sides(r, s.where("e <> 'e1'"), "e", F.lit(False)).collect()
    with pytest.raises(Exception, match="repeated id"):
        splits.require_unique(r.union(r.limit(1)), "e").collect()
    assert splits.require_unique(r, "e").count() == 3
    w = spark.createDataFrame([(list(range(n)),) for n in (0, 5, 6, 10, 16)], "t array<int>").select(splits.token_windows(F.col("t"), 10).alias("w")).collect()
    assert [[len(x) for x in r.w] for r in w] == [[], [], [6], [10], [10, 6]]


def test_ridge_equals_a_direct_solution(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    got = {r.i: r.weight for r in moments.ridge(df, "x", F.col("y"), 0.1).collect()}
    full = np.hstack([np.ones((200, 1)), x])
    a = full.T @ full
    a[[1, 2, 3], [1, 2, 3]] += 0.1 * np.trace(a[1:, 1:]) / 3
    assert np.allclose([got[i] for i in range(-1, 3)], np.linalg.solve(a, full.T @ y))


def test_spoken_turns_use_episodes(spark):
    t = spark.createDataFrame([(e, 1, s, "We thank our sponsors" if i == 0 else f"turn {e} {i}", 4, i) for e in (1, 2, 3) for i, s in enumerate("abab")], "episode_id int, podcast_id int, speaker string, turn_text string, token_count int, start_time int")
    ep = spark.createDataFrame([(1, "EN-us", "x"), (2, "en", "y"), (3, "de", "z")], "episode_id int, language string, title string")
    got = podcasts.spoken_turns(t, ep, least_turns=4, boiler_tokens=4, boiler_episodes=3).collect()
    assert Counter(r.episode_id for r in got) == {1: 3, 2: 3} and all(r.turn_text != "We thank our sponsors" for r in got)


def test_alignments_in_batches(monkeypatch):
    """Scripts of tables filled together equal those of one pair at a time, and a task hands on its edits before they are many."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from millrace.operators import alignment

    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))) for _ in range(300)] + [(np.zeros(0, int), np.zeros(0, int))]
    want = [alignment.edit_script(a.tolist(), b.tolist()) for a, b in pairs]
    for cells in (1, 500, 20_000, 1 << 21):
        monkeypatch.setattr(alignment, "_CELLS", cells)
        assert sorted(alignment.edit_scripts(*zip(*pairs))) == list(enumerate(want))
    monkeypatch.setattr(alignment, "_WORDS", 40)
    monkeypatch.setattr(alignment, "_HELD", 50)
    texts = [[[chr(97 + x) for x in side] for side in pair] for pair in pairs] + [[None, None]]
    batch = pa.record_batch([pa.array([i % 3 for i in range(len(texts))]), *[pa.array([t[k] for t in texts], pa.list_(pa.string())) for k in (0, 1)]], ["k", "ref", "hyp"])
    made, got = list(alignment._counted(iter([batch]))), Counter()
    assert len(made) > 10 and max(map(len, made)) < 300
    for r in (r for part in made for r in part.to_pylist()):
        got[r["k"], r["op"], r["ref"], r["hyp"]] += r["n"]
    plain = Counter((i % 3, *e) for i, (t, script) in enumerate(zip(texts, want)) for e in alignment._events(t[0], t[1], script))
    assert got == plain


def test_six_links_hash_the_passages_once(spark, sf, monkeypatch):
    """No kind of link hashes the texts again: they read a stored table."""
    from millrace import catalog
    from millrace.operators import grouping

    seen, groups = [], grouping.groups
    monkeypatch.setattr(grouping, "groups", lambda d, doc, *links: seen.extend(links) or groups(d, doc, *links))
    catalog.queries()["j9_six_links"](spark, sf)
    assert len(seen) == 7 and not any("md5(" in x._jdf.queryExecution().toString() for x in seen)
