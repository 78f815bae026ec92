"""Importance resampling against plain Python: odd rows, the whole smallest tables, ranks over ranges."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import queries, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "  ", "--", "One", "one TWO", "Ünï Çode Straße ÉÀ É", "a1 b2-c3_d4", "日本 語\x00x", "x" * 5000, "the cat sat " * 4000, "🙂 smile here"]


def _buckets(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _brute(docs, target, least=20):
    held = [(i, *_buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in _buckets(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    gains = [gain(b) for b in range(10_000)]
    rows = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def _sorted(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark):
    docs = list(enumerate(ODD)) + [(None, "a nameless text"), (None, "a nameless text"), (None, "another one"), (3, "twice"), (3, "twice"), (3, "not the same")]
    docs += [(100 + i, "many copies of one text that is as long as it has to be to be drawn with some luck here and now " * 2) for i in range(70)]
    target = ["One two three", None, "", "the cat sat on the mat"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, bucket string, key int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert _sorted(resample.resample(df, goal)) == _brute(docs, target)
    assert _sorted(resample.resample(df, goal.where("false"))) == _brute(docs, [])
    assert _sorted(resample.resample(df.where("false"), goal)) == []
    assert resample.resample(df.where("doc_id < 3"), goal).where("rank IS NOT NULL").count() == 0


def test_a_hot_row(spark):
    """A third of the rows are equal in id and text: each has the row's own weight."""
    docs = [(1, "hot words of a row that repeats")] * 40 + [(i, f"text number {i} of the rest") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([("hot words",)], "text string")
    assert _sorted(resample.resample(df, goal)) == _brute(docs, ["hot words"])


def test_ranks_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 1700).alias("v"), "id")
    got = [(r["v"], r["id"]) for r in resample.ranked(df.repartition(7), [F.desc("v"), F.col("id")], "rank").orderBy("rank").collect()]
    assert got == sorted(((i % 1700, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert _sorted(queries.queries()["op11_resampling"](spark, "/root/testdata/sf0.001")) == _brute(docs, target)
