"""Queries without SQL against plain Python over the smallest tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

from millrace import catalog
from millrace.functions import text as X
from millrace.operators import alignment


@pytest.fixture(scope="module")
def pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("role", X.alignment_words("text").alias("ref")).collect()
    heard = lambda ws: [w for i, w in enumerate(ws) for w in ([] if i % 6 == 5 else [w, w] if i % 9 == 8 else [w])]
    return [(r.role, r.ref, heard(r.ref)) for r in rows]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_a22_error_rates(spark, sf, pairs):
    got = {r.role: r for r in catalog.queries()["a22_error_rates"](spark, sf).collect()}
    for role in {p[0] for p in pairs}:
        own = [p for p in pairs if p[0] == role]
        n_ref = sum(len(r) for _, r, _ in own)
        assert (got[role].n_files, got[role].n_ref, got[role].n_hyp) == (len(own), n_ref, sum(len(h) for _, _, h in own))
        assert got[role].wer == pytest.approx(sum(_distance(r, h) for _, r, h in own) / n_ref, abs=6e-5)


def test_a21_edit_counts(spark, sf, pairs):
    want = Counter()
    for role, ref, hyp in pairs:
        script = alignment.edit_script(ref, hyp)
        want.update((role, op, ref[i] if op != "insert" else None, hyp[j] if op != "delete" else None) for op, i, j in script)
        for a, b, c, d in alignment.spans(script):
            want.update((role, "involved", w, None) for w in ref[a:b])
            if b - a <= 4 and d - c <= 6:
                want[role, "span" if b > a else "phrase", " ".join(ref[a:b]) or None, " ".join(hyp[c:d]) or None] += 1
    assert {(r.role, r.op, r.ref, r.hyp): r.n for r in catalog.queries()["a21_edit_counts"](spark, sf).collect()} == want


def test_x14_passage_counts(spark, sf):
    import re

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"[a-z0-9']+", (r.text or "").lower())
        want[r.doc_id] = len({h for i in range(len(words) - 7) if (h := zlib.crc32(" ".join(words[i : i + 8]).encode())) % 8 == 0})
    assert {r.doc_id: r.n for r in catalog.queries()["x14_passage_counts"](spark, sf).collect()} == want


def test_a23_ridge(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.hstack([np.ones((len(rows), 1)), np.array([r.embedding for r in rows], float)])
    y = np.array([r.label for r in rows], float)
    a = x.T @ x
    k = len(a)
    a[np.arange(1, k), np.arange(1, k)] += 1e-3 * np.trace(a[1:, 1:]) / (k - 1)
    want = np.linalg.solve(a, x.T @ y)
    got = {r.i: r.weight for r in catalog.queries()["a23_ridge"](spark, sf).collect()}
    assert np.allclose([got[i - 1] for i in range(k)], want, atol=1e-8)


def test_w12_batch_plan(spark, sf):
    """Every planned item once, whole batches only, and no micro-batch over its budget of longest times count."""
    rows = catalog.queries()["w12_batch_plan"](spark, sf).collect()
    columns = rows[0].__fields__
    item, length = columns[4], columns[5]
    assert len({r[item] for r in rows}) == len(rows)
    steps = Counter(r.step for r in rows)
    assert len(set(steps.values())) == 1 and set(steps) == set(range(len(steps)))
    micro = {}
    for r in rows:
        micro.setdefault((r.step, r.rank, r.micro), []).append(r)
    for own in micro.values():
        assert sorted(r.place for r in own) == list(range(len(own)))
        by_place = sorted(own, key=lambda r: r.place)
        assert [r[length] for r in by_place] == sorted((r[length] for r in own), reverse=True)


def test_p3_neighbours(spark, sf):
    got = catalog.queries()["p3_neighbours"](spark, sf).collect()
    said = {w for r in spark.read.parquet(f"{sf}/conversations.parquet").select(X.alignment_words("text").alias("w")).collect() for w in r.w}
    for r in got[:20]:
        alike = lambda v: 2 * ((len(r.word) + len(v) - _indel(r.word, v)) / 2) / (len(r.word) + len(v))  # noqa: E731, B023
        far, best = min((-alike(v), v) for v in said)
        assert -far >= 0.6 and (r.near or r.word) == best


def _indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else min(row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_a21_pooled_counts(spark, sf):
    from collections import Counter

    own = catalog.queries()["a21_edit_counts"](spark, sf).collect()
    got = catalog.queries()["a21_pooled_counts"](spark, sf).collect()
    total = Counter()
    for r in own:
        total[r.op, r.ref, r.hyp] += r.n
    assert {(r.op, r.ref, r.hyp): r.n for r in got if r.pooled} == total
    assert {(r.role, r.op, r.ref, r.hyp, r.n) for r in got if not r.pooled} == {(r.role, r.op, r.ref, r.hyp, r.n) for r in own}
    nulls = spark.createDataFrame([(None, ["a"], ["b"]), ("k", ["a"], ["b"]), (None, None, None)], "k string, ref array<string>, hyp array<string>")
    rows = {(r.k, r.pooled): r.n for r in alignment.pooled_counts(nulls, ["k"]).collect() if r.op == "replace"}
    assert rows == {(None, False): 1, ("k", False): 1, (None, True): 2}
