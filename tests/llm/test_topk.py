"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest

from millrace.llm import topk


def _brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in ok if i is not None and i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j) for j, w in ok if j is None or j != i)
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def _rows(n, dims=12, seed=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in c]))
    return rows


def _got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, vector string")
    return sorted((tuple(r) for r in topk.top_k(df, **more).collect()), key=str)


def test_equal_to_brute_force(spark):
    rows = _rows(400)
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    assert _got(spark, rows, candidate_rows=120, query_rows=4) == _brute(rows)


def test_odd_vectors(spark):
    rows = _rows(60) + [(100, None), (150, [1.0, None]), (200, [math.nan] * 12), (250, [math.inf] + [0.0] * 11), (300, [0.5]), (350, []), (None, [9.0] * 12), (None, [9.0] * 12), (50, [2.0] * 12), (50, [2.0] * 12), (7, [0.25] * 12)]
    assert _got(spark, rows, k=7) == _brute(rows, 7)
    assert _got(spark, [], k=3) == []
    assert _got(spark, [(0, [1.0, 2.0])]) == []
    assert _got(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.0])]) == [(0, 1, 1, 128 * 256)]


def test_elimination_leaves_candidates_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-20, 20, (500, 8)) + c for c in (np.array([300] * 8), np.array([-300] * 8))])
    pivots = topk.choose_pivots(x[::10], 8)
    far = topk._distances(x, pivots)
    got = topk.search_block(x, list(range(1000)), far, x[:3], [0, 1, 2], far[:3], np.full(3, -np.inf), 4)
    for i in range(3):
        want = sorted((-int(x[j] @ x[i]), j) for j in range(1000) if j != i)[:4]
        assert [(-s, c) for q, c, s in got if q == i] == want


def test_cells_that_cannot_win_are_not_sent(spark):
    """Six clusters: most pairs of cells are dropped before the shuffle, in small blocks, and the result is the same."""
    rows = _rows(900, seed=4)
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in rows], np.int64)
    pivots = topk.choose_pivots(x, 6)
    far, cell = topk._distances(x, pivots), topk._distances(x, pivots).argmin(1)
    ids = list(range(900))
    asked = np.array(ids) % 50 == 0
    floor = topk._floors(x[::3], ids[::3], x, ids, 5)
    about = lambda keep: {c: topk.Bounds(int(m.sum()), float((x[m] ** 2).sum(1).max()), float(floor[m].min()), far[m].min(0).tolist(), far[m].max(0).tolist()) for c in range(6) if (m := (cell == c) & keep).any()}
    cands, queries = about(asked | True), about(asked)
    meet = topk.cell_pairs(cands, queries)
    assert {(c, c) for c in queries} <= meet and len(meet) < 0.7 * len(cands) * len(queries)
    place = topk._packed(cands, pivots, 100)
    assert sum(n for _, n in place.values()) >= 9 and len({f for f, _ in place.values()}) >= 5
    assert _got(spark, rows, pivots=6, candidate_rows=100, query_rows=3) == _brute(rows)


@pytest.mark.parametrize("big", [1 << 20, 1 << 28])
def test_large_components_stay_exact(spark, big):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-big, big) & ~255) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in topk.top_k(df, scale=1.0).collect()), key=str)
    want = [(q, r, i, s) for q, r, i, s in sorted((tuple(x) for x in _brute([(i, [x / 256 for x in v]) for i, v in rows])), key=str)]
    assert got == want
