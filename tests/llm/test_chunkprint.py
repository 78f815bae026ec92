"""Chunk fingerprints: chunks, shifts, and the comparison with edited texts against a plain loop."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import chunkprint as cp


def _text(rng, n):
    return "".join(rng.choice("abcdefghij klmnop\nqrstuvé日") for _ in range(n))


def test_chunks_join_to_the_data_and_keep_their_sizes():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 40, 5000):
        data = _text(rng, n).encode()
        parts = cp.chunks(data)
        assert b"".join(parts) == data
        assert all(cp.LEAST <= len(c) <= cp.MOST for c in parts[:-1]) and all(len(c) <= cp.MOST for c in parts)


def test_segments_do_not_change_the_cuts(monkeypatch):
    data = _text(random.Random(2), 9000).encode()
    want = cp.chunks(data)
    monkeypatch.setattr(cp, "_SEGMENT", 100)
    assert cp.chunks(data) == want


def test_a_shift_moves_few_chunks():
    text = _text(random.Random(3), 20_000)
    assert cp.likeness(cp.entries(text), cp.entries("x" + text)) > 0.98
    assert cp.likeness(cp.entries(text), cp.entries(text[:9000] + "new words here" + text[9000:])) > 0.98
    assert cp.likeness(cp.entries(text[5000:15_000]), cp.entries(text)) > 0.97
    assert cp.likeness(cp.entries(text), cp.entries(_text(random.Random(4), 20_000))) < 0.02
    assert cp.from_text(cp.as_text(cp.entries(text))) == cp.entries(text)


def _brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = (cp.entries(t) for t in (text, new, after))
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), cp.as_text(a), cp.as_text(b), cp.likeness(a, b), cp.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [1, 7, 1024])
def test_comparison_equals_a_loop(spark, bucket_rows):
    rng = random.Random(5)
    rows = [(rng.choice([i * i, i]), _text(rng, rng.randint(0, 300))) for i in range(60)]
    rows += [(4, None), (4, ""), (4, rows[3][1]), (4, rows[3][1]), (None, "no id"), (None, None), (-(1 << 62), "far"), (7, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "f", 0) for r in rows], "doc_id long, text string, fingerprint string, bucket int")
    got = cp.compare_with_edits(df, bucket_rows=bucket_rows)
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_ranges_are_even_however_ids_lie(spark):
    """An outlier, a hot id and many null ids: no range takes in many times its share."""
    rng = random.Random(8)
    rows = [(i, _text(rng, 20)) for i in range(3000)] + [(1 << 62, "far")] + [(5, _text(rng, 20) + str(i)) for i in range(1500)] + [(None, _text(rng, 20) + str(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, text string")
    edges = cp._Edges(df, len(rows), 100)
    texts = [t if i in (5, None) else None for i, t in rows]
    got = edges.ranges(pa.array([i for i, _ in rows], pa.int64()), pa.array(texts, pa.string())).to_numpy()
    sizes = np.bincount(got)
    assert len(sizes) > 50 and sizes.max() < 300
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), rows[i][1].encode()))
    assert (np.diff(got[order]) >= 0).all()


def test_small_tables(spark):
    df = spark.createDataFrame([(3, "alone in here")], "doc_id int, text string")
    (row,) = cp.compare_with_edits(df).collect()
    assert row.doc_id == 3 and row.near_next == 1.0
    empty = cp.compare_with_edits(df.where("false"))
    assert empty.count() == 0 and empty.columns == cp.compare_with_edits(df).columns
    only_null = spark.createDataFrame([(None, "a b c"), (None, "b")], "doc_id long, text string")
    assert sorted(map(tuple, cp.compare_with_edits(only_null).collect()), key=str) == _brute([(None, "a b c"), (None, "b")])
    own = cp.fingerprints(spark.createDataFrame([(1, "a b", "old"), (2, None, "o")], "doc_id long, text string, fingerprint string"))
    assert own.columns == ["doc_id", "text", "fingerprint_in", "fingerprint"] and own.where("doc_id = 2").first().fingerprint == ""
