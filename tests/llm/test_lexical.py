"""Ranked search against plain Python: odd rows, blocks, ties, windows and copies."""

import math
import re
from collections import Counter

import pytest

from millrace.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, k=20):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in _terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(0, None), (1, ""), (2, "-- !!"), (3, "One fish TWO fish"), (4, "Ünï ÉÀ É one"), (5, "red\x00fish日本 語"), (6, "fish " * 3000 + "one"), (7, "z" * 4000)]
    docs += [(None, "one fish"), (None, "one fish"), (9, "two two"), (9, "two two"), (9, "two red")]
    docs += [(100 + i, "copies of one blue fish") for i in range(60)] + [(500 + i, f"rare{i} words of two kinds one") for i in range(40)]
    items = [(0, "one fish two fish red fish blue fish"), (1, None), (2, ""), (3, "unknown"), (None, "red"), (4, "ÉÀ É 日本"), (5, "copies copies"), (5, "copies copies"), (6, "rare7 rare8 Z z " + "z" * 4000)]
    make = lambda rows, name: spark.createDataFrame([(*r, 1, "n") for r in rows], f"{name} long, text string, id int, terms string")
    return docs, items, make(docs, "doc_id").repartition(3), make(items, "item_id")


def test_odd_rows(tables):
    docs, items, d, i = tables
    assert _got(lexical.search(d, i)) == _brute(docs, items)
    assert _got(lexical.search(d, i, k=3)) == _brute(docs, items, 3)
    assert _got(lexical.search(d.where("false"), i)) == _got(lexical.search(d, i.where("false"))) == []


def test_blocks_of_items(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)
    assert _got(lexical.search(d, i)) == _brute(docs, items)


def test_windows_and_pieces(monkeypatch):
    """Small windows, few postings and short pieces change nothing."""
    import pyarrow as pa

    rows = [(i * 37 % 101 if i % 9 else None, f"a{i % 7} b{i % 5} " * (i % 4)) for i in range(400)]
    items = [(q, Counter(_terms(f"a{q} b1 b1 b{q}"))) for q in range(6)]
    terms = {t.encode(): j for j, t in enumerate(sorted({t for _, c in items for t in c}))}

    class Held:
        def __init__(self, value):
            self.value = value

    def run():
        batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["id", "text"])
        matches = list(lexical._look_up(Held(terms))(iter([batch])))
        import numpy as np

        coded = [(q, [(terms[t.encode()], n) for t, n in c.items()]) for q, c in items]
        found = lexical._search(Held((coded, np.arange(1, len(terms) + 1), 300, 2000)), 20)(iter(matches))
        return sorted((tuple(r.values()) for b in found for r in b.to_pylist()), key=str)

    whole = run()
    monkeypatch.setattr(lexical, "_POSTINGS", 50)
    monkeypatch.setattr(lexical, "_PIECE", 3)
    assert run() == whole and len(whole) == 120
