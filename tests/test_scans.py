"""Scans by rounds of reservations, and local search, against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import scans, search


def _mark(seed, item):
    return hashlib.sha1(f"{seed}|{item}".encode()).hexdigest()


def _plain_scan(rows, seats):
    """``rows`` in order, each the set of keys it asks for; ``seats`` maps a key to its seats."""
    left, out = {}, []
    for name, keys in rows:
        if all(left.get(k, seats(k)) > 0 for k in keys):
            out.append(name)
            left.update({k: left.get(k, seats(k)) - 1 for k in keys})
    return out


@pytest.mark.parametrize("pods, cells", [(40, 5), (1, 9)])
def test_rounds_equal_the_scan(spark, pods, cells):
    r = random.Random(pods)
    rows = [(i, f"p{min(r.randrange(pods), r.randrange(pods))}" if r.random() > 0.1 else None, r.randrange(cells), r.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:9], "item int, pod string, cell int, ph int").withColumn("part", F.lit("x")).withColumn("taken", F.lit(1))
    few = spark.createDataFrame([(0, 2), (3, 0)], "cell int, seats int")
    got = scans.greedy_scan(df.repartition(5), "item", [(["pod"], 4, None), (["cell"], 12, few)], 5, "ph")
    order = sorted(rows, key=lambda x: (x[3], _mark(5, x[0])))
    want = _plain_scan([(i, [("pod", p), ("cell", c)]) for i, p, c, _ in order], lambda k: 4 if k[0] == "pod" else {0: 2, 3: 0}.get(k[1], 12))
    assert sorted(x.item for x in got.collect()) == sorted(want)
    assert set(got.columns) == {"item", "ph", "pod", "cell"}


def test_an_empty_scan_and_one_item_of_many_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "b")], "item int, cell string")
    assert scans.greedy_scan(rows.where("false"), "item", [(["cell"], 1, None)], 1).count() == 0
    got = scans.greedy_scan(rows, "item", [(["item"], 1, None), (["cell"], 9, None)], 1).collect()
    assert sorted(str(x.item) for x in got) == ["1", "2", "None"]


def test_fills_equal_a_scan_of_short_cells(spark):
    r = random.Random(8)
    rows = [(i, "s", r.randrange(3), min(r.randrange(2), r.randrange(2)), r.random() < 0.3, f"p{r.randrange(25)}") for i in range(90)]
    seats = {(a, b): 14 for a in range(3) for b in range(2)}
    table = spark.createDataFrame([("s", a, b, n) for (a, b), n in seats.items()], "st string, r int, c int, seats int")
    got = scans.filled_scan(spark.createDataFrame(rows, "id int, st string, r int, c int, old boolean, pod string"), table, "st", "r", "c", "id", "old", "pod", 3, 5)
    order = sorted(rows, key=lambda x: (not x[4], _mark(5, x[0])))
    own = _plain_scan([((i, a, b, None, None, p), [("pod", p), (a, b)]) for i, _, a, b, _, p in order], lambda k: 3 if k[0] == "pod" else seats[k])
    left = [x for x in order if x[0] not in {o[0] for o in own}]
    pods = {f"p{k}": sum(o[5] == f"p{k}" for o in own) for k in range(25)}
    need = {k: n - sum((o[1], o[2]) == k for o in own) for k, n in seats.items()}
    asks = [((i, a, b, x, y, p), [("id", i), ("to", x, y), ("pod", p)]) for x, y in sorted(seats) for i, _, a, b, _, p in sorted(left, key=lambda z: (2 * abs(z[2] - x) + abs(z[3] - y), z[2], z[3], not z[4], _mark(5, z[0])))]
    given = _plain_scan(asks, lambda k: {"id": 1, "pod": 3 - pods.get(k[1], 0)}.get(k[0], need.get(k[1:], 0)))
    assert given
    assert {(x.id, x.r, x.c, x.to_row, x.to_column, x["pod"]) for x in got.collect()} == set(own) | set(given)


def _score(chosen, groups, n, least):
    count = lambda ids, side: {f: sum(f in groups[g][side] for g in ids) for f in {f for x in groups.values() for f in x[side]}}
    shares, held = count(groups, 0), count(chosen, 0)
    floors, rare = count(groups, 1), count(chosen, 1)
    return sum(abs(held[f] / n - shares[f] / len(groups)) for f in shares) + sum(max(0, min(least, floors[f] // 2) - rare[f]) for f in floors)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_swap_improves_a_search(spark, seed):
    r = random.Random(seed)
    groups = {g: ([f"cat{min(r.randrange(6), r.randrange(6))}", f"cell{r.randrange(4)}"], [f"q{q}" for q in range(5) if r.random() < 0.15]) for g in range(60)}
    df = spark.createDataFrame([(g, *x) for g, x in groups.items()], "g int, cells array<string>, rare array<string>").withColumn("mark", F.lit(0))
    got = {x.g for x in search.local_search(df, "g", "cells", "rare", 11, 3, seed).collect()}
    start = sorted(groups, key=lambda g: _mark(seed, g))[:11]
    end = _score(got, groups, 11, 3)
    assert len(got) == 11 and end < _score(start, groups, 11, 3)
    assert all(_score(got - {a} | {b}, groups, 11, 3) >= end - 1e-8 for a in got for b in set(groups) - got)


def test_searches_of_odd_groups(spark):
    df = spark.createDataFrame([(1, None, None), (2, ["a", "a", None], []), (3, ["a"], ["q"])], "g int, cells array<string>, rare array<string>")
    assert search.local_search(df, "g", "cells", "rare", 3, 1, 1).count() == 3
    assert search.local_search(df, "g", "cells", "rare", 1, 1, 1).count() == 1
    with pytest.raises(ValueError, match="cannot choose 4"):
        search.local_search(df, "g", "cells", "rare", 4, 1, 1)
