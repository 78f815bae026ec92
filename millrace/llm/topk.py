"""Exact top-k inner products with a pivot table.

Every vector's distances to a fixed set of pivots are stored. For a query q and a vector x the largest
|d(q, p) - d(x, p)| over the pivots bounds d(q, x) from below, and so the inner product from above:
2 q.x = |q|^2 + |x|^2 - d(q, x)^2. Candidates are evaluated in the order of that bound, until the next bound
is below the k-th best score: the rest cannot enter the result.

Vectors are dealt by cells, those nearest to a pivot. The least and greatest distances of a cell to every pivot bound all
its pairs with another cell; pairs of cells whose bound is below what each query is known to reach are dropped before
anything is sent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

PIVOTS, SAMPLE = 32, 1024
#: Rows of a block of candidates and of a block of queries; a task holds one of each.
CANDIDATES, QUERIES = 32_768, 4096
_STEP = 512
_EXACT = float(1 << 53)


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    out = np.zeros((len(column), dims), np.int64)
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = values
    return out


def _numbers(x: np.ndarray) -> np.ndarray:
    """Floats, whose products are fast, where every sum of products is exact; else integers."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.float64) if most * most * max(1, x.shape[1]) < _EXACT else x


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Of a sample, vectors far from each other: each next one is farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def search_block(cand: np.ndarray, cand_ids: list, cand_far: np.ndarray, query: np.ndarray, query_ids: list, query_far: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's position, candidate's position, score) of the k best of a block for each query, none under its floor.

    The floor of a query is a score that its k-th best is known to reach.
    """
    both = _numbers(np.concatenate([cand, query]))
    x, q = both[: len(cand)], both[len(cand) :]
    size, own = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    out = []
    for i in range(len(q)):
        low = np.abs(cand_far - query_far[i]).max(1, initial=0)
        bound = (size + own[i] - low * low) / 2
        bound += 1e-9 * (size + own[i]) + 1e-6  # rounding never hides a candidate
        least = floor[i]
        order = np.flatnonzero(bound >= least)
        order = order[np.argsort(-bound[order], kind="stable")]
        best: list[tuple[int, int]] = []
        for at in range(0, len(order), _STEP):
            if bound[order[at]] < least:
                break
            part = order[at : at + _STEP]
            scores = x[part] @ q[i]
            for j in np.flatnonzero(scores >= least).tolist():
                c = int(part[j])
                if cand_ids[c] != query_ids[i] or cand_ids[c] is None:
                    best.append((int(scores[j]), c))
            best.sort(key=lambda b: (-b[0], cand_ids[b[1]] is None, cand_ids[b[1]]))
            del best[k:]
            if len(best) == k:
                least = max(least, best[-1][0])
        out += [(i, c, s) for s, c in best]
    return out


def _floors(sample: np.ndarray, sample_ids: list, query: np.ndarray, query_ids: list, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample without itself; none where there are fewer."""
    floor = np.full(len(query), -np.inf)
    if len(query) and len(sample):
        both = _numbers(np.concatenate([sample, query]))
        known = (both[: len(sample)] @ both[len(sample) :].T).T
        for i in range(len(query)):
            mine = known[i][[s != query_ids[i] or s is None for s in sample_ids]]
            if len(mine) >= k:
                floor[i] = np.partition(mine, -k)[-k]
    return floor


class Bounds(NamedTuple):
    """Rows of a cell, their greatest squared norm, least floor, and least and greatest distance to each pivot."""

    n: int
    size: float
    floor: float
    low: list[float]
    high: list[float]


def _bounds(rows: DataFrame, pivots: int) -> dict[int, Bounds]:
    """By cell; at most as many rows as pivots reach the driver."""
    low, high = (F.array(*[f(F.get("far", F.lit(i))) for i in range(pivots)]) for f in (F.min, F.max))
    found = rows.groupBy("cell").agg(F.count("*"), F.max("size"), F.min("floor"), low, high).collect()
    return {r[0]: Bounds(*list(r)[1:]) for r in found}


def cell_pairs(cands: dict[int, Bounds], queries: dict[int, Bounds]) -> set[tuple[int, int]]:
    """(cell of candidates, cell of queries) that can hold a score at or above the least floor of the queries."""
    out = set()
    for c, x in cands.items():
        for q, y in queries.items():
            gap = np.maximum(0, np.maximum(np.array(x.low) - y.high, np.array(y.low) - x.high)).max(initial=0)
            bound = (x.size + y.size - gap * gap) / 2
            if bound + 1e-9 * (x.size + y.size) + 1e-6 >= y.floor:
                out.add((c, q))
    return out


def _packed(bounds: dict[int, Bounds], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each cell: large cells have blocks of ``most`` rows, small ones share, near ones first."""
    left, order = sorted(bounds), []
    while left:  # a chain of nearest pivots
        far = _distances(pivots[left], pivots[order[-1:]])[:, 0] if order else np.zeros(len(left))
        order.append(left.pop(int(far.argmin())))
    out, block, rows = {}, 0, 0
    for cell in order:
        n = bounds[cell].n
        if rows and rows + n > most:
            block, rows = block + 1, 0
        count = -(-n // most)
        out[cell] = (block, count)
        block, rows = (block + count, 0) if count > 1 else (block, rows + n)
    return out


def _range(place: dict[int, tuple[int, int]], part: str) -> Column:
    pairs = [v for cell, (first, n) in place.items() for v in (cell, first if part == "first" else n)]
    return F.element_at(F.create_map(*[F.lit(v).cast("int") for v in pairs]), F.col("cell"))


def _blocks(to: dict[int, list[tuple[int, int]]]) -> Column:
    """Every block that a row's cell meets."""
    text = json.dumps({str(c): [{"a": first, "b": first + n - 1} for first, n in ranges] for c, ranges in to.items()})
    ranges = F.element_at(F.from_json(F.lit(text), "map<string,array<struct<a:int,b:int>>>"), F.col("cell").cast("string"))
    return F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["b"]))))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0, pivots: int = PIVOTS, candidate_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best scores of every row whose id is divisible by ``every``.

    Components become floor(scale * x); the score is the integer inner product. Candidates are all
    rows whose id differs from the query's (null ids included, last among ties); ties go to smaller ids.
    Rows whose vector is null or holds a null or non-finite component take no part; shorter vectors
    count as filled with zeros. Equal rows are one query; rows with one id but different vectors
    are each a query, so the id's ranks come as often. Fewer candidates than ``k`` give fewer rows; no queries give none. Other columns are not read.

    The pivots come from a sample of at most 1,024 vectors; besides it the driver sees counts and bounds of at most as
    many cells as pivots. Blocks of a cell's candidates meet blocks of queries in an equi-join on their numbers.
    """
    spark = vectors.sparkSession
    usable = F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable)
    rows = rows.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))
    rows = rows.withColumn("deal", F.xxhash64("id", "vector"))
    dims, n, asked = rows.agg(F.max(F.size("vector")), F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    schema = f"query_id long, rank int, {id_col} long, score long"
    if not asked:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy("deal", "id").limit(SAMPLE).select("id", "vector").toArrow()
    sample_x, sample_ids = _matrix(sample["vector"].combine_chunks(), dims), sample["id"].to_pylist()
    chosen = choose_pivots(sample_x, pivots)

    def pivot_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            far = _distances(x, chosen)
            ids = b.column(0).to_pylist()
            own = [i for i, key in enumerate(ids) if key is not None and key % every == 0]
            floor = np.full(len(ids), -np.inf)
            floor[own] = _floors(sample_x, sample_ids, x[own], [ids[i] for i in own], k)
            size = (x.astype(np.float64) ** 2).sum(1)
            more = [pa.FixedSizeListArray.from_arrays(far.ravel(), len(chosen)).cast(pa.list_(pa.float64())), pa.array(far.argmin(1), pa.int32()), pa.array(size), pa.array(floor)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *more], ["id", "vector", "deal", "far", "cell", "size", "floor"])

    table = stored(rows.mapInArrow(pivot_table, "id long, vector array<long>, deal long, far array<double>, cell int, size double, floor double"), "pivots")
    asks = table.where(F.col("id") % every == 0).dropDuplicates(["id", "deal"])
    cands, queries = (_bounds(t, len(chosen)) for t in (table, asks))
    meet = cell_pairs(cands, queries)
    c_place, q_place = _packed(cands, chosen, candidate_rows), _packed(queries, chosen, query_rows)
    block = lambda place, salt: _range(place, "first") + F.pmod(F.xxhash64("deal", F.lit(salt)), _range(place, "n")).cast("int")
    to = {c: sorted({q_place[q] for q in queries if (c, q) in meet}) for c in cands}
    back = {q: sorted({c_place[c] for c in cands if (c, q) in meet}) for q in queries}
    sent = table.select("id", "vector", "far", block(c_place, 1).alias("c"), F.explode(_blocks(to)).alias("q"))
    asked = asks.select("id", "vector", "far", "floor", F.col("deal").alias("row"), block(q_place, 2).alias("q"), F.explode(_blocks(back)).alias("c"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left["id"].to_pylist(), right["id"].to_pylist()
        found = []
        if len(ids) and len(own):
            x, q = (_matrix(t["vector"].combine_chunks(), dims) for t in (left, right))
            far, q_far = (np.array(t["far"].combine_chunks().flatten().to_numpy()).reshape(-1, len(chosen)) for t in (left, right))
            found = search_block(x, ids, far, q, own, q_far, right["floor"].to_numpy(), k)
        i, c, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array([own[j] for j in i], pa.int64()), "row": pa.array([right["row"][j].as_py() for j in i], pa.int64()), "id": pa.array([ids[j] for j in c], pa.int64()), "score": pa.array(s, pa.int64())})

    best = sent.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInArrow(search, "query_id long, row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
