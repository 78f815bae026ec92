"""Ranked lexical search: postings are traversed in document windows, scores gather in a small array, a heap harvests.

A query block's terms are looked up in every text once; what a document has of them is stored. Then each task
takes its documents in windows in the order of their ids, inverts a window into postings, adds a query's
impacts into an array of one slot for each document, marks the blocks of slots that were met in an occupancy
set, and harvests only those into the query's heap. Scores are integers, so sums do not depend on their order.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

#: Documents of a window at most (an array of 64 KB of sums), its postings at most, and slots of a block of the occupancy set.
SLOTS, _POSTINGS, _BLOCK = 8192, 1 << 20, 64
#: Bytes of the items' texts in a block of queries, on average: what is sent to the tasks.
BLOCK_BYTES = 4 << 20
_PIECE = 1 << 20
_TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: A-Z become small, bytes that are in no term become spaces; UTF-8 keeps every other character in bytes over 127.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _TERM_BYTES else 32 for c in range(256))

_MATCHES = "id long, n long, terms array<int>, tfs array<long>"
_BEST = "query int, id long, score long"


def term_counts(text: str | None, known: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """All terms of a text, counted; the counter has those in ``known`` (any, if None). Long texts are taken in pieces."""
    folded = (text or "").encode().translate(_FOLD)
    n, found, at = 0, Counter(), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= _PIECE else folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        piece = folded[at:end].split()
        n += len(piece)
        found.update(piece if known is None else [t for t in piece if t in known])
        at = end
    return n, found


def _look_up(terms) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            ns, ids, tfs = [], [], []
            for text in batch.column(1):
                n, found = term_counts(text.as_py(), known)
                ns.append(n)
                ids.append([known[t] for t in found])
                tfs.append(list(found.values()))
            yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of at most SLOTS documents and about _POSTINGS postings, each in the order of ids, null ids last."""
    held, rows, postings = [], 0, 0
    def window() -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.take(pc.sort_indices(table, [("id", "ascending")], null_placement="at_end"))
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            more = len(part.column(2).flatten())
            if held and (rows + part.num_rows > SLOTS or postings + more > _POSTINGS):
                yield window()
                held, rows, postings = [], 0, 0
            held.append(part)
            rows, postings = rows + part.num_rows, postings + more
    if held:
        yield window()


class _Harvest:
    """A query's best documents so far: a heap whose root is the worst of them; ties stay with the smaller id, null last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """A score below this cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def take(self, scores: np.ndarray, slots: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:  # slots are in the order of ids, so a stable order keeps ties right
            best = np.argsort(-scores, kind="stable")[: self.k]
            scores, slots = scores[best], slots[best]
        for score, slot in zip(scores.tolist(), slots.tolist()):
            i = ids[slot]
            entry = (score, i is not None, -(i or 0))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def _search(block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = block.value
        harvests = [_Harvest(k) for _ in items]
        sums, met = np.zeros(SLOTS, np.int64), np.zeros(SLOTS // _BLOCK, bool)
        for table in _windows(batches):
            ids = table.column("id").to_pylist()
            lists = table.column("terms").combine_chunks()
            term = lists.flatten().to_numpy(zero_copy_only=False)
            tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            slot = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            length = 75 + 25 * table.column("n").to_numpy() * n_docs // max(n_terms, 1)
            order = np.argsort(term, kind="stable")  # postings by term, within a term by slot
            term, tf, slot = term[order], tf[order], slot[order]
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length[slot]))
            ends = np.searchsorted(term, np.arange(len(weights) + 1))
            for harvest, (_, terms) in zip(harvests, items):
                for t, repeats in terms:
                    a, b = ends[t], ends[t + 1]
                    if a < b:
                        sums[slot[a:b]] += repeats * impact[a:b]
                        met[slot[a:b] // _BLOCK] = True
                blocks = np.flatnonzero(met)
                if len(blocks):
                    there = sums.reshape(-1, _BLOCK)[blocks]
                    row, col = np.nonzero(there >= harvest.least)
                    if len(row):
                        harvest.take(there[row, col], blocks[row] * _BLOCK + col, ids)
                    sums.reshape(-1, _BLOCK)[blocks] = 0
                    met[blocks] = False
        out = [(q, -e[2] if e[1] else None, e[0]) for q, h in enumerate(harvests) for e in h.heap]
        if out:
            q, i, s = zip(*out)
            yield pa.record_batch([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query", "id", "score"])

    return run


def _search_block(docs: DataFrame, items: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    """(item_id, rank, id, score) of one block of items over all documents."""
    spark = docs.sparkSession
    terms = {t: i for i, t in enumerate(sorted({t for _, c in items for t in c}))}
    found = docs.mapInArrow(_look_up(spark.sparkContext.broadcast(terms)), _MATCHES)
    found = stored(found.sortWithinPartitions("id"), "matches")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["count"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # at most the block's terms
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    coded = [(i, [(terms[t], n) for t, n in c.items()]) for i, c in items]
    best = found.mapInArrow(_search(spark.sparkContext.broadcast((coded, weights, n_docs, n_terms)), k), _BEST)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "query int, item_id long")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item, rank, id, score): each item's ``k`` highest-scoring documents with a score above 0, ties to the smaller id.

    Null texts have no terms; items without terms, or without a document that holds one, have no rows. Null ids of
    documents come last among ties. Rows of documents or items that repeat are documents and items of their own; rows
    equal in id and score have ranks next to each other. Empty tables give no rows. Other columns are not read.
    Items are taken in blocks of some BLOCK_BYTES of text (a longer item is one block's), chosen by a hash; each block
    is one pass over all documents, and only a block's items and their terms' counts pass through the driver.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    deal = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    out = spark.createDataFrame([], "item_id long, rank int, id long, score long")
    for b in range(n_blocks):
        block = [(r["item"], term_counts(r["text"])[1]) for r in asked.where(deal == b).collect()]
        if any(c for _, c in block):
            out = out.unionByName(_search_block(pairs, block, k))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
