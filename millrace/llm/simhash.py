"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits, so
every fingerprint enters the bucket of each of its blocks and linked pairs always meet in a bucket. A
bucket is cut into shards of bounded size. A shard's fingerprints form a BK-tree (children keyed by the
integer distance to their parent); the tree is sent to every slice of the bucket's fingerprints, which
follow only the edges within the radius. Trees travel through the shuffle, not through the driver:
together they grow with the corpus, so a broadcast variable has no proven bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.llm.shared import dealt_out, stored
from millrace.operators.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints in one tree, and fingerprints that one task holds against a tree.
TREE_ROWS, SLICE_ROWS = 8192, 65536
_BLOCK_ROWS = 50_000
_HASHES = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of UTF-8 text: majority bits of the XXH64 of its word shingles.

    Only A-Z are lower-cased; words end at the six ASCII white-space bytes. Fewer words than a shingle
    make one shingle; no words make zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:size]
    ends = ends.tolist()[min(shingle, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, size, _HASHES):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _HASHES], ends[at : at + _HASHES])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > size).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array([fingerprint(x) for x in batch.column(1).to_pylist()], pa.int64())
        yield pa.record_batch([batch.column(0), marks], ["id", "fp"])


class Forest:
    """BK-trees over distinct fingerprints, one for each unit, built and searched a level at a time."""

    def __init__(self, fps: np.ndarray, units: np.ndarray) -> None:
        self.fps = fps
        self.unit_ids, first = np.unique(units, return_index=True)
        self.roots = first
        at = first[np.searchsorted(self.unit_ids, units)]
        rest = np.setdiff1d(np.arange(len(fps)), first)
        keys, kids = [], []
        while len(rest):
            key = at[rest] * 65 + np.bitwise_count(fps[rest] ^ fps[at[rest]])
            edge, child, group = np.unique(key, return_index=True, return_inverse=True)
            child = rest[child]
            keys.append(edge)
            kids.append(child)
            at[rest] = child[group]
            rest = rest[rest != child[group]]
        key, kid = np.concatenate([[-1], *keys]).astype(np.int64), np.concatenate([[-1], *kids]).astype(np.int64)
        order = np.argsort(key)
        self.keys, self.kids = key[order], kid[order]

    def within(self, fps: np.ndarray, units: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, node) of every pair of one unit at most ``radius`` bits apart."""
        place = np.searchsorted(self.unit_ids, units)
        known = (place < len(self.unit_ids)) & (self.unit_ids[np.minimum(place, len(self.unit_ids) - 1)] == units)
        query = np.flatnonzero(known)
        node = self.roots[place[query]]
        found_q, found_n = [query[:0]], [node[:0]]
        while len(query):
            far = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            hit = far <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            nexts = []
            for step in range(-radius, radius + 1):
                key = node * 65 + far + step
                ok = (far + step >= 0) & (far + step <= 64)
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok &= self.keys[spot] == key
                nexts.append((query[ok], self.kids[spot[ok]]))
            query, node = (np.concatenate(x) for x in zip(*nexts))
        return np.concatenate(found_q), np.concatenate(found_n)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(unit: np.ndarray, kind: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch | None:
    """Links of whole units, thinned to stars around the least member of what each block of queries joins."""
    tree = np.flatnonzero(kind <= 1)
    ask = np.flatnonzero(kind != 1)
    forest = Forest(fp[tree], unit[tree])
    u, v = [], []
    for at in range(0, len(ask), 16_384):
        own = ask[at : at + 16_384]
        q, node = forest.within(fp[own], unit[own], radius)
        a, b = own[q], tree[node]
        a, b = a[a != b], b[a != b]
        if len(a):
            members, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = _least_labels(len(members), place[: len(a)], place[len(a) :])
            moved = label != np.arange(len(members))
            u.append(fp[members[moved]])
            v.append(fp[members[label[moved]]])
    if not u:
        return None
    return pa.record_batch([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], ["u", "v"])


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _BLOCK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                unit = table["unit"].to_numpy()
                cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
                if cut:
                    part = table.slice(0, cut)
                    if (out := _links(*_columns(part), radius)) is not None:
                        yield out
                    table = table.slice(cut)
                held, rows = table.to_batches(), table.num_rows
        if rows and (out := _links(*_columns(pa.Table.from_batches(held)), radius)) is not None:
            yield out

    return run


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table["unit"].to_numpy(), table["kind"].to_numpy(), table["fp"].to_numpy().view(np.uint64)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the ``radius + 1`` blocks that make up 64 bits."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp``: enough of them to connect all within the radius.

    Exact for any radius below 64. A bucket over ``tree_rows`` becomes several trees; each tree is sent
    to all slices of its bucket, so no task holds more than one tree and one slice.
    """
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    keys = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)).alias("value"))
        for i, (shift, width) in enumerate(blocks(radius))
    ]
    return linked(distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.value"), radius, tree_rows, slice_rows)


def linked(keyed: DataFrame, radius: int, tree_rows: int = TREE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Links (u, v) that connect all within the radius in a bucket; ``keyed`` has distinct (fp, block, value)."""
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_rows).cast("int")
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    placed = keyed.join(sizes, ["block", "value"]).select(
        "fp", "block", "value", trees.alias("trees"), slices.alias("slices"),
        F.pmod(F.xxhash64("fp", F.lit(1)), trees).cast("int").alias("own"),
        F.pmod(F.xxhash64("fp", F.lit(2)), slices).cast("int").alias("slice"),
    )
    # kind 0: a member of its tree that also asks it; 1: a copy of the tree for another slice; 2: asks an earlier tree.
    members = placed.select("fp", "block", "value", F.col("own").alias("tree"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("to")).withColumn("kind", F.when(F.col("to") == 0, 0).otherwise(1))
    askers = placed.where("own > 0").select("fp", "block", "value", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("tree"), F.col("slice").alias("to")).withColumn("kind", F.lit(2))
    rows = members.unionByName(askers).select(F.xxhash64("block", "value", "tree", "to").alias("unit"), "kind", "fp")
    dealt = dealt_out(rows, "unit").sortWithinPartitions("unit", "kind")
    return dealt.mapInArrow(_linker(radius), "u long, v long")


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(id, fp, root, component_id) for every row: root is the least fingerprint of the component."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    marks = stored(source.mapInArrow(_fingerprints, f"id {id_type}, fp long"), "simhash")
    distinct = stored(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(groups, "root").select("fp", "root", "component_id")
    return marks.join(named, "fp").select("id", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: the id, ``fp`` (signed 64-bit fingerprint) and ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprints within the radius. Null texts count
    as empty; empty texts have fingerprint zero and link like any other. Equal ids and repeated rows
    are kept, each with its own fingerprint; null ids never become a component's id unless it has no
    other (then null). An empty table gives an empty result. Other columns are not read.
    """
    return _components(docs, id_col, text_col, radius).select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@F.pandas_udf(LongType())
def _fp_of(text: pd.Series) -> pd.Series:
    return text.map(fingerprint)


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: its smallest id.

    All columns stay. Of rows that repeat that id one stays for each group. A group whose ids are all
    null keeps one of its rows.
    """
    return heads_only(docs, _components(docs, id_col, text_col, radius), _fp_of, id_col, text_col)


def heads_only(docs: DataFrame, parts: DataFrame, mark_of, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that lead the components ``parts`` (id, fp, root, component_id); ``mark_of`` gives a text's fp."""
    per = parts.groupBy("id", "root").agg(F.min("fp").alias("fp"), F.min("component_id").alias("least"))
    per = stored(per, "simhash-heads")
    heads = per.where("id <=> least")
    ids = per.groupBy("id").agg(F.count("*").alias("groups"), F.max(F.col("id").eqNullSafe(F.col("least"))).alias("leads")).where("leads")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    usual = ids.where("groups = 1 and id is not null").select("id")
    one = plain.join(usual, F.col(at) == F.col("id"), "left_semi").dropDuplicates([at])
    # Ids that are null or have rows in several groups: the fingerprint tells their rows apart.
    odd = ids.where("groups > 1 or id is null").select("id")
    if odd.isEmpty():
        return one.toDF(*docs.columns)
    # Stored, for else the texts of all rows would be marked before the joins pick some.
    rows = stored(plain.join(odd, F.col(at).eqNullSafe(F.col("id")), "left_semi"), "simhash-odd").withColumn("fp", mark_of(F.col(text).cast("binary")))
    named = heads.select(F.col("id").alias("head"), F.col("root"), "fp")
    more = rows.join(named, (F.col(at).eqNullSafe(F.col("head"))) & (rows["fp"] == named["fp"]), "left_semi").dropDuplicates([at, "fp"]).drop("fp")
    return one.unionByName(more).toDF(*docs.columns)
