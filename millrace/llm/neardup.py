"""Near-duplicates by SimHash and BK-trees at a wide radius, each link checked by exact Jaccard.

A text is the set of its five-word shingles. Equal sets are one node by their digest. Nodes meet in the
buckets of their min-hash bands, as blocks of bits leave next to nothing apart at such a radius; a BK-tree in each
bucket links the fingerprints within the radius (``simhash.linked``). What hangs together so is compared again
pair by pair, again through a BK-tree, and a pair links its nodes only if the Jaccard similarity of the
two sets reaches ``LEAST``. Pairs whose nodes are already joined need no check.
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

from millrace.llm import simhash
from millrace.llm.shared import dealt_out, let_go, stored
from millrace.operators.components import components

SHINGLE, LEAST = 5, 0.8
#: Bits that two fingerprints of sets with a similarity of ``LEAST`` or more may differ by: 9.7 are expected at 0.8.
RADIUS = 16
#: Bands of two min-hashes: at 0.8 a pair shares none of six with a probability of 0.36 ** 6.
BANDS, ROWS = 6, 2
#: Nodes of a linked group that one task compares; larger groups become pairs of parts.
PART = 1024

_RANDOM = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct XXH64 hashes, ascending, of a text's shingles; words as in ``simhash.fingerprint``."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][: max(1, len(words) - SHINGLE + 1)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], simhash.SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :].tolist())])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED) - (1 << 63)


def fingerprint(found: np.ndarray) -> int:
    """The signed SimHash of a set: the majority bits of its members."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        counts += np.unpackbits(found[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big", signed=True)


def bands(found: np.ndarray) -> list[int]:
    if not len(found):
        return [0] * BANDS
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 65_536):
        np.minimum(least, ((found[at : at + 65_536, None] ^ _XOR) * _TIMES).min(0), out=least)
    least = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), simhash.SEED) - (1 << 63) for row in least]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x) for x in batch.column(1).to_pylist()]
        marks = [[node(s) for s in sets], [fingerprint(s) for s in sets]]
        yield pa.record_batch([batch.column(0), *[pa.array(m, pa.int64()) for m in marks], pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["id", "node", "fp", "bands"])
    let_go()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x) for x in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array([node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])
    let_go()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def near(fp: np.ndarray, radius: int, block: int = 256, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of all pairs a < b of positions whose fingerprints are within the radius, in blocks, closest first in each.

    A block has ``block`` fingerprints' pairs, ``most`` at a time, so memory does not grow with the square of the positions.
    """
    distinct, place = np.unique(fp, return_inverse=True)
    one = np.zeros(len(distinct), np.int64)
    forest = simhash.Forest(distinct, one)
    order = np.argsort(place, kind="stable")
    size = np.bincount(place, minlength=len(distinct))
    start = np.cumsum(size) - size
    for at in range(0, len(distinct), block):
        q, n = forest.within(distinct[at : at + block], one[at : at + block], radius)
        q = q + at
        q, n = q[q <= n], n[q <= n]
        times = size[q] * size[n]
        ends = np.cumsum(times)
        for low in range(0, int(ends[-1]) if len(ends) else 0, most):
            spot = np.arange(low, min(low + most, int(ends[-1])))
            which = np.searchsorted(ends, spot, "right")
            rest = spot - (ends - times)[which]
            a = order[start[q[which]] + rest // size[n[which]]]
            b = order[start[n[which]] + rest % size[n[which]]]
            keep = (a < b) | ((q[which] != n[which]) & (a != b))
            a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            by = np.argsort(np.bitwise_count(fp[a] ^ fp[b]), kind="stable")
            yield a[by], b[by]


def _checked(radius: int, least: float):
    def links(table: pa.Table) -> pa.RecordBatch:
        nodes, own = table["node"].to_numpy(), table["own"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        size = np.array([len(s) for s in sets])
        two = (own != own[0]).any()
        top = np.arange(len(nodes))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        u, v = [], []
        for a, b in near(table["fp"].to_numpy().view(np.uint64), radius):
            # Two parts meet here: pairs inside a part are another unit's. Sizes too far apart can't be similar, and
            # what is joined needs no check.
            while ((flat := top[top]) != top).any():
                top[:] = flat
            if (top == top[0]).all():
                break
            keep = (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])) & ((own[a] != own[b]) | (not two)) & (top[a] != top[b])
            for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                x, y = root(i), root(j)
                if x != y and jaccard(sets[i], sets[j]) >= least:
                    top[max(x, y)] = min(x, y)
                    u.append(nodes[i])
                    v.append(nodes[j])
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_unit = [], None
        for batch in batches:
            unit = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    if held and unit[x] != open_unit:
                        yield links(pa.Table.from_batches(held))
                        held = []
                    open_unit = unit[x]
                    held.append(batch.slice(x, y - x))
        if held:
            yield links(pa.Table.from_batches(held))
        held = []
        let_go()

    return run


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int, least: float, part: int = PART) -> DataFrame:
    """(id, fp, root, component_id) for every row; ``fp`` is the row's node, root the least node of its component."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    marks = stored(source.mapInArrow(_marks, f"id {id_type}, node long, fp long, bands array<long>"), "neardup")
    nodes = stored(marks.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "neardup-nodes")
    keyed = nodes.select("fp", F.posexplode("bands").alias("block", "value")).distinct()
    loose = components(simhash.linked(keyed, radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(loose, "fp", "left").select("node", "fp", "least", F.coalesce("root", "fp").alias("loose"))
    sizes = rooted.groupBy("loose").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    some = stored(rooted.join(sizes, "loose").select("node", "fp", "least", "loose", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("own")), "neardup-loose")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    wanted = some.select("least").distinct()
    sets = texts.join(wanted, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text").mapInArrow(_sets, "node long, members binary")
    sets = sets.join(some, "node").dropDuplicates(["node"])
    met = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = met.select(F.xxhash64("loose", F.least("own", "with"), F.greatest("own", "with")).alias("unit"), "node", "fp", "own", "members")
    dealt = dealt_out(rows, "unit").sortWithinPartitions("unit")
    links = dealt.mapInArrow(_checked(radius, least), "u long, v long")
    roots = components(links)
    named = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.select("id", "node").join(named.select("node", "root").join(groups, "root"), "node").select("id", F.col("node").alias("fp"), "root", "component_id")


@F.pandas_udf(LongType())
def _node_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: node(shingles(x)))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """As ``simhash.keep_one_each``, for groups of texts whose five-word shingles have a Jaccard similarity of ``least``."""
    return simhash.heads_only(docs, _components(docs, id_col, text_col, radius, least), _node_of, id_col, text_col)
