"""Document fingerprints from content-defined chunks: a rolling gear hash cuts, chunk digests are the fingerprint.

Chunking is normalised: below the usual size a boundary needs more zero bits, above it fewer, so sizes
gather around the usual one, and an insertion moves only the boundaries near it. A fingerprint is the
set of chunk digests, each with its chunk's length; what two texts share is measured by length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk: at least, usually, at most.
LEAST, USUAL, MOST = 16, 40, 160
#: Zero bits that a boundary needs before and after the usual size; the low bits of a gear hash see few bytes.
_HARD, _EASY = np.uint32(0xFE000000), np.uint32(0xF0000000)
_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear" + bytes([i])).digest()[:4] for i in range(256)), "<u4").astype(np.uint32)
_SEGMENT = 1 << 22
_ENTRY = 8  # bytes: six of the digest, two of the length
#: Ranges of documents at most, documents of a range, rows drawn for each range's edge, and code points of a text in an edge.
_RANGES, _BUCKET_ROWS, _DRAWS, _PREFIX = 16_384, 1024, 8, 64


def _hits(data: bytes) -> tuple[list[int], list[int]]:
    """Ends of chunks (one past a byte) that the hard and the easy mask allow."""
    hard, easy = [], []
    for at in range(0, len(data), _SEGMENT):
        low = max(0, at - 31)  # the hash sees 32 bytes
        x = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + _SEGMENT) - low, low)]
        for step in (1, 2, 4, 8, 16):
            y = x.copy()
            y[step:] += x[:-step] << np.uint32(step)
            x = y
        x = x[at - low :]
        soft = np.flatnonzero((x & _EASY) == 0)
        easy += (soft + at + 1).tolist()
        hard += (soft[(x[soft] & _HARD) == 0] + at + 1).tolist()
    return hard, easy


def chunks(data: bytes) -> list[bytes]:
    """The chunks of ``data``, in order; together they are the data."""
    hard, easy = _hits(data)
    out, start, size = [], 0, len(data)
    h = e = 0
    while start < size:
        h = bisect_left(hard, start + LEAST, h)
        end = hard[h] if h < len(hard) else size
        if end > start + USUAL:
            e = bisect_left(easy, start + USUAL + 1, e)
            end = min(easy[e] if e < len(easy) else size, start + MOST, size)
        out.append(data[start:end])
        start = end
    return out


def entries(text: str) -> frozenset[bytes]:
    """Digest and length of each distinct chunk."""
    digest = xxhash.xxh64_digest
    return frozenset([digest(c)[:6] + len(c).to_bytes(2, "big") for c in chunks(text.encode())])


def likeness(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    """Bytes in shared chunks over the bytes in the smaller set: 1 if it is contained, or if both are empty."""
    if not a or not b:
        return float(not a and not b)
    weigh = lambda s: sum([x[6] << 8 | x[7] for x in s])
    return weigh(a & b) / min(weigh(a), weigh(b))


def as_text(found: frozenset[bytes]) -> str:
    """The fingerprint: entries in order, in hex; empty for an empty text."""
    return b"".join(sorted(found)).hex()


def from_text(fingerprint: str) -> frozenset[bytes]:
    data = bytes.fromhex(fingerprint)
    return frozenset(data[i : i + _ENTRY] for i in range(0, len(data), _ENTRY))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with ``fingerprint``; null text counts as empty. A column of that name is kept as ``fingerprint_in``."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", fp string"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([as_text(entries(t or "")) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch(batch.columns + [made], batch.schema.names + ["fp"])

    return plain.mapInArrow(run, schema).toDF(*[f"{c}_in" if c.lower() == "fingerprint" else c for c in docs.columns], "fingerprint")


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row that waits for its next one: bucket, id, text, entries.
        held = None
        for batch in batches:
            rows = []
            for bucket, tail, key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if tail and held is None:
                    continue  # only the first row after a bucket counts
                own = entries(text)
                if held is not None:
                    _, id_, body, print_ = held
                    new = edited(body, text)
                    after = entries(new)
                    rows.append((id_, len(body), hashlib.sha256(new.encode()).hexdigest(), as_text(print_), as_text(after), likeness(print_, after), likeness(print_, own)))
                held = None if tail else (bucket, key, text, own)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return run


class _Edges:
    """Where the ranges of documents begin, in descending order of ids with nulls last; one id's rows go by text."""

    def __init__(self, rows: DataFrame, n: int, bucket_rows: int) -> None:
        buckets = min(_RANGES, -(-n // bucket_rows))
        share = min(1.0, buckets * _DRAWS / n)
        drawn = rows.where(F.rand(7) < share).select("id").toArrow()["id"] if buckets > 1 else pa.chunked_array([], pa.int64())
        ids = np.sort(~drawn.drop_null().to_numpy())
        spots = np.arange(1, buckets) * len(drawn) // buckets if len(drawn) else np.zeros(0, int)
        self.keys, times = np.unique(ids[spots[spots < len(ids)]], return_counts=True)
        self.hot = {int(k): t for k, t in zip(self.keys, times.tolist()) if t > 1}
        nulls = int((spots >= len(ids)).sum())
        self.texts: dict[int | None, list[str]] = {int(k): [""] for k in self.keys}
        if self.hot or nulls:  # one id, or none, has rows for several ranges: texts part them
            drawn = rows.where(F.col("id").isin([~k for k in self.hot]) | F.col("id").isNull()).where(F.rand(8) < share)
            found: dict[int | None, list[str]] = {}
            for r in drawn.select("id", F.left("text", F.lit(_PREFIX)).alias("t")).collect():
                found.setdefault(None if r.id is None else ~r.id, []).append(r.t)
            for key, count in [*self.hot.items(), (None, nulls)]:
                texts = sorted(found.get(key, []))
                first = [""] if key is not None else []
                self.texts[key] = sorted({*first, *[texts[i * len(texts) // (count + 1)] for i in range(1, count + 1) if texts]})
        self.start = np.cumsum([0, *[len(self.texts[int(k)]) for k in self.keys]])

    def needs_text(self, column: str) -> Column:
        """The text's start where it decides on the range, else null."""
        odd = F.col("id").isNull() if self.texts.get(None) else F.lit(False)
        return F.when((F.col("id").isin([~k for k in self.hot]) | odd) if self.hot else odd, F.left(column, F.lit(_PREFIX)))

    def range_of(self, key: int | None, text: str | None) -> int:
        """The range of a row with the key of an edge, or with none."""
        before = self.start[-1] if key is None else self.start[np.searchsorted(self.keys, key)]
        return int(before) + bisect_right(self.texts.get(key, []), text or "")

    def ranges(self, ids: pa.Array, texts: pa.Array) -> pa.Array:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        keys = ~ids.fill_null(0).to_numpy()
        place = np.searchsorted(self.keys, keys, "right")
        out = np.where(none, self.start[-1], self.start[place])
        for i in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.range_of(None if none[i] else int(keys[i]), texts[i].as_py())
        return pa.array(out.astype(np.int32))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = _BUCKET_ROWS) -> DataFrame:
    """One row per input row: the id, n_chars, its own and its edited text's fingerprint, and how alike they are.

    The edited text takes its second half from the next document by descending id (after the last comes
    the first; a lone document follows itself). Ids are integers or null; equal ids go by text, null ids come
    last, by text. Null text counts as empty. Documents are dealt out by ranges, each with a copy of the row that
    follows it, so that texts are shuffled once and stream through tasks in order. Ranges are even in rows, however
    the ids lie: their edges are quantiles of drawn ids, and of drawn texts where an id has many rows; only rows equal
    in both stay together. The result does not depend on the draw. The driver sees at most 16,384 ranges, eight
    drawn ids for each and one id that begins it.
    """
    from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError("ids must be integers")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    names = [id_col, *[c.split()[0] for c in _RESULT.split(", ")]]
    if not n:
        return spark.createDataFrame([], f"id {kind.simpleString()}, {_RESULT}").toDF(*names)
    edges = _Edges(rows, n, bucket_rows)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return edges.ranges(ids, texts)

    if edges.start[-1] or edges.texts.get(None):
        found = rows.withColumn("range", range_of("id", edges.needs_text("text")))
        # Ranges in order, without empty ones, and the id that each begins with.
        firsts = sorted((r.range, r.first) for r in found.groupBy("range").agg(F.max("id").alias("first")).collect())
        number = dict((r, i) for i, (r, _) in enumerate(firsts))
        bucket = F.element_at(F.split(F.lit(",".join(str(number.get(i, 0)) for i in range(firsts[-1][0] + 1))), ",").cast("array<int>"), F.col("range") + 1)
        main = found.select(bucket.alias("bucket"), F.lit(False).alias("tail"), "id", "text")
        # The first row of each range also ends the range before it; of several with its id the first by text counts.
        heads, total = F.col("id").isin([i for _, i in firsts if i is not None]), len(firsts)
        head = main.where(heads | F.col("id").isNull() if any(i is None for _, i in firsts) else heads)
    else:
        main = rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("tail"), "id", "text")
        top, total = rows.agg(F.max("id")).first()[0], 1
        head = main.where(F.col("id").eqNullSafe(F.lit(top).cast("long")))
    ends = head.select(F.pmod(F.col("bucket") - 1, F.lit(total)).alias("bucket"), F.lit(True).alias("tail"), "id", "text")
    dealt = main.unionByName(ends).repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("id"), "text")
    out = dealt.mapInArrow(_compare(pa.int64()), f"id long, {_RESULT}")
    return out.withColumn("id", F.col("id").cast(kind)).toDF(*names)
