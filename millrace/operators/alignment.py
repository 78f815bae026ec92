"""Word alignment of a reference with recogniser output, and the error statistics it gives."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Longest spans that count as one edit of a phrase.
REF_SPAN, HYP_SPAN = 4, 6

#: Cells of tables that are filled together, words that are aligned at once, and distinct edits that a task counts before it hands them on.
_CELLS, _WORDS, _HELD = 1 << 21, 1 << 16, 50_000

def _next(row: np.ndarray, i: int, same: np.ndarray) -> np.ndarray:
    """The costs of row ``i`` from those of the row before; ``same`` says where the row's word equals a word of the other text."""
    out = np.empty_like(row)
    out[0] = i
    out[1:] = np.minimum(row[1:] + 1, row[:-1] + ~same)
    steps = np.arange(len(row), dtype=row.dtype)
    return np.minimum.accumulate(out - steps) + steps  # insertions run along the row


def edit_script(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """A least edit script as (op, ref index, hyp index), in order; of equal scripts one that matches as early as it can.

    The table of costs is kept at every ``k``-th row and found again block by block on the way back, so its memory grows
    with the longer text times the root of the other's length: some 25 MB for two texts of 20,000 words.
    """
    n, m = len(ref), len(hyp)
    code: dict[str, int] = {}
    r = np.array([code.setdefault(w, len(code)) for w in ref], np.int64)
    h = np.array([code.setdefault(w, len(code)) for w in hyp], np.int64)
    k = max(1, math.isqrt(n))
    row = np.arange(m + 1, dtype=np.int32)
    kept = [row]
    for i in range(1, n + 1):
        row = _next(row, i, h == r[i - 1])
        if i % k == 0:
            kept.append(row)
    first, block = n + 1, np.zeros((0, m + 1), np.int32)
    out, i, j = [], n, m
    while i or j:
        if i and i - 1 < first:  # rows from the kept one at or above the next, down to this one
            first = (i - 1) // k * k
            rows = [kept[first // k]]
            for x in range(first + 1, i + 1):
                rows.append(_next(rows[-1], x, h == r[x - 1]))
            block = np.stack(rows)
        cost = block[i - first] if i else None
        above = block[i - 1 - first] if i else None
        if i and j and r[i - 1] == h[j - 1] and cost[j] == above[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[j] == above[j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("replace", i, j))
        elif i and cost[j] == above[j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


_MATCH, _REPLACE, _DELETE, _INSERT = range(4)
_NAMES = {_REPLACE: "replace", _DELETE: "delete", _INSERT: "insert"}


def _moves(refs: list[np.ndarray], hyps: list[np.ndarray]) -> np.ndarray:
    """For each pair and cell (i, j), i from 1, the step that ``edit_script`` takes back from it. The pairs' tables grow row by row together."""
    n, m = max(map(len, refs)), max(map(len, hyps))
    r, h = np.full((len(refs), n), -1), np.full((len(hyps), m), -2)
    for k, (a, b) in enumerate(zip(refs, hyps)):
        r[k, : len(a)], h[k, : len(b)] = a, b
    kind = np.int16 if n + m < 1 << 14 else np.int32
    steps = np.arange(m + 1, dtype=kind)
    row, out = np.tile(steps, (len(refs), 1)), np.empty((len(refs), m + 1), kind)
    moves = np.full((len(refs), n, m + 1), _DELETE, np.uint8)
    for i in range(1, n + 1):
        same = h == r[:, i - 1 : i]
        below, across = row[:, 1:] + kind(1), row[:, :-1] + kind(1)
        out[:, 0] = i
        np.minimum(below, across - same, out=out[:, 1:])
        out -= steps
        np.minimum.accumulate(out, axis=1, out=out)
        out += steps
        at = out[:, 1:]
        moves[:, i - 1, 1:] = np.where(same, _MATCH, np.where(at == across, _REPLACE, np.where(at == below, _DELETE, _INSERT)))
        row, out = out, row
    return moves


def edit_scripts(refs: list[np.ndarray], hyps: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """(place, ``edit_script``) of every pair of coded texts, in any order: tables of pairs of like sizes are filled together, large ones alone."""
    order = sorted(range(len(refs)), key=lambda k: (len(refs[k]), len(hyps[k])))
    while order:
        some, n, m = [], 0, 0
        while order:
            a, b = max(n, len(refs[order[-1]])), max(m, len(hyps[order[-1]]))
            if some and (len(some) + 1) * (a + 1) * (b + 1) > _CELLS:
                break
            some.append(order.pop())
            n, m = a, b
        if len(some) == 1 and (n + 1) * (m + 1) > _CELLS:
            yield some[0], edit_script(refs[some[0]].tolist(), hyps[some[0]].tolist())
            continue
        moves = _moves([refs[k] for k in some], [hyps[k] for k in some])
        for table, k in zip(moves, some):
            steps, out, i, j = table.tobytes(), [], len(refs[k]), len(hyps[k])
            while i or j:
                step = steps[(i - 1) * (m + 1) + j] if i else _INSERT
                i -= step != _INSERT
                j -= step != _DELETE
                if step:
                    out.append((_NAMES[step], i, j))
            yield k, out[::-1]


def _coded(ref: pa.Array, hyp: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """Both sides' words of each row as numbers, and what these stand for; null texts are empty."""
    lengths = [np.asarray(x.value_lengths().fill_null(0)) for x in (ref, hyp)]
    words = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode")
    codes = words.indices.to_numpy()
    ends = np.cumsum(np.concatenate(lengths))
    each = np.split(codes, ends[:-1]) if len(ends) else []
    return each[: len(ref)], each[len(ref) :], words.dictionary.to_pylist()


def _pieces(ref: pa.Array, hyp: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some ``_WORDS`` words each."""
    upto = np.cumsum(sum(np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in (ref, hyp)))
    first = 0
    while first < len(upto):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _WORDS, "right")))
        yield first, last
        first = last


def spans(script: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of touching edits as (ref from, ref to, hyp from, hyp to): an edit joins the run that ends where it starts."""
    starts = [(i, j) for _, i, j in script]
    ends = [(i + (op != "insert"), j + (op != "delete")) for op, i, j in script]
    heads = [k for k in range(len(script)) if not k or ends[k - 1] != starts[k]]
    return [(starts[a][0], ends[b - 1][0], starts[a][1], ends[b - 1][1]) for a, b in zip(heads, [*heads[1:], len(script)])]


def _events(ref: list[str], hyp: list[str], script: list[tuple[str, int, int]]) -> list[tuple[str, str | None, str | None]]:
    """The edits at word and at span level as (op, ref, hyp)."""
    out = [(op, ref[i] if op != "insert" else None, hyp[j] if op != "delete" else None) for op, i, j in script]
    for a, b, c, d in spans(script):
        if b - a <= REF_SPAN and d - c <= HYP_SPAN:
            out.append(("span" if b > a else "phrase", " ".join(ref[a:b]) or None, " ".join(hyp[c:d]) or None))
        out += [("involved", w, None) for w in ref[a:b]]
    return out


@F.arrow_udf(StructType([StructField(x, LongType()) for x in ("replace", "delete", "insert")]))
def edit_sizes(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """How many words of a file pair are replaced, deleted and inserted."""
    out = np.zeros((3, len(ref)), np.int64)
    for a, b in _pieces(ref, hyp):
        refs, hyps, _ = _coded(ref[a:b], hyp[a:b])
        for k, script in edit_scripts(refs, hyps):
            n = Counter(op for op, _, _ in script)
            out[:, a + k] = n["replace"], n["delete"], n["insert"]
    return pa.StructArray.from_arrays([pa.array(x) for x in out], ["replace", "delete", "insert"])


def _counted(batches: Iterator[pa.RecordBatch], each: bool = False) -> Iterator[pa.RecordBatch]:
    """Edits of (keys, ref, hyp) rows as (keys, op, ref, hyp, n), counted as far as a task holds them.

    With ``each`` these rows count over all keys, which are null in them, and every file has a row of its own too: its keys,
    no op, and how many words it has changed.
    """
    for batch in batches:
        n_keys = batch.num_columns - 2
        keys, ref, hyp = batch.columns[:n_keys], batch.column(n_keys), batch.column(n_keys + 1)
        first: dict[str, int] = {}
        of = [first.setdefault(k, i) for i, k in enumerate(map(repr, zip(*[k.to_pylist() for k in keys])))] if keys and not each else [0] * len(ref)
        names = [*batch.schema.names[:n_keys], "op", "ref", "hyp", "n"]
        changed = np.zeros(len(ref), np.int64)
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            rows = pa.array([at for at, _ in held], pa.int64())
            words = [pa.array([e[i] for _, e in held], pa.string()) for i in range(3)]
            n = pa.array(list(held.values()), pa.int64())
            return pa.record_batch([*[pa.nulls(len(held), k.type) if each else k.take(rows) for k in keys], *words, n], names)

        for a, b in _pieces(ref, hyp):
            refs, hyps, words = _coded(ref[a:b], hyp[a:b])
            for k, script in edit_scripts(refs, hyps):
                changed[a + k] = len(script)
                if script:
                    at = of[a + k]
                    held.update([(at, e) for e in _events([words[x] for x in refs[k].tolist()], [words[x] for x in hyps[k].tolist()], script)])
                if len(held) > _HELD:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()
        if each:
            yield pa.record_batch([*keys, *[pa.nulls(len(ref), pa.string())] * 3, pa.array(changed)], names)


def counts_and_files(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(keys, op, ref, hyp, n) from one alignment: counts over all files, to be added up, with null keys; and each file's changes, with a null op."""
    rows = pairs.select(*keys, F.col(ref).alias("ref"), F.col(hyp).alias("hyp"))
    made = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields[: len(keys)]], *[StructField(x, StringType()) for x in ("op", "ref", "hyp")], StructField("n", LongType())])
    return rows.mapInArrow(lambda batches: _counted(batches, True), made)


def alignment_counts(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(keys, op, ref, hyp, n): counts of edits over all files, which add up over any split of the files."""
    rows = pairs.select(*keys, F.col(ref).alias("ref"), F.col(hyp).alias("hyp"))
    edits = ["op", "ref", "hyp"]
    made = StructType([*rows.schema.fields[: len(keys)], *[StructField(x, StringType()) for x in edits], StructField("n", LongType())])
    return rows.mapInArrow(_counted, made).groupBy(*keys, *edits).agg(F.sum("n").alias("n"))


def error_rates(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(keys, n_files, n_ref, n_hyp, wer, sub_rate, del_rate, ins_rate), rates to four places; no reference words give 0."""
    rows = pairs.select(*keys, F.size(ref).alias("r"), F.size(hyp).alias("h"), edit_sizes(F.col(ref), F.col(hyp)).alias("e"))
    count = lambda op: F.sum(f"e.{op}")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("r").alias("n_ref"), F.sum("h").alias("n_hyp"), count("replace").alias("s"), count("delete").alias("d"), count("insert").alias("i"))
    rate = lambda c: F.when(F.col("n_ref") > 0, F.bround(c / F.col("n_ref"), 4)).otherwise(0.0)
    return sums.select(*keys, "n_files", "n_ref", "n_hyp", rate(F.col("s") + F.col("d") + F.col("i")).alias("wer"), rate(F.col("s")).alias("sub_rate"), rate(F.col("d")).alias("del_rate"), rate(F.col("i")).alias("ins_rate"))


def pooled_counts(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(keys, pooled, op, ref, hyp, n): ``alignment_counts`` of every key and of all keys together, each pair aligned once.

    Rows of all together have ``pooled`` true and null keys; a null key of its own has it false. Edits are counted by key
    first, so what is counted twice is distinct edits and not events. An empty table gives no rows.
    """
    counts = alignment_counts(pairs, keys, ref, hyp)
    edit = ["op", "ref", "hyp"]
    sets = counts.groupingSets([[*keys, *edit], edit], *keys, *edit)
    return sets.agg(F.sum("n").alias("n"), F.grouping_id().alias("level")).select(*keys, (F.col("level") > 0).alias("pooled"), *edit, "n")
