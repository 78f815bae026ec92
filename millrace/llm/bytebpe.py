"""Byte-level BPE inside DuckDB: a recursive query contracts pairs, an ordered aggregation decodes.

Spark deals out the documents. In each task the distinct words of a batch become token-position rows;
a recursive query joins adjacent tokens to the merge table and contracts each word's leftmost pair of
least rank, until no pair is left. Words are cut by the pattern first and never merge across their ends,
so a document's ids are those of its words in order. A long word goes through the same query in pieces, and the
seams between them again until they hold (``Codec._joined``). What a worker has encoded it remembers up to
a fixed number of words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import let_go

#: White space as \s in the pattern means it (Unicode White_Space). Fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
#: A word's matches never depend on what stands outside white space plus the run after it.
_RUN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

_SPACES = frozenset(c for a, b in ((9, 13), (0x2000, 0x200A)) for c in map(chr, range(a, b + 1))) | frozenset(" \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000")

_WORDS, _ROWS = 20_000, 3_000_000  # words of one recursive query, and rows that all its rounds may keep
_PIECE, _SEAM = 64, 32  # bytes of a long word's pieces, and bytes at either side of a seam that are contracted anew
_DEPTH = 64  # rounds of one recursive query; what is not done goes into the next
_REMEMBER = 300_000  # runs that a worker keeps
_DECODE = 200_000  # tokens of one decoding query

# A row's key is word << 32 | position. k orders a word's pairs by rank, then position.
_LEFTMOST = f"""
WITH RECURSIVE s AS (
  SELECT g, tok, 0 AS round FROM init
  UNION ALL
  SELECT p.g, CASE WHEN p.g = b.spot THEN b.made ELSE p.tok END, p.round + 1
  FROM s p JOIN (
    SELECT w, (w << 32) | (k & 4294967295) AS spot, (k >> 32)::INTEGER AS made, gone FROM (
      SELECT a.g >> 32 AS w, min((m.made::BIGINT << 32) | (a.g & 4294967295)) AS k,
             arg_min(a.next_g, (m.made::BIGINT << 32) | (a.g & 4294967295)) AS gone
      FROM (SELECT g, tok, lead(tok) OVER (ORDER BY g) AS next_tok, lead(g) OVER (ORDER BY g) AS next_g FROM s) a
      JOIN merges m ON m.l = a.tok AND m.r = a.next_tok AND a.next_g >> 32 = a.g >> 32
      GROUP BY a.g >> 32)
  ) b ON p.g >> 32 = b.w
  WHERE p.g <> b.gone AND p.round < {_DEPTH}
)
SELECT s.g, s.tok, s.round FROM s JOIN (SELECT g >> 32 AS w, max(round) AS top FROM s GROUP BY g >> 32) t
ON s.g >> 32 = t.w AND s.round = t.top ORDER BY s.g
"""

_JOIN = "SELECT doc, string_agg(piece, '' ORDER BY spot) AS body FROM ids JOIN pieces USING (tok) GROUP BY doc ORDER BY doc"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class _Numbers(dict):
    """Numbers keys as they come; ``new`` lists the keys numbered since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Codec:
    """Encoder and decoder of one vocabulary; holds a DuckDB connection with the merge table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.byte = np.full(256, -1, np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), made=pa.array(made, pa.int32()))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # One character for each byte, as DuckDB's strings must be valid UTF-8.
        self._table("pieces", tok=pa.array(list(ranks.values()), pa.int32()), piece=pa.array([t.decode("latin-1") for t in ranks]))
        self.forget()

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def forget(self) -> None:
        self.runs = _Numbers()
        self.starts, self.sizes, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _contract(self, words: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (number of the word << 32 | position) and tokens that are left of the words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        g = np.repeat(numbers << 32, sizes) + np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys, tokens = [g[:0]], [tok[:0]]
        while len(g):
            self.db.register("init", pa.table({"g": pa.array(g, pa.int64()), "tok": pa.array(tok, pa.int32())}))
            out = self.db.sql(_LEFTMOST).to_arrow_table()
            self.db.unregister("init")
            g, tok, rounds = (out[c].to_numpy() for c in ("g", "tok", "round"))
            done = rounds < _DEPTH
            keys.append(g[done])
            tokens.append(tok[done])
            g, tok = g[~done], tok[~done]
        return np.concatenate(keys), np.concatenate(tokens)

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words in a row.

        Words of a length go together: a query has as many rounds as its longest word contractions, and keeps a
        row for each byte that is left in each round.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        by_size = np.argsort(sizes, kind="stable")
        rows = np.cumsum(sizes[by_size] * np.minimum(sizes[by_size], 2 * _DEPTH) // 2)
        parts, at = [(np.zeros(0, np.int64), np.zeros(0, np.int32))], int(np.searchsorted(sizes[by_size], 1))
        while at < len(words):
            to = min(at + _WORDS, max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + _ROWS))))
            numbers = np.sort(by_size[at:to])
            parts.append(self._contract([words[i] for i in numbers.tolist()], numbers))
            at = to
        g, tok = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(g, kind="stable")
        return np.bincount(g >> 32, minlength=len(words)), tok[order]

    def _joined(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of long words: their pieces are contracted alone, then what stands around each seam that does not hold.

        A seam holds if its two tokens, joined, contract to themselves. If all of a word's do, no contraction of
        the whole word crosses one: up to the first that did, either side would have gone through the same
        contractions as alone, and so would the two tokens.
        """
        known: dict[bytes, list[int]] = {}

        def solve(parts: list[bytes]) -> None:
            new = [p for p in dict.fromkeys(parts) if p not in known]
            sizes, flat = self._contracted(new)
            known.update(zip(new, [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if new else []))

        cut = [[w[i : i + _PIECE] for i in range(0, len(w), _PIECE)] for w in words]
        solve([p for pieces in cut for p in pieces])
        rows: list[list[int]] = []  # tokens of each word
        doubtful: list[list[int]] = []  # and the tokens whose left seam has not been looked at
        for pieces in cut:
            got = [known[p] for p in pieces]
            rows.append([t for ids in got for t in ids])
            doubtful.append(np.cumsum([len(ids) for ids in got])[:-1].tolist())
        times = 0
        while any(doubtful):
            pair = lambda row, i: self.bytes_of[row[i - 1]] + self.bytes_of[row[i]]
            solve([pair(row, i) for row, spots in zip(rows, doubtful) for i in spots])
            reach = _SEAM * (1 + times // 8)  # grows, so that the rounds come to an end
            windows: list[list[tuple[int, int, bytes]]] = []
            for row, spots in zip(rows, doubtful):
                open_, end = [], 0
                for i in spots:
                    if i <= end or known[pair(row, i)] == row[i - 1 : i + 1]:
                        continue  # in a window of this round, or it holds
                    a = b = i
                    size = 0
                    while a > end and size < reach:
                        a -= 1
                        size += len(self.bytes_of[row[a]])
                    size = 0
                    while b < len(row) and size < reach:
                        size += len(self.bytes_of[row[b]])
                        b += 1
                    open_.append((a, b, b"".join([self.bytes_of[t] for t in row[a:b]])))
                    end = b
                windows.append(open_)
            solve([w[2] for open_ in windows for w in open_])
            for n, open_ in enumerate(windows):
                row, made, spots, at = rows[n], [], [], 0
                for a, b, text in open_:
                    made += row[at:a]
                    spots.append(len(made))
                    made += known[text]
                    spots.append(len(made))
                    at = b
                rows[n] = made + row[at:]
                doubtful[n] = sorted({i for i in spots if 0 < i < len(rows[n])})
            times += 1
        return [np.array(row, np.int32) for row in rows]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words in a row."""
        long = [i for i, w in enumerate(words) if len(w) > _PIECE]
        sizes, flat = self._contracted([w if len(w) <= _PIECE else b"" for w in words])
        if not long:
            return sizes, flat
        each = np.split(flat, np.cumsum(sizes)[:-1])
        for i, ids in zip(long, self._joined([words[i] for i in long])):
            each[i] = ids
        return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)

    def _learn(self, runs: list[str]) -> None:
        """Encode runs that are new, each as the words that the pattern finds in it."""
        # Runs from white space to other characters can be searched in a row; the rest would join their neighbours.
        alone = [i for i, r in enumerate(runs) if r[0] not in _SPACES or r[-1] in _SPACES]
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        found: list[str] = []
        at = 0
        for i in [*alone, len(runs)]:
            found += self.find("".join(runs[at:i]))
            if i < len(runs):
                found += self.find(runs[i])
            at = i + 1
        words = _Numbers()
        order = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        each, flat = self._words([w.encode() for w in words])
        begin, got = np.cumsum(each) - each, each[order]
        total = np.cumsum(got)
        fresh = flat[np.repeat(begin[order] - (total - got), got) + np.arange(got.sum())]
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends)
        upto = total[last]  # ids up to the end of each run
        sizes = np.diff(upto, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.tokens) + upto - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.tokens = np.concatenate([self.tokens, fresh])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every whole text."""
        if len(self.runs) > _REMEMBER:
            self.forget()
        number, places = self.runs.__getitem__, []
        for text in texts:
            runs = _RUN.findall(text)
            places.append(np.fromiter(map(number, runs), np.int64, len(runs)))
        if self.runs.new:
            self._learn(self.runs.new)
            self.runs.new = []
        out = []
        for place in places:
            sizes = self.sizes[place]
            total = np.cumsum(sizes)
            out.append(self.tokens[np.repeat(self.starts[place] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)])
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of every list of ids."""
        out = [b""] * len(ids)
        at = 0
        while at < len(ids):
            to, size = at, 0
            while to < len(ids) and (to == at or size + len(ids[to]) <= _DECODE):
                size += len(ids[to])
                to += 1
            doc = np.repeat(np.arange(at, to), [len(x) for x in ids[at:to]])
            self.db.register("ids", pa.table({"doc": doc, "spot": np.arange(len(doc)), "tok": np.concatenate(ids[at:to])}))
            made = self.db.sql(_JOIN).to_arrow_table()
            self.db.unregister("ids")
            for i, body in zip(made["doc"].to_pylist(), made["body"].to_pylist()):
                out[i] = body.encode("latin-1")
            at = to
        return out


_CODECS: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """This worker's codec for a vocabulary."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(data), pattern)
    return _CODECS[key]


_TEXTS = 512  # texts encoded together at most, and their bytes
_TEXT_BYTES = 4_000_000


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= _TEXTS or total + size > _TEXT_BYTES):
            yield at, i
            at, total = i, 0
        total += size
    if len(sizes):
        yield at, len(sizes)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens`` and ``ids`` (array of int) of its whole text, after its own columns.

    Null text counts as empty and has no ids. Special tokens are unknown: their strings are ordinary text.
    With ``digests`` the ids are also decoded, and ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` (of the decoded bytes) follow; the text's own column then goes. Columns
    of ``docs`` with these names are kept under the name with ``_in`` at the end. The vocabulary file is
    broadcast; its size is fixed (under 1 MB here).
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    kinds = "n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    made = [c.split()[0] for c in kinds.split(", ")]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    given = plain.withColumn("body", F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit("")))
    if digests:  # the text itself is not sent back
        given = given.drop(f"c{docs.columns.index(text_col)}")
    own = given.columns[:-1]
    schema = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in own) + ", " * bool(own) + kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, pattern)
        for batch in batches:
            for a, b in _slices(batch.column(len(own))):
                part = batch.slice(a, b - a)
                found = tool.encode(part.column(len(own)).to_pylist())
                sizes = [len(x) for x in found]
                new = [pa.array(sizes, pa.int64())]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    new.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int32())))
                if digests:
                    new.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]))
                    new.append(pa.array([hashlib.sha256(x).hexdigest() for x in tool.decode(found)]))
                yield pa.record_batch(part.columns[:-1] + new, own + made)
        del tool
        _CODECS.clear()  # the worker may serve other queries next
        let_go()

    out = given.mapInArrow(run, schema)
    names = [docs.columns[int(c[1:])] for c in own]
    taken = {c.lower() for c in made}
    return out.toDF(*[f"{c}_in" if c.lower() in taken else c for c in names], *made)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Every row with ``decoded`` (binary), the bytes of its ids; null ids decode to no bytes.

    The bytes are those of the encoded text, so a cast to string restores it. An id outside the
    vocabulary ends the job with an error. A column named ``decoded`` is kept as ``decoded_in``.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))
    plain = encoded.toDF(*[f"c{i}" for i in range(len(encoded.columns))])
    given = plain.withColumn("body", F.coalesce(F.col(f"c{encoded.columns.index(ids_col)}").cast("array<int>"), F.array().cast("array<int>")))
    own = given.columns[:-1]
    schema = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in own) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, pattern)
        top = max(read_ranks(shared.value).values())
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                ids = [np.array(x, np.int64) for x in part.column(len(own)).to_pylist()]
                if any(len(x) and (x.min() < 0 or x.max() > top) for x in ids):
                    raise ValueError("an id is not in the vocabulary")
                yield pa.record_batch(part.columns[:-1] + [pa.array(tool.decode(ids), pa.binary())], own + ["decoded"])

    return given.mapInArrow(run, schema).toDF(*[f"{c}_in" if c.lower() == "decoded" else c for c in encoded.columns], "decoded")
