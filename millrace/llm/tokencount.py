"""Token counts through a digest cache: only contents that no earlier run has counted are encoded.

The cache is an append-only table of (digest, n_tokens) in one folder for each tokenizer version. A
version is the digest of the model file and the library's version, so a new model never meets old counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import file_system, scratch_path, stored

_TEXTS = 128
_CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(model: bytes) -> str:
    """Digest of the model file with the library's version."""
    return hashlib.sha256(model + b"\0sentencepiece " + sentencepiece.__version__.encode()).hexdigest()[:32]


def content_digest(text: Column | str) -> Column:
    """SHA-256 of the normalised content: null is empty, and U+2581 is a space.

    The tokenizer's own (identity) normaliser writes every space as U+2581, so texts that are equal here
    have equal tokens; nothing else is folded, for case and white space do change the count.
    """
    plain = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.unhex(F.sha2(F.replace(plain, F.lit("▁"), F.lit(" ")), 256))


_LOADED: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _counter(model: Broadcast, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _LOADED:
            _LOADED[version] = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        encode = _LOADED[version].encode
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, _TEXTS):
                counts += map(len, encode(batch.column(1).slice(at, _TEXTS).to_pylist(), num_threads=1))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def _cached(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], _CACHE_SCHEMA)
    return spark.read.schema(_CACHE_SCHEMA).parquet(path)


def count_tokens(
    docs: DataFrame, model_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``cache`` is a folder in shared storage; counts of this tokenizer version are appended to it and
    survive the job. Concurrent jobs may append the same digest twice: the counts are equal and either
    is taken. Null text counts as empty (no tokens). Repeated ids and rows are all kept, and copies of
    a content are encoded once whatever their number. An empty table gives an empty result. Other columns
    are not read. The model file (under 1 MB here) is broadcast.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    version = tokenizer_version(model)
    path = f"{cache.rstrip('/')}/version={version}"
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", content_digest("text"))
    keyed = stored(texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # One row stands for each missing content. It is found by (digest, id), which spreads the copies of a hot content.
    wanted = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(_cached(docs, path), "digest", "left_anti")
    same = (F.col("t.digest") == F.col("w.digest")) & F.col("t.id").eqNullSafe(F.col("w.id"))
    misses = texts.alias("t").join(wanted.alias("w"), same, "left_semi").select("digest", "text")
    counted = misses.mapInArrow(_counter(spark.sparkContext.broadcast(model), version), _CACHE_SCHEMA)
    counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(path)
    # Stored, so that both sides of the join are plain exchanges and Spark can split the rows of a hot content.
    known = stored(_cached(docs, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(known, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(docs: DataFrame) -> str:
    """A new, empty cache folder in the shared folder."""
    return scratch_path(docs.sparkSession, "token-cache")
