"""Readers and writers at the edges: line-JSON with a cut end, archives, tables, ledgers and exports."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import text as X


def _ends_with(spark: SparkSession, path: str, line: str) -> bool:
    """Whether a file's last bytes are this line without a line end. Only those bytes are read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    want = line.encode()
    size = fs.getFileStatus(p).getLen()
    if size < len(want):
        return False
    stream = fs.open(p)
    try:
        stream.seek(size - len(want))
        return bytes(stream.readNBytes(len(want))) == want
    finally:
        stream.close()


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of line-JSON files under a fixed schema; a cut last line of a file is left out, any other bad line ends the job.

    A first pass finds the bad lines, of which a file that a writer left unfinished may have one. They pass the driver one
    at a time, which holds each against the last bytes of its file.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = kind.fieldNames()
    reader = spark.read.schema(StructType([*kind.fields, StructField("_bad", StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.json(path)
    bad = rows.withColumn("_file", F.input_file_name()).where("_bad IS NOT NULL").groupBy("_file").agg(F.count("*").alias("n"), F.min("_bad").alias("line"), F.count(columns[0]).alias("other"))  # Spark wants another column read
    for r in bad.toLocalIterator():
        if r["n"] > 1 or not _ends_with(spark, r["_file"], r["line"]):
            raise ValueError(f"a bad line in {r['_file']}: {r['line'][:80]}")
    return rows.where("_bad IS NULL").select(*columns)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of files that each hold one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, body): the JSON members of zip archives, one archive in memory at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if member.endswith(".json"):
                            yield pd.DataFrame({"archive": [name], "member": [member], "body": [z.read(member).decode()]})

    return files.mapInPandas(run, "archive string, member string, body string")


def read_wide_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV whose quoted fields hold line ends and run to any length."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_split(docs: DataFrame, key: str, path: str, fraction: float = 0.02) -> DataFrame:
    """Write documents under split=train and split=val by the hash of their key; the counts of each side."""
    named = docs.withColumn("split", F.when(X.is_validation(key, fraction), "val").otherwise("train"))
    named.write.mode("overwrite").partitionBy("split").parquet(path)
    return docs.sparkSession.read.parquet(path).groupBy("split").agg(F.count("*").alias("docs"), F.sum(X.word_count("text")).alias("words"))


def read_by_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The given columns of the rows whose key ``ids`` has; the scan reads those columns alone, null keys match nothing."""
    return spark.read.parquet(path).select(*columns).join(ids.select(key).distinct(), key, "left_semi")


def side_summary(records: DataFrame, side: str, doc: str, lines: str, answer: str) -> DataFrame:
    """(side, what, name, n): records, documents, lines per document (nearest ranks) and answers of each side.

    A document counts once a side, with the lines of its first record by number; null answers are named "".
    """
    from millrace.operators.ranks import nearest_ranks

    docs = records.groupBy(side, doc).agg(F.min(lines).alias("lines"))
    row = lambda what, name, n: (F.lit(what).alias("what"), name.alias("name"), n.cast("long").alias("n"))
    sums = records.groupBy(side).agg(F.count("*").alias("c")).select(side, *row("records", F.lit(""), F.col("c")))
    whole = docs.groupBy(side).agg(F.count("*").alias("c")).select(side, *row("docs", F.lit(""), F.col("c")))
    names = ["min", "p50", "p90", "p99", "max"]
    ranks = nearest_ranks(docs, [side], "lines").select(side, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("long") for c in names]))).alias("name", "v"))
    said = records.groupBy(side, F.coalesce(F.col(answer), F.lit("")).alias("name")).agg(F.count("*").alias("c"))
    return sums.unionByName(whole).unionByName(ranks.select(side, *row("lines", F.col("name"), F.col("v")))).unionByName(said.select(side, *row("answer", F.col("name"), F.col("c"))))


def write_sides(records: DataFrame, path: str, side: str, doc: str, lines: str, answer: str) -> DataFrame:
    """Write records under a folder for each side; ``side_summary`` of what was written."""
    records.write.mode("overwrite").partitionBy(side).parquet(path)
    return side_summary(records.sparkSession.read.parquet(path), side, doc, lines, answer)


def append_new(ledger: str, rows: DataFrame, key: str) -> int:
    """Append the rows whose key the ledger lacks, one for each key; how many. Spark's commit leaves no torn rows.

    Of several rows with a key the first by its text as JSON is taken, so reruns agree. Rows without a key have no
    identity and are not taken.
    """
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    first = F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns)))
    fresh = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ledger_key")).agg(first.alias("ledger_row")).select("ledger_row.*")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(ledger).select(key), key, "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(ledger)
    fresh.unpersist()
    return n


def replace_table(df: DataFrame, path: str) -> None:
    """Put a table in another's place: it is written aside, then renamed, so readers never see a part of it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new, gone = hadoop.Path(path), hadoop.Path(path + ".new"), hadoop.Path(path + ".old")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(gone, True)
    if fs.exists(old):
        fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)


def publish_table(df: DataFrame, path: str) -> int:
    """Write a table as the next version under ``path``; readers see it once its marker is there, and the old one before.

    Spark writes the marker last, so a crash leaves the old version in place. Two writers at once need a lock.
    """
    version = max(_versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version:08d}")
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version of a published table; an error if there is none."""
    done = _versions(spark, path)
    if not done:
        raise ValueError(f"no table is published under {path}")
    return spark.read.parquet(f"{path}/v{max(done):08d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(x.getName()[1:]) for x in found if fs.exists(hadoop.Path(x, "_SUCCESS"))]


def template_digest(templates: dict[str, str]) -> str:
    """A digest of named templates; neither their order nor how they are stored changes it."""
    h = hashlib.sha1()
    for name, body in sorted(templates.items()):
        for part in (name, body):
            data = part.encode()
            h.update(len(data).to_bytes(8, "big") + data)
    return h.hexdigest()


def vocabulary_digest(vocabulary: DataFrame, token: str, id_: str) -> str:
    """A digest of a tokenizer's (token, id) table, whatever its order and partitions."""
    return content_digest(vocabulary.select(F.col(token).alias("token"), F.col(id_).cast("long").alias("id")), ["token"])


def content_digest(df: DataFrame, keys: list[str]) -> str:
    """A digest of a table's rows that order and partitions do not change: sums of row hashes, so nothing is collected."""
    row = F.sha1(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).cast("binary"))
    parts = df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)").alias("b"))
    n, a, b = parts.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return hashlib.sha1(json.dumps([sorted(keys), n, str(a), str(b)]).encode()).hexdigest()


def export_release(records: DataFrame, side: str, track: str, private: list[str]) -> DataFrame:
    """Records of a track with their side, and ``generation_info`` without the private fields."""
    return records.where(F.col("track") == track).withColumn("generation_info", F.col("generation_info").dropFields(*private)).withColumn("split", F.lit(side))


def pack_tokens(docs: DataFrame, ids: str, end: int, block: int, order: list[str]) -> DataFrame:
    """(part, n_tokens, tokens): documents' ids with an end mark, packed in rows of about ``block`` tokens as little-endian uint32.

    Whole documents stay in one row; a document longer than a block is a row of its own. Rows are packed within
    ranges of the order, so no task sees more than its range.
    """
    ranged = docs.select(*order, ids).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            data = np.concatenate(held).astype("<u4")
            return pd.DataFrame({"n_tokens": [len(data)], "tokens": [data.tobytes()]})

        for batch in batches:
            for x in batch[ids]:
                one = np.append(np.asarray(x, np.int64), end)
                if held and size + len(one) > block:
                    yield flush()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield flush()

    return ranged.mapInPandas(run, "n_tokens long, tokens binary")
