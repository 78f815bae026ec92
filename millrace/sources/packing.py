"""Packed token streams: every document's place in the stream is known, so blocks are exact and depend on no partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _copies(docs: DataFrame, item: str, ids: str, source: str, repeat: str | None) -> DataFrame:
    """One row for each copy; a null array is empty, a null or negative repeat is no copy."""
    n = F.coalesce(F.col(repeat), F.lit(0)).cast("int") if repeat else F.lit(1)
    tokens = F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<long>")
    return docs.select(F.col(item).alias("item"), F.col(source).alias("source"), tokens.alias("ids"), F.when(n > 0, n).otherwise(0).alias("n_copies")).withColumn("copy", F.explode(F.when(F.col("n_copies") > 0, F.sequence(F.lit(1), F.col("n_copies"))).otherwise(F.array().cast("array<int>"))))


def little_endian(ids: Column) -> Column:
    """Ids as unsigned 32-bit integers, least byte first."""
    word = F.transform(ids, lambda t: F.lpad(F.hex(t), 8, "0"))
    return F.unhex(F.array_join(F.transform(word, lambda h: F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)])), ""))


def token_blocks(docs: DataFrame, item: str, ids: str, source: str, end: int, block: int, seed: int, repeat: str | None = None) -> DataFrame:
    """(block, n_tokens, tokens): the stream of all documents in a seeded order, each with an end mark, cut every ``block`` tokens.

    ``tokens`` are little-endian unsigned 32-bit integers, so blocks put end to end are the stream's file; only the last is
    short. Two passes: sums of tokens of 65,536 ranges of the hash give each range its start (one small window), running
    sums inside a range give each document its offset. A document is then cut at the blocks' edges, and a block gathers
    at most ``block`` pieces. Rows depend on neither partitions nor order; of documents with one item and hash the lesser array
    goes first. Documents without ids, or with null ones, are an end mark; ``repeat`` names how often one is taken.
    """
    mark = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("item").cast("string"), F.col("copy").cast("string")).cast("binary"))
    stream = _copies(docs, item, ids, source, repeat).select("item", F.array_append("ids", F.lit(end).cast("long")).alias("ids"), mark.alias("mark"), F.substring(mark, 1, 4).alias("part"))
    stream = stream.withColumn("n", F.size("ids").cast("long"))
    sizes = stream.groupBy("part").agg(F.sum("n").alias("own"))
    starts = sizes.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("mark", "item", "ids").rowsBetween(Window.unboundedPreceding, 0))
    placed = stream.withColumn("inside", inside).join(F.broadcast(starts), "part").select("ids", "n", (F.col("start") + F.col("inside") - F.col("n")).alias("at"))  # at most 65,536 ranges
    of = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block))
    cut = placed.withColumn("block", F.explode(of)).withColumn("low", F.greatest(F.col("at"), F.col("block") * block)).withColumn("high", F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * block))
    pieces = cut.select("block", F.struct("low", F.slice("ids", (F.col("low") - F.col("at") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("ids")).alias("piece"))
    whole = pieces.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
    return whole.select("block", F.size("ids").alias("n_tokens"), little_endian(F.col("ids")).alias("tokens"))


def stream_totals(docs: DataFrame, item: str, ids: str, source: str, repeat: str | None = None) -> DataFrame:
    """(source, documents, copies, tokens) of a packed stream, end marks counted; sources of which no copy is taken are left out."""
    rows = _copies(docs, item, ids, source, repeat)
    return rows.groupBy("source").agg(F.count_if(F.col("copy") == 1).alias("documents"), F.count("*").alias("copies"), F.sum(F.size("ids") + F.lit(1).cast("long")).alias("tokens")).withColumnRenamed("source", source)
