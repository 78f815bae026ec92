"""Sides of a split and the assertions that keep it free of leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


def assign_sides(records: DataFrame, split: DataFrame, key: str, held_out: Column) -> DataFrame:
    """Records with side and cell: benchmark, val or train by the split; a held-out question trains nothing.

    On the benchmark a held-out question is cell unseen_q, any other seen_q. Held-out questions elsewhere are dropped;
    a record whose key the split lacks, or without a key, ends the job. Keys of the split must be unique.
    """
    named = records.join(split.select(key, F.col("side").alias("_side")), key, "left")
    known = F.when(F.col("_side").isNull(), F.raise_error(F.concat(F.lit("the split lacks "), F.col(key).cast("string")))).otherwise(F.col("_side"))
    side = F.when((known != "benchmark") & held_out, "drop").otherwise(known)
    return named.withColumn("side", side).withColumn("cell", F.when(F.col("side") == "benchmark", F.when(held_out, "unseen_q").otherwise("seen_q"))).drop("_side")


def hash_sample(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows whose seeded hash is under the fraction: the same rows in any order, and more of them at a larger fraction.

    Equal keys share their fate, and so do all rows without a key.
    """
    return rows.where(X.hash_share(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))) < fraction)


def complete(answers: DataFrame, key: str, item: str, expected: DataFrame) -> DataFrame:
    """(key): keys that have every expected item. Null items count on neither side; repeats count once."""
    need = expected.select(item).distinct()
    n = need.agg(F.count("*").alias("n"))
    have = answers.select(key, item).distinct().join(need, item, "left_semi").groupBy(key).agg(F.count("*").alias("have"))
    return have.join(F.broadcast(n)).where("have = n").select(key)  # one row


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): ids that should be unique and are not."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error that names an id with more than one."""
    bad = repeated_ids(rows, key).select(F.col(key).alias("_bad"))
    checked = rows.join(bad, F.col(key) == F.col("_bad"), "left")
    return checked.withColumn(key, F.when(F.col("_bad").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col("_bad").cast("string"))).cast(rows.schema[key].dataType))).drop("_bad")


def cut_points(rows: DataFrame, name: str, n: Column, seed: int, *parts: str) -> DataFrame:
    """Rows with a seeded cut in 1 .. n - 1 (at least 1; so 1 for a length of null, zero or one)."""
    share = X.hash_share(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    return rows.withColumn(name, F.greatest(F.lit(1), F.least(n - 1, F.floor(share * n))).cast("int"))


def token_windows(tokens: Column, size: int) -> Column:
    """Consecutive windows of ``size``; the tail is one only if it is longer than half of that."""
    last = F.size(tokens) - size // 2
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens), F.lit(1)), F.lit(size)), lambda i: i < last)
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))
