"""Grouping of documents that must not be parted: equal keys, near durations, shared passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components, written

#: Seconds between equal titles, share of passages that links, documents that make a passage boilerplate.
NEAR_SECONDS, OVERLAP, BOILERPLATE = 2.0, 0.25, 50


def key_links(docs: DataFrame, doc: str, key: Column) -> DataFrame:
    """(u, v): every document linked to the first one that has its key; empty and null keys link nothing."""
    keyed = docs.select(F.col(doc).alias("u"), key.alias("k")).where("k IS NOT NULL AND k <> ''")
    first = keyed.groupBy("k").agg(F.min("u").alias("v"))
    return keyed.join(first, "k").where("u <> v").select("u", "v")


def band_links(docs: DataFrame, doc: str, key: Column, value: str, width: float = NEAR_SECONDS) -> DataFrame:
    """(u, v): documents of one key whose values are at most ``width`` apart, linked in a chain.

    Sorted by value a document links to the one before it if that is near enough: this joins the same
    documents as all near pairs would, with one row each.
    """
    from pyspark.sql import Window

    keyed = docs.select(F.col(doc).alias("u"), key.alias("k"), F.col(value).alias("x")).where("k <> '' AND x IS NOT NULL")
    w = Window.partitionBy("k").orderBy("x", "u")
    linked = keyed.withColumn("v", F.lag("u").over(w)).withColumn("y", F.lag("x").over(w))
    return linked.where(F.col("x") - F.col("y") <= width).select("u", "v")


def overlap_pairs(passages: DataFrame, doc: str, hash_: str, least: float = OVERLAP, most_docs: int = BOILERPLATE) -> DataFrame:
    """(a, b, shared, share): documents that share at least ``least`` of the smaller one's passages; see also ``copy_links``.

    ``passages`` has (doc, hash), distinct. A passage in over ``most_docs`` documents makes no pairs but counts in
    the sizes; that bounds the pairs of a passage.
    """
    own = written(passages.select(F.col(doc).alias("d"), F.col(hash_).alias("h")), "passages")[0]  # read five times below
    sizes = own.groupBy("d").agg(F.count("*").alias("size"))
    telling = own.groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most_docs)).select("h")
    few = own.join(telling, "h")
    pairs = few.select("h", F.col("d").alias("a")).join(few.select("h", F.col("d").alias("b")), "h").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(sizes.select(F.col("d").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("d").alias("b"), F.col("size").alias("size_b")), "b")
    return pairs.withColumn("share", F.col("shared") / F.least("size_a", "size_b")).where(F.col("share") >= least).select("a", "b", "shared", "share")


def copy_links(passages: DataFrame, doc: str, hash_: str) -> DataFrame:
    """(u, v): documents with equal sets of passages linked to the least of them, whatever their number.

    It joins what ``overlap_pairs`` passes over where many copies make all their passages boilerplate. Equal sets are told
    by their size and two sums of hashes.
    """
    sums = [F.sum(F.xxhash64(hash_, F.lit(seed)).cast("decimal(38,0)")).alias(f"sum {seed}") for seed in (0, 1)]
    sets = passages.groupBy(F.col(doc).alias("u")).agg(F.count("*").alias("size"), *sums)
    first = sets.groupBy("size", "sum 0", "sum 1").agg(F.min("u").alias("v"))
    return sets.join(first, ["size", "sum 0", "sum 1"]).where("u <> v").select("u", "v")


def set_links(docs: DataFrame, doc: str, names: Column) -> DataFrame:
    """(u, v): documents linked to the first one that shares a name with them; ``names`` is an array, empty names link nothing."""
    named = docs.select(F.col(doc), F.explode(F.array_distinct(names)).alias("name"))
    return key_links(named, doc, F.col("name"))


def groups(docs: DataFrame, doc: str, *links: DataFrame) -> DataFrame:
    """(doc, root): the least document of each group that the links join; a document without links is its own root."""
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.unionByName(more)
    roots = components(all_links)
    return docs.select(doc).distinct().join(roots, F.col(doc) == F.col("node"), "left").select(doc, F.coalesce("root", doc).alias("root"))


def untainted(grouped: DataFrame, doc: str, tainting: DataFrame, complete: DataFrame) -> DataFrame:
    """(doc): complete documents, alone in their group, whose group has no tainting document."""
    tainted = grouped.join(tainting.select(doc), doc, "left_semi").select("root").distinct()
    alone = grouped.groupBy("root").agg(F.count("*").alias("n")).where("n = 1").select("root")
    return grouped.join(alone, "root", "left_semi").join(tainted, "root", "left_anti").join(complete.select(doc), doc, "left_semi").select(doc)
