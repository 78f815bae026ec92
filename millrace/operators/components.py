"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """This application's folder for scratch tables, in the one that the cluster names; on this machine where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "millrace-scratch")
    return f"{root.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the application's scratch tables; results that have not been written yet can then not be read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _remove(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between ids of one orderable type to (node, root): root is a component's least node.

    Self links and repeats are ignored; only linked nodes have a row. Each round is a table in the shared
    folder; two numbers reach the driver.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now, path = written(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "components")
    mark = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    said = tuple(now.agg(*mark).first())
    while said[0]:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, to = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "components")
        _remove(now, path)
        before, said = said, tuple(after.agg(*mark).first())
        now, path = after, to
        if said == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
