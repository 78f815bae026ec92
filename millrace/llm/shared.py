"""Helpers that the corpus operators share: scratch tables in the shared folder and column checks."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for tables that cut lineage.

    A cluster names where it lies in ``spark.checkpoint.dir``. Where that is unset, as in local tests, it is on this
    machine. ``operators.components.clear_scratch`` removes it once results are written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "millrace-scratch")
    return f"{root.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; any executor can then be lost."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as a shuffle has: with their number given they are not put together again.

    Adaptive plans join partitions by their bytes, and so leave one or two tasks where little data is much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def new_name(df: DataFrame, base: str, *others: DataFrame) -> str:
    """A column name that clashes with none of the given tables' columns."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_go() -> None:
    """Give a Python worker's free memory back to the machine: Spark keeps the worker for other queries."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 512) -> SparkSession:
    """Have Spark send at most so many rows at once to Python: texts are long, and a worker holds whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark
