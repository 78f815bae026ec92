"""Sufficient statistics of vectors, summed over partitions, and what is solved from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component_sums(vectors: DataFrame, column: str) -> DataFrame:
    """(i, n, total, squares) of each component, to six places."""
    rows = vectors.select(F.posexplode(F.col(column)).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("squares"))


def gram(vectors: DataFrame, column: str, target: Column) -> tuple[np.ndarray, int]:
    """Sums of products of (1, x, y) over all rows, and their number. A partition gives one matrix; those are added by key.

    The matrix is the only thing collected; its size is that of a vector squared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v, np.float64) for v in b.column(0).to_pylist()])
                full = np.hstack([np.ones((len(x), 1)), x, b.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total = full.T @ full if total is None else total + full.T @ full
                n += len(x)
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel()), pa.array([n] * total.size, pa.int64())], ["at", "v", "n"])

    parts = vectors.where(F.col(column).isNotNull()).select(column, target.cast("double").alias("y")).where("y IS NOT NULL").mapInArrow(run, "at int, v double, n long")
    rows = parts.groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()
    if not rows:
        return np.zeros((0, 0)), 0
    size = int(len(rows) ** 0.5)
    return np.array([r.v for r in rows]).reshape(size, size), rows[0].n


def ridge(vectors: DataFrame, column: str, target: Column, strength: float) -> DataFrame:
    """(i, weight): the bias at -1, which is not shrunk, and a weight for each component.

    The penalty is ``strength`` times the mean of the diagonal, so it does not depend on the scale.
    """
    spark = vectors.sparkSession
    m, n = gram(vectors, column, target)
    if not n:
        return spark.createDataFrame([], "i int, weight double")
    a, b = m[:-1, :-1].copy(), m[:-1, -1]
    k = len(a)
    a[np.arange(1, k), np.arange(1, k)] += strength * np.trace(a[1:, 1:]) / max(1, k - 1)
    solved = np.linalg.solve(a, b)
    return spark.createDataFrame([(i - 1, float(w)) for i, w in enumerate(solved)], "i int, weight double")
