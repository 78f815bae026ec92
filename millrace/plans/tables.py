"""Reading of the tables and SQL pieces that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda x: x <> ''))"


def share_sql(key: str) -> str:
    return f"('0x' || substr(sha1({key}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


def ranks_sql(value: str) -> str:
    at = lambda p: f"list_sort(list({value}))[least(count({value}) - 1, floor({p}::DOUBLE * count({value}))::BIGINT) + 1]"
    return f"count({value}) AS n, min({value}) AS min, {at(0.5)} AS p50, {at(0.9)} AS p90, {at(0.99)} AS p99, max({value}) AS max"
