"""Frozen splits: sides written with a manifest of their digests, and refused where they no longer agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import content_digest

_BANK = "bank"


def freeze_split(path: str, sides: dict[str, DataFrame], bank: DataFrame, created: str) -> None:
    """Write each side and the bank under ``path``, then a manifest of their digests and of the plan they were built from.

    The manifest goes last and is removed first, so that a build that did not end leaves a split that is refused. Digests are
    sums over rows, taken of what was written; no table passes the driver. ``bank`` is no name of a side.
    """
    if _BANK in sides:
        raise ValueError(f"a side cannot be named {_BANK}")
    spark = bank.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    manifest = hadoop.Path(f"{path}/manifest")
    manifest.getFileSystem(spark._jsc.hadoopConfiguration()).delete(manifest, True)
    rows = []
    for name, df in {**sides, _BANK: bank}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, content_digest(spark.read.parquet(f"{path}/{name}"), [name]), created))
    spark.createDataFrame(rows, "name string, digest string, created string").coalesce(1).write.parquet(f"{path}/manifest")


def frozen_split(spark: SparkSession, path: str, names: list[str], created: str) -> dict[str, DataFrame]:
    """The sides of a frozen split and its bank, each checked before use.

    An error if the manifest is missing or lists other sides than ``names``, if it was built from another plan than the one
    ``created`` names, or if the rows of a side or of the bank are not those that were written.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path}/manifest/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise ValueError(f"{path} has no manifest: build the split again")
    known = {r.name: r for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row for each side
    if set(known) != {*names, _BANK}:
        raise ValueError(f"{path} has {sorted(known)}, not {sorted([*names, _BANK])}: build the split again")
    old = sorted(n for n, r in known.items() if r.created != created)
    if old:
        raise ValueError(f"{path}: {', '.join(old)} built from another plan than {created}: build the split again")
    out = {n: spark.read.parquet(f"{path}/{n}") for n in known}
    for name, df in out.items():
        if content_digest(df, [name]) != known[name].digest:
            raise ValueError(f"{path}: {name} is not what the split was built with: build the split again")
    return out
