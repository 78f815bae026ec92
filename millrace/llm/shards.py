"""A store of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are written as small shards. A compaction merges runs of similar size into files near the
target size, and leaves alone what is near it already. Either ends by committing a new manifest: it is written
aside and renamed to the next version's name, which fails if that name exists, so readers see the old version
or the new one and of two writers one loses. That holds where a rename is atomic (HDFS, local disks, stores with
hierarchical names); on a plain object store commits need a lock or a conditional put around ``commit``.
Shards are never changed; those that no manifest needs are removed afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import file_system

#: Bytes of text of a small shard and of a target-sized one, and the fewest runs that a merge takes.
SMALL, TARGET, FAN_IN = 16 << 20, 128 << 20, 2
#: A shard of this share of the target is not merged again: rewriting it would gain next to nothing.
NEAR = 0.75
#: Manifests up to this many rows are broadcast to the rows of their shards; larger ones join by shuffle.
BROADCAST_ROWS = 100_000

_MANIFEST = "run string, shard string, n_docs long, n_bytes long, version int"


def size_tier(n_bytes: Column) -> Column:
    """Runs whose sizes are within a factor of four: half the binary digits."""
    return F.floor((F.length(F.bin(n_bytes)) + 1) / 2)


class ShardStore:
    """Shards of rows under one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str, size_col: str = "text", small: int = SMALL, target: int = TARGET, fan_in: int = FAN_IN) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.size_col, self.small, self.target, self.fan_in = size_col, small, target, fan_in

    # -- manifest

    def version(self) -> int:
        """The latest committed version; 0 for a store without any."""
        fs, p = file_system(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return 0
        return max([int(s.getPath().getName()[1:]) for s in fs.listStatus(p)], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, shard, n_docs, n_bytes, version that wrote it) of every live shard."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v{version:08d}")

    def commit(self, manifest: DataFrame, version: int) -> None:
        """Make ``manifest`` the given version, or fail if that version exists."""
        aside = f"{self.root}/staging/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(aside)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs, parent = file_system(self.spark, f"{self.root}/manifest")
        fs.mkdirs(parent)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(parent.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(path(aside), path(f"{self.root}/manifest/v{version:08d}"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    # -- data

    def _bytes(self) -> Column:
        return F.coalesce(F.octet_length(F.col(f"`{self.size_col}`")), F.lit(0)).cast("long") + 16

    def _live(self, manifest: DataFrame) -> DataFrame:
        """Rows of the manifest's shards, with its columns under names that start with millrace_key_."""
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data")
        keys = manifest.toDF(*[f"millrace_key_{c}" for c in manifest.columns])
        keys = F.broadcast(keys) if manifest.count() <= BROADCAST_ROWS else keys
        return rows.join(keys, (F.col("millrace_run") == F.col("millrace_key_run")) & (F.col("millrace_shard") == F.col("millrace_key_shard")))

    def _measured(self, run: str, version: int) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/millrace_run={run}")
        rows = rows.select(F.lit(run).alias("run"), F.col("millrace_shard").alias("shard"), "millrace_bytes")  # no text is read
        return rows.groupBy("run", "shard").agg(F.count("*").alias("n_docs"), F.sum("millrace_bytes").alias("n_bytes")).withColumn("version", F.lit(version))

    def append(self, rows: DataFrame, key: Column | None = None, label: str | None = None) -> int:
        """Add an arrival as small shards, without a shuffle of its rows, and commit; returns the version.

        ``key`` is an integer that deals rows over the arrival's shards; without one a hash of all columns
        does. ``label`` starts the shards' names and must be new to the store (default: the version).
        Tasks write their own files of each shard. An empty arrival commits nothing. Names of
        columns may not start with millrace_, which is the store's.
        """
        if any(c.lower().startswith("millrace_") for c in rows.columns):
            raise ValueError("columns named millrace_ are the store's own columns")
        if self.size_col not in rows.columns:
            raise ValueError(f"no column {self.size_col}")
        total = rows.agg(F.sum(self._bytes())).first()[0]
        before = self.version()
        if not total:
            return before
        version, shards = before + 1, -(-total // self.small)
        key = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) if key is None else key
        run = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
        named = rows.withColumn("millrace_bytes", self._bytes()).withColumn("millrace_shard", F.concat(F.lit(f"{label or f'v{version:08d}'}-s"), F.lpad(F.pmod(key, F.lit(shards)).cast("string"), 8, "0")))
        named.write.partitionBy("millrace_shard").parquet(f"{self.root}/data/millrace_run={run}")
        self.commit(self.manifest(before).unionByName(self._measured(run, version)), version)
        return version

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(run, shard, merged) of the runs to merge: of one size tier, in order, up to the target each.

        Runs of ``NEAR`` of the target or more stay, so a row is merged about once for each tier it passes. The running
        sum of a tier passes one task: a row of metadata for each run below the target.
        """
        small = manifest.where(F.col("n_bytes") < self.target * NEAR).withColumn("tier", size_tier(F.col("n_bytes")))
        order = Window.partitionBy("tier").orderBy("shard")
        small = small.withColumn("group", F.floor((F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")) / self.target))
        groups = small.groupBy("tier", "group").agg(F.count("*").alias("runs")).where(F.col("runs") >= self.fan_in)
        name = F.concat(F.lit("t"), F.lpad(F.col("tier").cast("string"), 2, "0"), F.lit("g"), F.lpad(F.col("group").cast("string"), 8, "0"))
        return small.join(groups, ["tier", "group"]).select("run", "shard", name.alias("merged"))

    def compact(self, label: str | None = None) -> int:
        """Merge similarly sized runs and commit; returns the version (the same if nothing is to merge)."""
        before = self.version()
        manifest = self.manifest(before)
        plan = self.plan(manifest).cache()
        merges = plan.select("merged").distinct().count()
        if not merges:
            return before
        version = before + 1
        run = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
        rows = self._live(plan).withColumn("millrace_shard", F.concat(F.lit(f"{label or f'v{version:08d}'}-"), F.col("millrace_key_merged")))
        rows = rows.drop("millrace_run", *[f"millrace_key_{c}" for c in plan.columns])
        rows.repartition(2 * merges, "millrace_shard").write.partitionBy("millrace_shard").parquet(f"{self.root}/data/millrace_run={run}")
        rest = manifest.join(plan, ["run", "shard"], "left_anti").select(*manifest.columns)
        self.commit(rest.unionByName(self._measured(run, version)), version)
        plan.unpersist()
        return version

    def vacuum(self) -> int:
        """Remove earlier versions and the shards that the latest manifest lacks; returns how many shards.

        Readers of earlier versions lose them. A crash in between leaves manifests whose shards the next call removes.
        """
        fs, base = file_system(self.spark, f"{self.root}/data")
        if not fs.exists(base):
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        now = self.version()
        fs_m, manifests = file_system(self.spark, f"{self.root}/manifest")
        old = [x.getPath() for x in fs_m.listStatus(manifests) if int(x.getPath().getName()[1:]) < now] if now else []
        if not old:
            return 0
        # Dead shards are those of any earlier manifest; only names pass here, one at a time. The manifests go with them.
        earlier = self.spark.read.schema(_MANIFEST).parquet(*[x.toString() for x in old]).select("run", "shard").distinct()
        removed = 0
        for r in earlier.join(self.manifest(now), ["run", "shard"], "left_anti").toLocalIterator():
            removed += fs.delete(path(f"{self.root}/data/millrace_run={r.run}/millrace_shard={r.shard}"), True)
        for x in old:
            fs_m.delete(x, True)
        return removed

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a committed version with shard, n_docs, n_bytes and version of their shard as struct ``millrace_shard``."""
        rows = self._live(self.manifest(version))
        about = F.struct(*[F.col(f"millrace_key_{c}").alias(c) for c in ("shard", "n_docs", "n_bytes", "version")])
        return rows.withColumn("millrace_shard", about).drop("millrace_run", "millrace_bytes", *[c for c in rows.columns if c.startswith("millrace_key_")])
