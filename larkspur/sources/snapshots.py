"""Versioned snapshots of a table, and the archive's exchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ARCHIVED


class Snapshots:
    """A folder with versions ``v=N``. A version is there for readers once its write has ended (its _SUCCESS file), so
    readers see whole snapshots and writers never change one."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        done = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={found[-1] if version is None else version}")

    def commit(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Writes the next version and removes all but the last ``keep``."""
        found = self.versions()
        version = found[-1] + 1 if found else 1
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{self.root}/v={version}")
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/v={old}"), True)
        return version

    def compact(self, files: int) -> int:
        """The last version again in ``files`` files."""
        return self.commit(self.read().repartition(files))


def export_archive(archive: DataFrame, path: str, as_of: Column) -> None:
    """JSON lines, newest first within a file, and a manifest of one row beside them."""
    archive.sortWithinPartitions(F.desc("archived_time"), "original_id").write.mode("overwrite").json(f"{path}/records")
    archive.agg(F.count("*").alias("records"), F.min("archived_time").alias("first"), F.max("archived_time").alias("last")).withColumn("exported", as_of).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_archive(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Archived records as new ones: weight 0.5 where there is none, source ``archive``."""
    rows = spark.read.schema(ARCHIVED).json(f"{path}/records")
    return rows.select(
        F.col("original_id").alias("id"), "text", "compressed_text", F.lit("archive").alias("source"), F.coalesce("weight", F.lit(0.5)).alias("weight"),
        F.coalesce("access_count", F.lit(0)).alias("access_count"), F.coalesce("original_created_time", as_of).alias("created_time"), as_of.alias("last_access_time"), F.lit(False).alias("is_archived"),
    )
