"""The shared folder for checkpoints, and spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Keeps the session's checkpoint folder; sets a temporary one only in local mode, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, for what several parts of a plan read: it is made once, and the plan stays small."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if a scan makes fewer, as for a file of one row group. Larger
    inputs aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder beside the checkpoints, for tables of one run; it goes when the session ends."""
    ensure_checkpoints(spark)
    sc = spark.sparkContext
    where = f"{sc.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def saved(df: DataFrame, label: str = "saved") -> DataFrame:
    """``df`` as Parquet in a folder of this run: for larger results that several parts of a plan read, as plans know its size
    and read only the columns that they need."""
    where = scratch_folder(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
