"""Vectors of texts: a deterministic stand-in, and a hook for a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _c, vector_id

SIZE = 64


def stand_in(text: str, size: int = SIZE) -> np.ndarray:
    """A unit vector that depends on the text alone: normal numbers, seeded by the first 32 bits of its MD5."""
    return _of_seed(int(hashlib.md5(text.encode()).hexdigest()[:8], 16), size)


def _of_seed(seed: int, size: int) -> np.ndarray:
    v = np.random.RandomState(seed).randn(size).astype(np.float32)
    return v / np.linalg.norm(v)


def fallback(x, size: int = SIZE) -> Column:
    """``stand_in`` of each text; null is null. It says nothing about meaning: equal texts are alike and others aren't. The seed is
    made in the JVM, so no text reaches Python."""

    @F.pandas_udf("array<float>")
    def made(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda n: None if pd.isna(n) else _of_seed(int(n), size))

    return made(F.conv(F.substring(F.md5(_c(x)), 1, 8), 16, 10).cast("long").cast("double"))  # a double holds 32 bits, and null


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray] | None = None, text: str = "text", batch: int = 500, size: int = SIZE, allow_fallback: bool = False) -> DataFrame:
    """``rows`` with ``embedding``, unit vectors of ``text``. Each distinct text is embedded once. ``model`` takes up to
    ``batch`` texts and gives a row each; it is made once a worker if it has a ``load`` method. Without a model the
    stand-in is used if ``allow_fallback`` says so; it is made in place, as a seed costs less than moving its text. Null texts
    have no vector."""
    if model is None and not allow_fallback:
        raise ValueError("no model: pass one, or allow the stand-in")
    if model is None:
        return rows.withColumn("embedding", fallback(text, size))
    distinct = rows.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    vectors = distinct.withColumn("embedding", _modelled(model, batch, size)("__text"))
    return rows.join(vectors, F.col(text) == F.col("__text"), "left").drop("__text")


def _modelled(model: Callable[[list[str]], np.ndarray], batch: int, size: int) -> Callable[[str], Column]:
    """The unit vectors of ``model`` for a column of texts; ``batch`` of them are Python's at a time."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = model.load() if hasattr(model, "load") else model
        for texts in parts:
            found = [np.zeros((0, size), np.float32)]
            for at in range(0, len(texts), batch):
                made = np.asarray(ready(texts.slice(at, batch).to_pylist()), np.float32)
                found.append(made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12))
            whole = np.concatenate(found[1:] or found)
            starts = np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1]
            yield pa.ListArray.from_arrays(pa.array(starts), pa.array(whole.ravel()))

    return run


class VectorCache:
    """Vectors of texts in a folder, filed under the SHA-256 of the text and the model's name. Only texts that aren't there reach
    the model; what it gives is added. Two writers may file a text twice: readers take one."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/model={name}"

    def held(self) -> DataFrame:
        """(h, embedding), empty before the first write."""
        empty = self.spark.createDataFrame([], "h binary, embedding array<float>")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return empty
        return self.spark.read.schema(empty.schema).parquet(self.root).groupBy("h").agg(F.first("embedding").alias("embedding"))

    def unseen(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """(h, text) of the distinct texts that have no vector yet."""
        texts = rows.where(F.col(text).isNotNull()).select(content_key(text), F.col(text).alias("text"))
        return texts.join(self.held().select("h"), "h", "left_anti").dropDuplicates(["h"])

    def unseen_keys(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """(h) of the same texts, without moving them."""
        return rows.where(F.col(text).isNotNull()).select(content_key(text)).distinct().join(self.held().select("h"), "h", "left_anti")

    def embed(self, rows: DataFrame, model: Callable[[list[str]], np.ndarray] | None = None, text: str = "text", **options) -> DataFrame:
        """``rows`` with ``embedding``, as ``embed`` gives it."""
        new = self.unseen(rows, text)  # each text once, so nothing is joined to them
        made = embed(new, None, **options) if model is None else new.withColumn("embedding", _modelled(model, options.get("batch", 500), options.get("size", SIZE))("text"))
        made.select("h", "embedding").write.mode("append").parquet(self.root)
        found = self.held().withColumnRenamed("h", "__h")
        return rows.withColumn("__k", content_key(text)).join(found, F.col("__k") == F.col("__h"), "left").drop("__k", "__h")


def content_key(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256)).alias("h")


def vector_rows(records: DataFrame, as_of: Column, **options) -> DataFrame:
    """Rows (id, document, embedding, timestamp, record_id, at) for the vector store from records (id, text, created_time)."""
    made = embed(records.select("id", "text", "created_time"), **options)
    return made.select(vector_id("text").alias("id"), F.col("text").alias("document"), "embedding", F.coalesce("created_time", as_of).alias("timestamp"), F.col("id").alias("record_id"), F.col("id").alias("at"))
