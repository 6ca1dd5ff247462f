"""Nearest neighbours by cells: k-means centres, every vector filed under its nearest one, queries that ask near cells only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .blocks import FOUND, PACKED, best, packed
from .blocks import matrix as _matrix
from .retrieval import top, vector_top_k

#: Centres, rounds of training, the sample it takes at most, and rows of a block of a cell.
CELLS, ROUNDS, SAMPLE, BLOCK = 64, 6, 20_000, 2048
#: Queries that are dealt to their cells together.
ASKED = 256


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre by distance, the first of equals."""
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def train(vectors: DataFrame, cells: int = CELLS, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """The centres (a row each) of (id, embedding): Lloyd's rounds on the ``sample`` rows with the smallest hashes of ids, so
    the driver gets no more than ``cells`` sums a round. Fewer rows than cells are their own centres."""
    drawn = settled(vectors.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding"))
    first = [r[0] for r in drawn.limit(cells).collect()]
    centres = np.array(first, float).reshape(len(first), -1 if first else 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            cell = _closest(x, centres)
            np.add.at(total, cell, x)
            n += np.bincount(cell, minlength=len(centres))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array([t.tobytes() for t in total[held]], pa.binary())], names=["cell", "n", "total"])

    for _ in range(rounds if len(centres) else 0):
        parts = drawn.mapInArrow(sums, "cell long, n long, total binary").collect()  # at most ``cells`` rows for each task of the sample
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for r in parts:
            total[r.cell] += np.frombuffer(r.total)
            n[r.cell] += r.n
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class CellIndex:
    """An index of (id, embedding) in a folder: blocks of at most BLOCK rows of a cell with their ids, and of each cell how far
    its rows lie from the centre. All rows are filed, those without a vector left out. A cell with many rows is many blocks
    in many tasks."""

    def __init__(self, spark: SparkSession, root: str, centres: np.ndarray, block: int = BLOCK):
        self.spark, self.root, self.centres, self.block = spark, root.rstrip("/"), centres, block

    def build(self, vectors: DataFrame, parts: int = 4) -> CellIndex:
        centres, block = self.centres, self.block

        def filed(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                if len(x):
                    cell = _closest(x, centres)
                    away = np.arccos(np.clip((x * centres[cell]).sum(1) / np.maximum(np.linalg.norm(centres[cell], axis=1) * np.linalg.norm(x, axis=1), 1e-12), -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns, pa.array(away)], names=["cell", "id", "embedding", "away"])

        rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        dealt = rows.mapInArrow(filed, "cell long, id long, embedding array<double>, away double")
        dealt = dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("cell", "id")
        widest = F.udf(lambda away: float(np.frombuffer(away).max()), "double")
        blocks = dealt.mapInArrow(lambda b: packed(b, block), PACKED).withColumn("away", widest("away"))
        blocks.write.mode("overwrite").parquet(f"{self.root}/blocks")
        return self

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/blocks")

    def _asked(self, queries: DataFrame, limits: DataFrame | None, probes: int) -> DataFrame:
        """(cell, query_ids, asked, least): queries in blocks by the cells that they ask: the ``probes`` nearest, or, with ``limits``
        (query_id, least), the others that may hold a similarity of ``least``. A query comes once for each cell, so few are
        dealt at a time."""
        centres, block, rest = self.centres, self.block, limits is not None
        far = np.full(len(centres), -1.0)
        for r in self.blocks().groupBy("cell").agg(F.max("away").alias("away")).collect():  # a row for each cell
            far[r.cell] = r.away
        joined = queries.select("query_id", "embedding") if limits is None else queries.select("query_id", "embedding").join(limits, "query_id", "left")

        def dealt(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, ASKED):
                    batch = whole.slice(at, ASKED)
                    x = _matrix(batch.column(1))
                    least = np.full(len(x), -np.inf)
                    distance = (centres**2).sum(1) - 2 * x @ centres.T
                    near = np.argsort(np.argsort(distance, axis=1, kind="stable"), axis=1) < probes
                    if rest:
                        least = np.array([-np.inf if v is None else v for v in batch.column(2).to_pylist()])
                        size = np.linalg.norm(x, axis=1)[:, None]
                        angle = np.arccos(np.clip(x @ centres.T / np.maximum(size * np.linalg.norm(centres, axis=1), 1e-12), -1, 1))
                        near = ~near & (size * np.cos(np.maximum(angle - far, 0)) >= least[:, None] - 1e-9)  # rows have length one
                    row, cell = np.nonzero(near & (far >= 0))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(least[row])], names=["cell", "id", "embedding", "away"])

        rows = joined.where("embedding is not null").withColumns({"query_id": F.col("query_id").cast("long"), "embedding": F.col("embedding").cast("array<double>")})
        spread = rows.mapInArrow(dealt, "cell long, id long, embedding array<double>, away double").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cell", "id")
        return spread.mapInArrow(lambda b: packed(b, block), PACKED).select("cell", F.col("ids").alias("query_ids"), F.col("own").alias("asked"), F.col("away").alias("least"))

    def _best(self, asked: DataFrame, k: int) -> DataFrame:
        pairs = asked.join(self.blocks(), "cell").select("ids", "own", "query_ids", "asked", "least")
        return top(pairs.mapInArrow(lambda b: best(b, k), FOUND), ["query_id"], [F.desc("similarity"), "id"], k)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, similarity, rank): the k largest dot products among the rows of each query's ``probes`` nearest cells."""
        return self._best(self._asked(queries, None, probes), k)

    def exact(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """The k largest of all rows, which have length one: what ``probes`` cells give sets a limit, and only the cells that may hold
        something above it, by the angle between query and centre and the cell's width, are asked then."""
        first = settled(self.search(queries, k, probes))
        limits = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
        more = self._best(self._asked(queries, limits, probes), k)
        return top(first.drop("rank").unionByName(more.drop("rank")), ["query_id"], [F.desc("similarity"), "id"], k)

    def calibrated(self, vectors: DataFrame, k: int = 10, recall: float = 0.9, sample: int = 200) -> int:
        """The least number of probes, a power of two, that finds ``recall`` of the true neighbours of a sample."""
        queries = settled(vectors.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding"))
        true = settled(vector_top_k(vectors, queries, k).select("query_id", "id"))
        n, probes = true.count(), 1
        while probes < len(self.centres) and self.search(queries, k, probes).join(true, ["query_id", "id"]).count() < recall * n:
            probes *= 2
        return min(probes, max(1, len(self.centres)))


def neighbour_graph(rows: DataFrame, root: str, k: int = 10, cells: int = CELLS, recall: float | None = None) -> DataFrame:
    """(a, b, similarity, rank) of each row (id, embedding) a and its k nearest other rows b. ``recall`` allows an approximate
    answer by as many probes as a sample needs for it; without it all neighbours are true ones."""
    vectors = settled(rows.select("id", "embedding"))
    index = CellIndex(rows.sparkSession, root, train(vectors, cells)).build(vectors)
    asked = vectors.withColumnRenamed("id", "query_id")
    near = index.exact(asked, k + 1) if recall is None else index.search(asked, k + 1, index.calibrated(vectors, k, recall))
    place = Window.partitionBy("query_id").orderBy("rank")
    others = near.where("id <> query_id").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return others.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "similarity", "rank")
