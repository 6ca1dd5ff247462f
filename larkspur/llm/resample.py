"""Importance resampling towards a target: hashed 1- to 3-grams of words, their gain from corpus to target, a Gumbel draw.

Features are hashed by a byte automaton over the Arrow buffers of a batch: a table of 256 entries says which bytes belong to
words, differences of it give the bounds of words, and CRC-32 registers of all word starts of the batch advance together,
a byte a step. A register that has passed its word is the word's hash; it goes on over one space into the next word for
the pairs, and once more for the triples, so no feature is ever put together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, Scratch, numbered, partial_sums, slices, utf8, word_bounds

BUCKETS, LONGEST_RUN = 10_000, 3
#: Words of more bytes are taken one by one, each in one call.
LONG = 48
#: Word starts that advance together, so that their registers stay in the cache.
TOGETHER = 1 << 14


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


CRC = _crc_table()
_BYTE = np.uint32(255)


def _advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The registers after the bytes of their words."""
    state, size = state.copy(), ends - starts
    short = np.flatnonzero(size <= LONG)
    order = short[np.argsort(size[short], kind="stable")]  # those that end first lie first
    at, now, sizes = starts[order], state[order], size[order]
    done = np.searchsorted(sizes, np.arange(1, (int(sizes[-1]) if len(sizes) else 0) + 1))
    for step, first in enumerate(done):
        rest = now[first:]
        now[first:] = CRC[(rest ^ raw[at[first:] + step]) & _BYTE] ^ (rest >> np.uint32(8))
    state[order] = now
    for i in np.flatnonzero(size > LONG):
        state[i] = zlib.crc32(raw[starts[i] : ends[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each run of 1 to ``longest`` words, the row that it is of, and each row's words, for texts as UTF-8
    bytes with bounds."""
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets, WORD_BYTE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    after = first[1:][row] if len(row) else row  # the number of the word after the row's last one
    found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(starts), TOGETHER):
        word = np.arange(at, min(at + TOGETHER, len(starts)))
        state = np.full(len(word), 0xFFFFFFFF, np.uint32)
        for n in range(longest):
            if n:
                more = word + n < after[word]
                word, state = word[more], state[more]
                state = CRC[(state ^ np.uint32(0x20)) & _BYTE] ^ (state >> np.uint32(8))
            state = _advance(state, raw, starts[word + n], ends[word + n])
            found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
            of.append(row[word])
    return np.concatenate(found), np.concatenate(of), np.diff(first)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` are in each bucket. A task sends one array, arrays are added up in a tree, and
    the driver gets at most 64 of them, whatever the rows are. Counts are exact up to 2**53."""

    def run(batches):
        total, rows = np.zeros(buckets, np.int64), 0
        for batch in slices(batches):
            at, _, _ = features(*utf8(batch.column(0)), buckets)
            total += np.bincount(at, minlength=buckets)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.int64()), pa.array([total.astype(float).tobytes()], pa.binary())], names=["part", "rows", "total"])

    parts = texts.select(F.col(text).alias("text")).mapInArrow(run, "part int, rows long, total binary")
    return sum((np.frombuffer(r["total"]) for r in partial_sums(parts).collect()), np.zeros(buckets))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of a bucket's smoothed share in the target over that in the corpus, rounded down."""
    n, every, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (every + n)) / ((corpus + 1.0) * (wanted + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a text's features. ``gain`` has a number a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in slices(batches):
            own = shared.value
            at, row, words = features(*utf8(batch.column(1)), len(own))
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, own[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 42) -> Column:
    """A thousand times a Gumbel variable that follows from seed and doc_id, rounded down. A null doc_id counts as none."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, noise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each of ``docs``: of the documents with ``least_words`` words at
    least, ``percent`` of a hundred are drawn without replacement, those of the highest weight plus Gumbel noise, equal
    ones by the smaller doc_id (null last). rank is the place among the drawn ones, null of others.

    Features are runs of one to three words of the texts, lower-cased in A-Z. A null text has no words; rows of one doc_id are
    rows of their own with the same noise; no ``target`` makes rare features gain most; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + (noise or (lambda c: gumbel(c, seed)))(F.col("doc_id")))
    scored = scratch.save("scored", scored.withColumn("may", F.col("n_words") >= least_words))
    # (may, n) of at most two groups
    placed = numbered(scored, ["may"], [F.desc("score"), F.asc_nulls_last("doc_id"), "n_words"], scratch, "placed")
    drawn = F.col("may") & (F.col("idx") < F.expr(f"{percent} * n div 100"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("idx") + 1).alias("rank"))
