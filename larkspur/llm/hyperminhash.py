"""MinHash near-duplicates by HyperMinHash registers.

A set's shingle hashes are dealt to REGISTERS buckets; of the smallest value of a bucket 16 bits are kept: how many zeros it
begins with, and ten bits behind its first one. BANDS runs of registers are hashed to keys, and sets that share a key are
candidates. Of a pair that is alike at 0.85 a band agrees with a probability of 0.444, all bands fail with 7e-9; as every
register is in a band, small sets, of which few shingles may differ, fail as rarely. Then registers are compared: the number
that agree, less the number that would by chance, must reach what pairs that are alike fall short of once in 10**12 times
for as many filled registers. The pairs left are verified on their full sets.

Equal sets are one node from the start. In a large bucket no pairs are made: each set is compared with two heads first, and
those that aren't one group by then are compared in full, chunk by chunk (``simhash``).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected, join_groups, mix, slices, utf8
from .simhash import CHUNK, _joined, _keyed, _rest_of_buckets, _split_buckets, _verified, shingle_hashes, shingle_sets

REGISTERS, BANDS, MANTISSA, VALUE = 160, 32, 10, 48
ALIKE = 0.85
#: How often a pair that is alike may be lost by the comparison of registers.
LOSS = 1e-12
#: Sets in a bucket up to which its pairs are made. Any value gives the same groups.
SMALL = 12


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set's hashes, zero where a bucket is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    h = np.sort(mix(hashes ^ np.uint64(0xA0761D6478BD642F)))  # by bucket, then by value
    bucket = (((h >> np.uint64(VALUE)) * np.uint64(REGISTERS)) >> np.uint64(64 - VALUE)).astype(np.int64)
    value = h * np.uint64(0x2545F4914F6CDD1D)  # the bits above say the bucket, so values are mixed anew
    value = mix(value) >> np.uint64(64 - VALUE)
    if len(h):
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        least = np.minimum.reduceat(value, first)
        _, length = np.frexp(least.astype(float))
        length = length.astype(np.int64)
        behind = np.where(length > MANTISSA, least >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), least << np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64))
        out[bucket[first]] = ((VALUE - length + 1) << MANTISSA) | (behind.astype(np.int64) & ((1 << MANTISSA) - 1))
    return out


def sketches(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, h, known, n, s1, s2, registers binary) of ``_keyed`` rows: n distinct shingles, whose set has the hash s1, s2."""

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(3)]
            names = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            halves = np.frombuffer(names, ">i8").astype(np.int64).reshape(-1, 2)
            size = pa.array([len(s) for s in sets], pa.int64())
            kept = pa.array([registers(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], size, *(pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)), kept], names=["id", "h", "known", "n", "s1", "s2", "registers"])

    return rows.mapInArrow(run, "id long, h long, known boolean, n long, s1 long, s2 long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint16).reshape(-1, REGISTERS)


def band_keys(sets: DataFrame) -> DataFrame:
    """(key, beside, node, n) of (node, n, registers): a key for each band that isn't empty, and one made of two bands."""

    def run(batches):
        for batch in batches:
            own = _matrix(batch.column(2)).reshape(-1, BANDS, REGISTERS // BANDS)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), own.shape[:2]).copy()
                for i in range(own.shape[2]):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, :, i])
                beside = mix(key * np.uint64(3) + np.roll(key, -1, axis=1))
            row, band = np.nonzero(own.any(2))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key[row, band].view(np.int64)), pa.array(beside[row, band].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "beside", "node", "n"])

    return sets.select("node", "n", "registers").mapInArrow(run, "key long, beside long, node long, n long")


@functools.lru_cache(1 << 12)
def chance(a: int, b: int) -> float:
    """With which probability a register agrees in sets without a common shingle, of about 2**(a/2) and 2**(b/2) shingles."""
    step = 2.0**-MANTISSA
    top = 2.0 ** -np.arange(1, VALUE + 1)[:, None]
    low = top * (1 + step * np.arange(1 << MANTISSA))
    each = [np.exp(-(2 ** (k / 2) / REGISTERS) * low) * -np.expm1(-(2 ** (k / 2) / REGISTERS) * top * step) for k in (a, b)]
    return float((each[0] * each[1]).sum())


@functools.lru_cache(8)
def least_agreeing(alike: float) -> np.ndarray:
    """For each number of registers that either set fills, how many agree at least in all but LOSS of pairs alike."""
    out = np.zeros(REGISTERS + 1)
    for m in range(1, REGISTERS + 1):
        below, k = 0.0, 0
        while (below := below + math.comb(m, k) * alike**k * (1 - alike) ** (m - k)) <= LOSS:
            k += 1
        out[m] = k
    return out


def agreement(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filled, agree) of pairs of rows: registers that either fills, and how many agree beyond chance. Their ratio is the
    estimate of the Jaccard similarity."""
    filled = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    sizes = np.rint(2 * np.log2(np.stack([na, nb], 1))).astype(int)
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    by_chance = np.array([chance(*sorted(k)) for k in kinds.tolist()])[which.reshape(-1)]
    return filled, np.maximum(same - filled * by_chance, 0) / (1 - by_chance)


def promising(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """(a, b, apart) of the pairs (a, b) of nodes whose registers may be those of sets alike."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy() for i in (2, 4))
                filled, agree = agreement(_matrix(batch.column(3)), _matrix(batch.column(5)), na, nb)
                may = pa.array(agree >= least_agreeing(alike)[filled] - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(filled - agree).astype(np.int32))], names=["a", "b", "apart"]).filter(may)

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ra", "nb", "rb")
    return both.mapInArrow(run, "a long, b long, apart int")


def similar_sets(docs: DataFrame, shingle: int = 3, alike: float = ALIKE, small: int = SMALL, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of ``docs``.

    A document's set is that of its distinct shingles of lower-cased (A-Z) words; with fewer words the whole sequence is the
    one shingle; without words, or a null text, the set is empty and linked with nothing. Documents are linked if their
    sets have a Jaccard similarity of ``alike`` or more, which is confirmed on the full sets. component_id is the smallest doc_id
    that links reach, itself included; a null one is none unless the whole component has no other. kept says whether it is
    the own one. Rows of a repeated doc_id stay rows of their own. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "hyperminhash")
    rows = _keyed(docs, doc_id, text)
    drawn = scratch.save("drawn", sketches(rows, shingle))
    # one set each; ``node`` is unique in the saved table
    first = F.min(F.struct((~F.col("known")).alias("unknown"), "id", "h")).alias("first")
    equal = drawn.groupBy("s1", "s2").agg(first, F.first("n").alias("n"), F.first("registers").alias("registers"), F.count("*").alias("rows"))
    sets = scratch.save("sets", equal.withColumn("node", F.monotonically_increasing_id()))
    filled = sets.where("n > 0").select("node", "n", "registers", F.col("first.id").alias("id"), F.col("first.h").alias("h"))
    keyed = band_keys(filled)
    sizes = scratch.save("sizes", keyed.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("m")).where("c > 1"))
    held = scratch.save("held", join_groups(keyed, sizes, ["key"], "c"))
    few, many = held.where(F.col("c") <= small).select("key", "node", "n"), held.where(F.col("c") > small)
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (alike - 1e-9)
    x, y = few.alias("x"), few.alias("y")
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    heads = scratch.save("heads", many.groupBy("beside").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")))
    for stars, head in ((many, "m"), (join_groups(many.select("beside", "node", "n"), heads, ["beside"], "size"), "head")):
        near = near.union(stars.where(fits(F.col("n"), F.col(f"{head}.n"))).select(F.col(f"{head}.node").alias("a"), F.col("node").alias("b")))
    pairs = scratch.save("pairs", near.where("a <> b").distinct())
    maybe = scratch.save("maybe", promising(pairs, filled, alike))
    closest = scratch.save("closest", maybe.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"))
    links = scratch.save("links", _verified(closest, rows, filled, scratch, "closest", shingle, alike, chunk))
    groups = scratch.save("first", connected(links, scratch))
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    rest = maybe.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.col("ac") == F.col("bc"), F.lit(False))).select("a", "b")
    rest = scratch.save("open", rest.join(closest, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        groups = _joined(groups, _verified(rest, rows, filled, scratch, "open", shingle, alike, chunk), scratch, "second")
    # the fingerprint bits of ``simhash`` aren't asked here
    bits = {f"b{i}": F.lit(0).cast("long") for i in range(4)}
    known = filled.select("node", "n", "id", "h", F.lit(True).alias("known"), F.lit(0).alias("keys")).withColumns(bits)
    members = scratch.save("members", _split_buckets(many.select("key", "node"), groups, known, scratch))
    if not members.isEmpty():
        wanted = members.select("id", "h", "node").distinct()
        found = scratch.save("rest", shingle_sets(rows.join(wanted, ["id", "h"]).select("node", "text"), shingle).dropDuplicates(["node"]))
        groups = _joined(groups, _rest_of_buckets(members, found, scratch, 256, alike, chunk), scratch, "third")
    own = sets.select("s1", "s2", "node", "first", "rows").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = scratch.save("own", own)
    least = scratch.save("least", own.groupBy("component").agg(F.min("first").alias("of"), F.count("*").alias("size")))
    classes = scratch.save("classes", join_groups(own, least, ["component"], "size").select("s1", "s2", "of", "rows"))
    of_row = join_groups(drawn.select("id", "known", "n", "s1", "s2"), classes, ["s1", "s2"], "rows")
    doc, alone = F.when(F.col("known"), F.col("id")), F.col("n") == 0
    component = F.when(alone, doc).otherwise(F.when(~F.col("of.unknown"), F.col("of.id")))
    out = of_row.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
