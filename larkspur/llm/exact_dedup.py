"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Rows are numbered in runs, one for each task of up to 1,048,576 rows, and written, with a 64-bit hash, to a table that
   is bucketed by run; no row leaves its task for that. Each run sorts its distinct hashes and sends them, Golomb-Rice coded,
   to the owners of hash ranges, with one flag where the run itself holds the hash twice. Hashes are cut to the leading bits
   that tell the rows there are apart but for one in 4,096: more bits would be sent without sparing a suspect.
2. An owner merges the messages of its range and answers each run with a bitmap: which of its hashes occur again. There
   are as many owners as rows demand, OWNED hashes each, so an owner's memory is bounded.
3. Bitmaps are shuffled back to their runs and joined there with the rows, which stay in their buckets.
4. Rows with a marked hash are suspects. Only their texts are shuffled, grouped by their bytes after a map-side
   combine, so that a text that a third of all rows share is one row per task.

Nothing is broadcast or collected beyond what the session's own threshold for broadcasts allows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, mix

#: Most rows of a run, as a power of two, and hashes that an owner holds. Long runs and few owners make long messages.
RUN_BITS = 20
OWNED = 1 << 22
#: Bits of a hash beyond those that number the rows: of 2**SPARE rows without a copy about one is taken for a suspect.
SPARE = 12


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def golomb_encode(sorted_values: np.ndarray) -> bytes:
    """Rice code of the gaps of ascending 64-bit values: quotients unary, remainders in k bits, k from the mean gap. In
    front are the number of values, k and the bits of the quotients, seven bits a byte."""
    if not len(sorted_values):
        return b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    mean = (int(sorted_values[-1]) // len(gaps)) or 1
    k = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    bits = np.zeros(int(ends[-1]) + k * len(gaps), np.uint8)
    bits[ends - 1] = 1
    bits[int(ends[-1]) :] = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return _varint(len(gaps)) + _varint(k) + _varint(int(ends[-1])) + np.packbits(bits).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    head, at = [0, 0, 0], 0
    for i in range(3):
        shift = 0
        while True:
            head[i] |= (blob[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if blob[at - 1] < 128:
                break
    n, k, unary = head
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), count=unary + n * k)
    quotients = np.diff(np.flatnonzero(bits[:unary]), prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        gaps |= (bits[unary:].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _runs(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a run, of which ``width`` leading bits are kept and the others zero, whether each occurs twice
    in it, and the place of each row's hash. They are mixed first, so any bits may tell rows apart."""
    kept = mix(hashes.view(np.uint64)) & np.uint64((1 << 64) - (1 << (64 - width)))
    distinct, place, counts = np.unique(kept, return_inverse=True, return_counts=True)
    return distinct, counts > 1, place


def _width(rows: int) -> int:
    """Bits of the hashes that are sent; at least 32, as owners are told by those."""
    return min(64, max(32, rows.bit_length() + SPARE))


def _owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _sender(owners: int, width: int):
    unsent = np.uint64(64 - width)

    def send(rows):
        run, (distinct, twice, _) = rows.column("run")[0], _runs(rows.column("fp").to_numpy(), width)
        cuts = np.searchsorted(_owner_of(distinct, owners), np.arange(owners + 1))
        to = np.flatnonzero(np.diff(cuts))
        hashes, flags = [], []
        for o in to.tolist():
            base = np.uint64((o << 64) // owners & ~0xFFFFFFFF)  # not above the owner's first hash
            hashes.append(golomb_encode((distinct[cuts[o] : cuts[o + 1]] - base) >> unsent))
            own = twice[cuts[o] : cuts[o + 1]]
            flags.append(np.packbits(own).tobytes() if own.any() else b"")
        return pa.table({"owner": pa.array(to, pa.int32()), "run": pa.array([run.as_py()] * len(to), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "twice": pa.array(flags, pa.binary())})

    return send


def _answer(messages):
    """For each message the bits of its hashes that occur in another message or twice in their own run."""
    parts = [golomb_decode(x) for x in messages.column("hashes").to_pylist()]
    sizes = [len(x) for x in parts]
    flags = zip(messages.column("twice").to_pylist(), sizes)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) if t else np.zeros(n, np.uint8) for t, n in flags]).astype(bool)
    flat = np.concatenate(parts)
    _, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    again = (counts > 1)[place]
    again |= np.bincount(place, weights=twice)[place] > 0
    cuts = np.append(0, np.cumsum(sizes))
    bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"run": messages.column("run"), "owner": messages.column("owner"), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _marker(width: int):
    def mark(rows, answers):
        """One row for a run: 64-bit words with a bit for each of its rows, set for a suspect."""
        _, _, place = _runs(rows.column("fp").to_numpy(), width)
        answers = answers.sort_by("owner")
        again = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist())])
        pos = rows.column("pos").to_numpy()
        words = np.zeros((int(pos.max()) >> 6) + 1, np.uint64)
        np.bitwise_or.at(words, pos >> 6, again[place].astype(np.uint64) << (pos & 63).astype(np.uint64))
        return pa.table({"run": pa.array([rows.column("run")[0].as_py()], pa.int64()), "words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})

    return mark


def with_suspects(rows: DataFrame, text: Column, hash_of=F.xxhash64, owned: int = OWNED) -> DataFrame:
    """(row, suspect): each row of ``rows`` as a struct, and whether its text may occur in another row; false only if not.

    ``hash_of`` gives the 64-bit fingerprint; any function is right, a poor one only makes more suspects. The rows are read
    from the files of the bucketed table, which stay until the session ends; its entry in the catalog goes at once.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "exact")
    name = f"larkspur_rows_{uuid.uuid4().hex}"
    number = F.monotonically_increasing_id()
    numbered = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), hash_of(text).cast("long").alias("fp"), number.alias("number"))
    numbered = numbered.select("row", "fp", F.shiftright("number", RUN_BITS).alias("run"), F.col("number").bitwiseAND(F.lit((1 << RUN_BITS) - 1)).cast("int").alias("pos"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        numbered.write.bucketBy(buckets, "run").option("path", f"{scratch.root}/rows").option("compression", "zstd").saveAsTable(name)
        kept = spark.table(name)  # knows files and buckets from here on
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    prints, held = kept.select("run", "pos", "fp"), kept.count()
    owners, width = max(buckets, -(-held // owned)), _width(held)
    sent = prints.groupBy("run").applyInArrow(_sender(owners, width), "owner int, run long, hashes binary, twice binary")
    answers = scratch.save("answers", sent.groupBy("owner").applyInArrow(_answer, "run long, owner int, n int, bits binary"))
    back = answers.select(F.col("run").alias("to"), "owner", "n", "bits")
    words = prints.groupBy("run").cogroup(back.groupBy("to")).applyInArrow(_marker(width), "run long, words array<long>")
    words = scratch.save("words", words).withColumnRenamed("run", "to")
    joined = kept.join(words.hint("shuffle_hash"), F.col("run") == F.col("to"))
    return joined.select("row", (F.expr("shiftright(words[shiftright(pos, 6)], pos & 63) & 1") == 1).alias("suspect"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, so all null and empty texts are one group. The largest
    doc_id of a group stays, a null one only if all are null. Rows that share text and doc_id are all marked kept. An empty
    table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = with_suspects(rows, F.col("text"), **options)
    scratch = Scratch(docs.sparkSession, "groups")
    found = scratch.save("found", marked.select("row.doc_id", F.unhex(F.sha2("row.text", 256)).alias("sha"), "suspect"))
    # byte verification
    same = marked.where("suspect").groupBy(F.col("row.text").alias("t")).agg(F.max("row.doc_id").alias("keep"), F.count("*").alias("size"))
    groups = scratch.save("groups", same.select(F.unhex(F.sha2("t", 256)).alias("sha"), "keep", "size"))
    grouped = join_groups(found.where("suspect"), groups, ["sha"], "size").select("doc_id", "sha", "keep", "size")
    alone = found.where("not suspect").select("doc_id", "sha", F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("size"))
    every = grouped.unionByName(alone)
    return every.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the one with the largest doc_id, once; a null doc_id
    stays only if all of its group are null. Of rows equal in text and doc_id any one stays. Columns may have any names.

    Rows that are no suspects pass without a shuffle; suspects are reduced by an aggregate over their text.
    """
    marked = with_suspects(docs, F.coalesce(F.col(text), F.lit("")), **options)
    row = F.col("row")
    order = F.struct(row[doc_id].isNotNull(), row[doc_id])
    stay = marked.where("suspect").groupBy(F.coalesce(row[text], F.lit("")).alias("t")).agg(F.max_by("row", order).alias("row"))
    return marked.where("not suspect").select("row.*").unionByName(stay.select("row.*"))
