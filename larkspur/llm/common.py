"""What the operators of this package share: the shared folder, Arrow batches, word splitting and hashing."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a single longer text is taken alone.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; in local mode without one, a temporary folder is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="larkspur-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


class Scratch:
    """Tables of one operator run in the shared folder. They survive lost executors and go when the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs, path = self._at(self.root)
        self._fs.deleteOnExit(path)

    def _at(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.root}/{name}")[1], True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each piece has about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them. Null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if bounds is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~_SPACE
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, a-z, and all of other scripts.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_bounds(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of its first word (one entry more than rows)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    left, right = inside[:-2].copy(), inside[2:].copy()
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    left[filled] = False
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    right[last] = False
    here = inside[1:-1]
    starts, ends = np.flatnonzero(here & ~left), np.flatnonzero(here & ~right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of a sequence by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << max(10, (n - 1).bit_length())
            for name, by in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=total[1:])
        return total

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


#: A Mersenne prime; sums and powers modulo it have no weakness that all bases share.
PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)  # below it the difference wraps around


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    total = np.uint64(8) * (ah * bh) + (middle >> np.uint64(29)) + ((middle & _LOW29) << np.uint64(32)) + (low & _P) + (low >> np.uint64(61))
    return _reduced(total)


class Keyed:
    """Hashes of words and of any stretches of a sequence of hashes: polynomials modulo 2**61 - 1 at a base that is drawn
    from a key. Two different ones of n values share a hash for at most n of nearly 2**61 bases, whatever they hold."""

    def __init__(self, key: int):
        self.base = np.random.default_rng(key).integers(1 << 32, PRIME - 1, dtype=np.uint64)
        self.inverse = np.uint64(pow(int(self.base), -1, PRIME))
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        for name, by in (("up", self.base), ("down", self.inverse)):
            powers = getattr(self, name)
            while len(powers) < n:
                powers = np.concatenate([powers, mulmod(powers, np.uint64(pow(int(by), len(powers), PRIME)))])
            setattr(self, name, powers)

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes, none empty, taken seven bytes at a time with their lengths in front."""
        lanes = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
        out = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), 1 << 12):  # blocks that stay in the cache
            out[i : i + (1 << 12)] = self._words(lanes, starts[i : i + (1 << 12)], ends[i : i + (1 << 12)])
        return out

    def _words(self, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        masks = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
        out, left, at = (ends - starts).astype(np.uint64), ends - starts, starts
        active = None  # all
        for _ in range(64):
            value = lanes[at] & masks[np.minimum(left, 7)]
            now = out if active is None else out[active]
            now = _reduced(mulmod(now, self.base) + value)
            if active is None:
                out = now
            else:
                out[active] = now
            more = np.flatnonzero(left > 7)
            if not len(more):
                return mix(out)
            active, at, left = more if active is None else active[more], at[more] + 7, left[more] - 7
        for i, a in zip(active, at):  # very long words, each by itself
            place = np.arange(a, ends[i], 7)
            n = len(place)
            self._reach(n + 1)
            terms = mulmod(lanes[place] & masks[np.minimum(ends[i] - place, 7)], self.up[n - 1 :: -1] if n < len(self.up) else self.up[::-1])
            whole = (int((terms & _LOW32).sum()) + (int((terms >> np.uint64(32)).sum()) << 32)) % PRIME
            out[i] = (int(out[i]) * pow(int(self.base), n, PRIME) + whole) % PRIME
        return mix(out)

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the low and high halves of the terms; they don't overflow."""
        n = len(values)
        self._reach(n + 1)
        terms, out = mulmod(_reduced(values), self.up[:n]), []
        for half in (terms & _LOW32, terms >> np.uint64(32)):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(half, out=total[1:])
            out.append(total)
        return out[0], out[1]

    def between(self, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = (_reduced(x[ends] - x[starts]) for x in sums)
        whole = _reduced(low + mulmod(high, np.uint64(1 << 32)))
        return mix(mulmod(whole, self.down[starts]) + (ends - starts).astype(np.uint64))


#: Rows of a key from which on it is a hot one, and the most hot keys that are broadcast, those with most rows.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each key and says in ``size`` how many rows the key has. Both are
    read several times, so they should be saved tables.

    The groups of hot keys, at most ``hot_keys``, are broadcast, so rows of a hot key stay where they are. The others are
    shuffled; a key of those has less than ``hot_rows`` rows, or fewer than each of ``hot_keys`` others.
    """
    if groups.where(F.col(size) >= hot_rows).isEmpty():
        return rows.join(groups, keys)
    hot = groups.where(F.col(size) >= hot_rows).orderBy(F.desc(size), *keys).limit(hot_keys)
    names = hot.select(*keys)
    beside = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(names), keys, "left_anti").join(groups.join(F.broadcast(names), keys, "left_anti"), keys)
    return beside.unionByName(rest)


def numbered(rows: DataFrame, groups: list[str], order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows``, a saved table, with ``idx``, their numbers from 0 on in each group by ``order``, and ``n``, the group's rows.

    Rows are dealt by ranges of groups and order, so that a hot group is cut into many pieces; a row's number is its place in
    the piece and the rows of the group in the pieces before. ``groups`` hold no null; columns may be given for ``order``.
    """
    dealt = rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    held = scratch.save(name, dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__piece", F.shiftright("__at", 33))
    pieces = held.groupBy(*groups, "__piece").agg(F.min("__at").alias("__from"), F.count("*").alias("__held"))
    # a group has one row for each task here
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__held").over(whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*groups, "__piece", (before - F.col("__from")).alias("__shift"), F.sum("__held").over(whole).alias("n"))
    return held.join(pieces, [*groups, "__piece"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("idx"), "n")


def partial_sums(parts: DataFrame, width: int = 64) -> DataFrame:
    """Adds up (part int, rows long, total binary: doubles) in a tree, ``width`` arrays at a time, until one level has at
    most ``width`` rows. ``part`` is the number of the task that made an array."""

    def add(key, arrays):
        whole = sum(np.frombuffer(x.as_py()) for x in arrays.column("total"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([sum(arrays.column("rows").to_pylist())], pa.int64()), "total": pa.array([whole.tobytes()], pa.binary())})

    tasks = max(1, parts.rdd.getNumPartitions())
    while True:
        parts = parts.withColumn("lot", F.expr(f"CAST(floor(part / {width}) AS INT)")).groupBy("lot").applyInArrow(add, "part int, rows long, total binary")
        tasks = -(-tasks // width)
        if tasks <= width:
            return parts


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), u > v, of each batch as stars: every node of a batch's component with the smallest one there."""
    for batch in batches:
        u, v = (batch.column(x).to_numpy() for x in range(2))
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, label = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
        while (label[a] != label[b]).any():
            ours, theirs = label[a], label[b]
            least = np.minimum(ours, theirs)
            np.minimum.at(label, ours, least)
            np.minimum.at(label, theirs, least)
            while (label[label] != label).any():
                label = label[label]
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["u", "v"])


def _settled(pairs: DataFrame) -> bool:
    """Whether (u, v), with u > v, are stars: no u has two v or is another's v. Then each v is the smallest of its component."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(pairs.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below + above > 1 and below > 0").isEmpty()


def connected(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches. Alternates large and small stars
    (Kiveris et al., 2014) until only stars are left; each round is a table in the shared folder, whose edges are made stars
    batch by batch as they are written. The neighbours of a hub aren't brought together: hubs are joined as hot keys."""
    least = F.least(F.col(a), F.col(b)).alias("v")
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(F.col(a), F.col(b)).alias("u"), least).distinct()
    stars = lambda edges: edges.mapInArrow(_contracted, "u long, v long")
    now, last = scratch.save("cc0", stars(pairs)), "cc0"
    for turn in itertools.count(1):
        if _settled(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(f"low{turn}", both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = join_groups(both.where("v > u"), low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = scratch.save(f"down{turn}", large.where("u > v"))
        least = scratch.save(f"least{turn}", down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_groups(down, least, ["u"], "n").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        name = f"cc{turn}"
        now = scratch.save(name, stars(small.where("u > v").distinct()))
        for done in (last, f"low{turn}", f"down{turn}", f"least{turn}"):
            scratch.drop(done)
        last = name
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
