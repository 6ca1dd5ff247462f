"""Substring deduplication with a log-structured index of window hashes.

A window is ``window`` consecutive words. Each window is represented by its anchor, the ANCHOR-word stretch in it with
the smallest hash (winnowing): equal windows choose equal anchors, and neighbouring windows mostly the same one, so a
text of n words has about 2n/(window-ANCHOR+2) anchors. For each the index files a row: the anchor's hash, a hash of the
whole stretch of words that its windows cover, with their place about the anchor, and where they are.

Every batch adds one immutable run, a table bucketed and sorted by anchor hash with the count and the least and
greatest stretch hash of each anchor. A new batch's run is merge-joined with the earlier runs, bucket by bucket without
a shuffle; that gives the anchors that occur again. After ``fan`` runs they are compacted into one. An index in a folder
of its own lasts: a later job opens it and files the next batch against all that came before.

Verification: windows of an anchor are equal if all its stretches are. Else the windows of those stretches are hashed one
by one and compared. Either is judged by two hashes with independent keys, each a polynomial modulo 2**61 - 1 over words
that are themselves hashed so: two different windows of n words, or words of 7 n bytes, pass for one with a chance of
(2n/2**61)**2 over the keys, whatever they hold. So an anchor alone never removes a word.

Documents are written once to a table that is bucketed by the number of their row, without a shuffle; what is found is
shuffled back to them, texts never move. Joins on hashes have one row a key on one side and leave hot keys in place, so a
passage that a third of all texts hold is neither squared nor brought to one task.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Keyed, Scratch, join_groups, mix, slices, utf8, word_bounds

WINDOW, ANCHOR, FAN, BATCHES = 35, 8, 4, 6
_SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Rows of a numbered table that lie in one bucket, and those whose finds are brought together, as powers of two.
RUN_BITS, LOT_BITS = 16, 10


class Hashes:
    """The keyed hashes of an index: ``words`` gives two for each word."""

    def __init__(self, key: int):
        self.key = key
        self.first, self.second, self.grams, self.checks = (Keyed(key + i) for i in range(4))

    def words(self, raw: np.ndarray, offsets: np.ndarray, both: bool):
        """Hashes of the words, one or two, and each row's first word."""
        starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
        found = [h.words(raw, starts, ends) for h in ((self.first, self.second) if both else (self.first,))]
        return [x & np.uint64((1 << 60) - 1) for x in found], first


def _least_before(values: np.ndarray, width: int) -> np.ndarray:
    """For each full stretch of ``width`` values the place of its smallest, of equals the first."""
    place = np.arange(len(values))
    span = 1
    while span * 2 <= width:  # doubling: place[i] is the least of values[i : i + span]
        other = place[span:]
        now = place[: len(other)]
        place = np.where(values[other] < values[now], other, now)
        span *= 2
    n = len(values) - width + 1
    a, b = place[:n], place[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int, of: Hashes):
    """Runs of windows with the same anchor: (row, anchor hash, stretch hash, first window in the row, windows, the
    anchor's place)."""
    width = window - anchor + 1
    sizes = np.diff(first)
    if not len(hashes) or sizes.max(initial=0) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = of.grams.sums(hashes)
    at = np.arange(len(hashes) - anchor + 1)
    grams = of.grams.between(sums, at, at + anchor)
    least = _least_before(grams, width)  # for each window of the whole batch
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + window <= first[row + 1]
    where = np.flatnonzero(inside)
    least, row = least[where], row[where]
    new = np.ones(len(where), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(where)))
    start = where[begin]
    place = least[begin] - start
    return row[begin], grams[least[begin]], _stretches(of.checks, of.checks.sums(hashes), start, n, window, place), start - first[row[begin]], n, place


def _stretches(by: Keyed, sums, start: np.ndarray, n: np.ndarray, window: int, place: np.ndarray) -> np.ndarray:
    """Hashes of the words that ``n`` windows from ``start`` on cover, and of the anchor's place in them."""
    with np.errstate(over="ignore"):
        return mix(by.between(sums, start, start + n + window - 1) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))


class WindowIndex:
    """Runs in a folder. ``add`` files a batch and gives the anchors that occur again.

    With ``root`` the index lasts: its runs, key and settings are found again by whoever opens the same folder, which all
    executors must share. Without it lies in the session's scratch folder.
    """

    def __init__(self, spark, window: int = WINDOW, anchor: int = ANCHOR, fan: int = FAN, root: str | None = None):
        self.spark, self.fan = spark, fan
        self.root = root or Scratch(spark, "index").root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.runs: list[tuple[str, str]] = []  # table, folder
        known = self._manifest()
        if known is None:
            key = int.from_bytes(os.urandom(6), "big")
            self.window, self.anchor, self.buckets, folders = window, anchor, int(spark.conf.get("spark.sql.shuffle.partitions")), []
        else:
            self.window, self.anchor, self.buckets, key, folders = (known[k] for k in ("window", "anchor", "buckets", "key", "runs"))
            if (self.window, self.anchor) != (window, anchor):
                raise ValueError(f"the index is one of {self.window}-word windows with anchors of {self.anchor}")
        self.hashes = Hashes(key)
        for folder in folders:
            name = f"larkspur_run_{uuid.uuid4().hex}"
            columns = "anchor BIGINT, held BIGINT, low BIGINT, high BIGINT"
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'")
            self.runs.append((name, folder))

    def _manifest(self) -> dict | None:
        """The state as of the newest manifest. Each change writes another, so a job that breaks off changes nothing."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        numbers = [int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit()]
        self.version = max(numbers, default=0)
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/manifest-{self.version}").first()[0])

    def _commit(self) -> None:
        self.version += 1
        state = {"window": self.window, "anchor": self.anchor, "buckets": self.buckets, "key": self.hashes.key, "runs": [folder for _, folder in self.runs]}
        temporary, name = self._path(f"{self.root}/new-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{self.version}")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(temporary, name):
            raise RuntimeError(f"another job has changed the index in {self.root}")

    def rows(self, docs: DataFrame) -> DataFrame:
        """(number, anchor, stretch, start, n, place) of each run of windows of (number, text)."""
        window, anchor, of = self.window, self.anchor, self.hashes

        def run(batches):
            for batch in slices(batches):
                (hashes,), first = of.words(*utf8(batch.column(1)), False)
                row, key, stretch, start, n, place = anchors(hashes, first, window, anchor, of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(place.astype(np.int16))], names=["number", "anchor", "stretch", "start", "n", "place"])

        return docs.select("number", "text").mapInArrow(run, "number long, anchor long, stretch long, start int, n short, place short")

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, folder = f"larkspur_run_{uuid.uuid4().hex}", f"run{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.root}/{folder}").saveAsTable(name)
        return name, folder

    def _merged(self, save, df: DataFrame) -> DataFrame:
        self.spark.conf.set(_SORTED_BUCKETS, "true")  # the runs are merged as they lie
        try:
            return save(df)
        finally:
            self.spark.conf.unset(_SORTED_BUCKETS)

    def add(self, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Files the rows (``rows``) of a batch as a run: (anchor, held, low, high) of those of its anchors that it holds
        more than once or that an earlier run holds."""
        own = self._write(rows.groupBy("anchor").agg(F.count("*").alias("held"), F.min("stretch").alias("low"), F.max("stretch").alias("high")))
        keys = self.spark.table(own[0])
        again = [keys.where("held > 1")]
        for table, _ in self.runs:
            old = self.spark.table(table)
            both = keys.join(old.hint("merge"), "anchor")
            again.append(both.select("anchor", (keys["held"] + old["held"]).alias("held"), F.least(keys["low"], old["low"]).alias("low"), F.greatest(keys["high"], old["high"]).alias("high")))
        found = self._merged(lambda df: scratch.save(name, df), reduce(DataFrame.union, again))
        self.runs.append(own)
        if len(self.runs) > self.fan:
            self.compact()
        else:
            self._commit()
        return found

    def compact(self) -> None:
        """Merges all runs into one."""
        old = self.runs
        keys = reduce(DataFrame.union, [self.spark.table(name) for name, _ in old])
        merged = keys.groupBy("anchor").agg(F.sum("held").alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
        self.runs = [self._merged(self._write, merged)]
        self._commit()
        for name, folder in old:
            self.spark.sql(f"DROP TABLE {name}")
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def close(self) -> None:
        """Takes the runs out of the session's catalog; their files stay."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []

    def clear(self) -> None:
        """Deletes the index with its files."""
        self.close()
        self._fs.delete(self._path(self.root), True)


class Numbered:
    """Documents in a table that is bucketed by the number of their row: no row leaves its task to be written. ``beside``
    joins what was found for rows with them; only the finds are shuffled."""

    def __init__(self, docs: DataFrame, scratch: Scratch, name: str, batches: int):
        spark = docs.sparkSession
        table = f"larkspur_rows_{uuid.uuid4().hex}"
        numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("number"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
        numbered = numbered.select("doc_id", "text", "number", F.shiftright("number", RUN_BITS).alias("run"), "batch")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbered.write.partitionBy("batch").bucketBy(buckets, "run").option("path", f"{scratch.root}/{name}").option("compression", "zstd").saveAsTable(table)
        self.rows = spark.table(table)

    def beside(self, finds: DataFrame, how: str) -> DataFrame:
        """(doc_id, text, number, finds) of the rows and of ``finds`` (number, finds)."""
        pos = F.col("number").bitwiseAND(F.lit((1 << LOT_BITS) - 1))
        lots = finds.groupBy(F.shiftright("number", LOT_BITS).alias("lot")).agg(F.map_from_entries(F.collect_list(F.struct(pos.alias("pos"), "finds"))).alias("of"))
        lots = lots.select(F.shiftright("lot", RUN_BITS - LOT_BITS).alias("of_run"), "lot", "of")
        # a lot is found among those of its run, so the rows' buckets serve for the join
        here = (F.col("run") == F.col("of_run")) & (F.shiftright("number", LOT_BITS) - F.col("lot") == 0)
        joined = self.rows.join(lots.hint("shuffle_hash"), here, how).select("doc_id", "text", "number", F.try_element_at("of", pos).alias("finds"))
        return joined.where("finds is not null") if how == "inner" else joined


def _check(texts: DataFrame, index: WindowIndex) -> DataFrame:
    """(number, start, n, same, h1, h2) of (text, number, finds): of a find whose anchor has equal stretches the anchor and
    the second hash of its stretch, of others a row for each window with its two hashes."""
    window, of = index.window, index.hashes

    def run(batches):
        for batch in slices(batches):
            (one, two), first = of.words(*utf8(batch.column(0)), True)
            found = batch.column(2)
            flat = found.flatten()
            start, n, same, place, anchor = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            start, n = start.astype(np.int64), n.astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            kinds = []
            k = np.flatnonzero(same)
            if len(k):
                kinds.append((row[k], start[k], n[k], True, anchor[k], _stretches(of.grams, of.grams.sums(two), first[row[k]] + start[k], n[k], window, place[k]).view(np.int64)))
            k = np.flatnonzero(~same)
            if len(k):
                each = np.repeat(k, n[k])
                at = start[each] + np.arange(n[k].sum()) - np.repeat(np.append(0, np.cumsum(n[k])[:-1]), n[k])
                begin = first[row[each]] + at
                h1, h2 = (h.between(h.sums(x), begin, begin + window).view(np.int64) for h, x in ((of.grams, one), (of.checks, two)))
                kinds.append((row[each], at, np.ones(len(at), np.int64), False, h1, h2))
            for rows, at, count, equal, h1, h2 in kinds:
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(np.full(len(rows), equal)), pa.array(h1), pa.array(h2)], names=["number", "start", "n", "same", "h1", "h2"])

    return texts.select("text", "number", "finds").mapInArrow(run, "number long, start int, n int, same boolean, h1 long, h2 long")


def _spans(finds: DataFrame, *more: str) -> DataFrame:
    return finds.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "n", *more))).alias("finds"))


def _repeats(sources: list[Numbered], rows: list[DataFrame], again: DataFrame, index: WindowIndex, scratch: Scratch) -> DataFrame:
    """(number, start, n) of the first source: its windows, ``n`` from ``start`` on, that occur again in any source.
    ``again`` has one row (anchor, held, same) for an anchor that occurs more than once."""
    checks = []
    for i, (source, own) in enumerate(zip(sources, rows)):
        live = scratch.save(f"live{i}", join_groups(own, again, ["anchor"], "held").select("number", "start", F.col("n").cast("int").alias("n"), "same", "place", "anchor"))
        checks.append(_check(source.beside(_spans(live, "same", "place", "anchor"), "inner"), index).withColumn("source", F.lit(i)))
    checked = scratch.save("checked", reduce(DataFrame.union, checks))
    stretches = checked.where("same").groupBy(F.col("h1").alias("anchor")).agg((F.min("h2") != F.max("h2")).alias("differ"), F.count("*").alias("held"))
    doubtful = scratch.save("doubtful", stretches.where("differ").select("anchor", "held", F.lit(False).alias("same")))
    if not doubtful.isEmpty():  # the first hash took different stretches for one: they are compared window by window
        agreed = again.join(doubtful.select("anchor"), "anchor", "left_anti").unionByName(doubtful.select("anchor", "held", "same"))
        return _repeats(sources, rows, scratch.save("agreed", agreed), index, Scratch(scratch.spark, "repeats"))
    for i in range(len(sources)):
        scratch.drop(f"live{i}")
    twice = scratch.save("twice", checked.where("not same").groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1"))
    windows = join_groups(checked.where("not same and source = 0").select("number", "start", "n", "h1", "h2"), twice, ["h1", "h2"], "c")
    return checked.where("same and source = 0").select("number", "start", "n").unionByName(windows.select("number", "start", "n"))


def _covered(first: np.ndarray, rows: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which words of a batch are inside the given windows."""
    edges = np.zeros(int(first[-1]) + 1, np.int32)
    begin = first[rows] + start
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + n + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, fan: int = FAN, doc_id: str = "doc_id", text: str = "text", index: WindowIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per document; ``kept`` has the words that stay, joined by a space.

    Every word covered by a window whose word sequence also starts anywhere else, in the same text too, goes. Windows
    are judged on the input. Null texts have no words. Rows are told apart by their place in the table: rows with one
    doc_id or a null one are documents like others, and equal rows are repeats of each other. Other columns are ignored.

    The documents are filed in ``batches`` parts, one after the other. An ``index`` that lasts holds earlier documents too:
    windows that occur there go as well, and the documents are added to it. ``history`` has the earlier documents; those
    under the anchors found are read again for the verification.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    own_index = index is None
    index = index or WindowIndex(spark, window, anchor, fan)
    if index.runs and history is None:
        raise ValueError("the index holds earlier documents: pass them as history")
    plain = lambda d: d.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sources = [Numbered(plain(docs), scratch, "documents", batches)]
    try:
        found, rows = [], []
        for i in range(batches):
            rows.append(scratch.save(f"rows{i}", index.rows(sources[0].rows.where(F.col("batch") == i))))
            found.append(index.add(rows[-1], scratch, f"again{i}"))
        again = reduce(DataFrame.union, found).groupBy("anchor").agg(F.sum("held").alias("held"), (F.min("low") == F.max("high")).alias("same"))
        again = scratch.save("anchors", again)
        for i in range(batches):
            scratch.drop(f"again{i}")
        if own_index:  # what it holds twice is known
            index.clear()
        rows = [reduce(DataFrame.union, rows)]
        if history is not None:
            sources.append(Numbered(plain(history), scratch, "history", 1))
            rows.append(index.rows(sources[1].rows).join(again.select("anchor"), "anchor", "left_semi"))
        repeats = _repeats(sources, rows, again, index, scratch)
        # what is checked and counted by now stands for what it came from
        for name in [f"rows{i}" for i in range(batches)] + ["anchors"]:
            scratch.drop(name)
        windows = scratch.save("windows", repeats)
        for name in ("checked", "twice"):
            scratch.drop(name)
    finally:
        index.close() if own_index else None
    window = index.window

    def cut(parts):
        for batch in slices(parts):
            raw, offsets = utf8(batch.column(1))
            starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
            spans = batch.column(2)
            gone = np.zeros(len(starts), bool)
            if spans.null_count < batch.num_rows:
                sizes = np.diff(spans.offsets.to_numpy())
                flat = spans.flatten()
                sizes[spans.is_null().to_numpy(zero_copy_only=False)] = 0
                gone = _covered(first, np.repeat(np.arange(batch.num_rows), sizes), flat.field(0).to_numpy(), flat.field(1).to_numpy(), window)
            removed = np.add.reduceat(np.append(gone, False), first[:-1]) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0)
            kept = []
            for i in range(batch.num_rows):
                body = raw[offsets[i] : offsets[i + 1]].tobytes()
                a, b = first[i], first[i + 1]
                if removed[i]:
                    stay = np.flatnonzero(~gone[a:b]) + a
                    body = b" ".join([body[x:y] for x, y in zip((starts[stay] - offsets[i]).tolist(), (ends[stay] - offsets[i]).tolist())])
                    kept.append(body.decode())
                else:
                    kept.append(b" ".join(body.split()).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = sources[0].beside(_spans(windows), "left").select("doc_id", "text", "finds")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
