"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every stretch of words of every item. Training words stream through it and each step gives the
longest stretch of the text, ending here, that occurs in an item. A stretch of ``window`` words, or a whole item that
has fewer, is a hit. Words are hashed batch by batch in numpy; the automaton only runs over stretches whose words
and neighbouring pairs all occur in items, as no other stretch can match. The words of such stretches are compared with
the items' words byte by byte, and an index takes a key for which no two of its words share a hash, so hits are exact.

The items are the smaller side: they are read to the driver in shards of at most SHARD_WORDS words, and each shard is
broadcast for one pass over the documents. A test set of usual size is one shard. With several, each pass adds its hit
stretches to those of the passes before, all of the original text, and what follows from them is done once at the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, Keyed, Scratch, slices, utf8, word_bounds

SHARD_WORDS = 500_000


def split_words(text: str | None) -> list[bytes]:
    """The lower-cased words of one text."""
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), WORD_BYTE)
    body = raw.tobytes()
    return [body[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Words:
    """The lower-cased words of a batch: their places in the bytes, and each row's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = LOWER[raw]
        self.starts, self.ends, self.first = word_bounds(self.raw, offsets, WORD_BYTE)

    def spelled(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


class SuffixAutomaton:
    """States of all stretches of the added sequences; a sequence is a list of small integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            p, q = last, self.next[last].get(c)
            if q is not None:  # another sequence has come this way
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                continue
            new = self._state(self.length[p] + 1, {}, 0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The state and length of the longest stretch that ends with ``c``."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(c)
        return (to, matched + 1) if to is not None else (0, 0)


class Index:
    """The automaton of a shard of items, with the windows that count as hits."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        spelled = sorted({x for _, w in items for x in w})
        for key in itertools.count(1):
            self.key = Keyed(key)
            sizes = np.array([len(x) for x in spelled], np.int64)
            ends = np.cumsum(sizes)
            hashes = self.key.words(np.frombuffer(b"".join(spelled), np.uint8), ends - sizes, ends)
            if len(np.unique(hashes)) == len(spelled):
                break
        order = np.argsort(hashes)
        self.vocabulary, self.spelled = hashes[order], [spelled[i] for i in order]
        place = {x: i for i, x in enumerate(self.spelled)}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        words = [(number[name], [place[x] for x in w]) for name, w in items]
        self.least = min((min(len(w), window) for _, w in words), default=window)
        pairs = [a * len(self.vocabulary) + b for _, w in words for a, b in zip(w, w[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.automaton = sam = SuffixAutomaton()
        for _, w in words:
            sam.add(w)
        #: items that hold a stretch of a state, for states where a window can end; and states that are a whole short item
        self.holders: dict[int, set[int]] = {}
        self.whole: dict[int, dict[int, set[int]]] = {}
        for item, w in words:
            state = 0
            for c in w:
                state = sam.next[state][c]
                up = state
                while up > 0 and sam.length[up] >= window and item not in self.holders.setdefault(up, set()):
                    self.holders[up].add(item)
                    up = sam.link[up]
            if len(w) < window:
                while sam.length[sam.link[state]] >= len(w):
                    state = sam.link[state]
                self.whole.setdefault(state, {}).setdefault(len(w), set()).add(item)
        #: of each state the last one on the way up with a window's words, and the next one, itself included, that is a whole short item
        self.widest, self.short = list(range(len(sam.link))), [0] * len(sam.link)
        for state in sorted(range(1, len(sam.link)), key=sam.length.__getitem__):
            up = sam.link[state]
            self.short[state] = state if state in self.whole else self.short[up]
            if sam.length[up] >= window:
                self.widest[state] = self.widest[up]

    def ends_of_hits(self, ids: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(position of the last word, length, items) of every window in a stretch of words."""
        sam, state, matched = self.automaton, 0, 0
        for i, c in enumerate(ids):
            state, matched = sam.step(state, matched, c)
            if matched >= self.window:
                yield i, self.window, self.holders[self.widest[state]]
            up = self.short[state]
            while up > 0:
                for length, items in self.whole[up].items():
                    if length <= matched:
                        yield i, length, items
                up = self.short[sam.link[up]]

    def _read(self, words: Words, ids: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts of the stretch of words a..b that are spelled as the vocabulary says."""
        for i in range(a, b):
            if words.spelled(i) != self.spelled[ids[i]]:
                yield a, i
                a = i + 1
        yield a, b

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of a batch are inside a window, and the items found in each row."""
        first, n = words.first, len(words.starts)
        hit, found = np.zeros(n + 1, np.int32), {}
        if not n or not len(self.vocabulary):
            return hit[:-1] > 0, found
        hashes = self.key.words(words.raw, words.starts, words.ends)
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        joined = np.zeros(n, bool)  # the word goes on from the one before
        if len(self.pairs) and n > 1:
            pair = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = known[:-1] & known[1:] & (self.pairs[at] == pair)
        joined[first[:-1][first[:-1] < n]] = False
        starts = np.flatnonzero(~joined)
        ends = np.append(starts[1:], n)
        long = (ends - starts >= self.least) & known[starts]
        for stretch in zip(starts[long].tolist(), ends[long].tolist()):
            row = -1
            for a, b in self._read(words, ids, *stretch):
                for end, length, items in self.ends_of_hits(ids[a:b].tolist()):
                    if row < 0:
                        row = int(np.searchsorted(first, a, "right")) - 1
                    hit[a + end - length + 1] += 1
                    hit[a + end + 1] -= 1
                    found.setdefault(row, set()).update(items)
        return np.cumsum(hit[:-1]) > 0, found


def shards(benchmark: DataFrame, window: int, text: str = "text", item_id: str = "item_id", shard_words: int = SHARD_WORDS) -> Iterator[Index]:
    """Items of null text, or without a word, have no window. A null item_id is the empty name. An item of more than
    ``shard_words`` words is taken in pieces that overlap by all but one word of a window, so a shard is bounded."""
    items: list[tuple[str, list[bytes]]] = []
    size, most = 0, max(shard_words, window)
    for name, body in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        words = split_words(body)
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            piece = words[at : at + most]
            if piece:
                items.append((name, piece))
                size += len(piece)
            if size >= shard_words:
                yield Index(items, window)
                items, size = [], 0
    if items:
        yield Index(items, window)


def _scan(rows: DataFrame, shared, keep_text: bool) -> DataFrame:
    """``rows`` (doc_id, text, spans, items) with this shard's stretches and items added, and n_words."""
    fields = [("doc_id", pa.int64()), *([("text", pa.string())] if keep_text else []), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
    schema = pa.schema(fields)

    def run(batches):
        index: Index = shared.value
        for batch in slices(batches):
            words = Words(*utf8(batch.column(1)))
            first, (hit, found) = words.first, index.hits(words)
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, names in found.items():
                own = np.flatnonzero(np.diff(hit[first[row] : first[row + 1]].astype(np.int8), prepend=0, append=0)).tolist()
                spans[row] = _union([spans[row], own])
                items[row] = list({*items[row], *(index.names[i] for i in names)})
            text = [batch.column(1)] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *text, pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], schema=schema)

    text = "text string, " if keep_text else ""
    return rows.select("doc_id", "text", "spans", "items").mapInArrow(run, f"doc_id long, {text}n_words long, spans array<int>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (first and next word number of each hit stretch, flat, ascending),
    items (sorted, distinct). Null and empty texts have no words; an empty benchmark hits nothing. Each row stays, equal
    ones too."""
    spark, scratch = docs.sparkSession, None
    empty = [F.array().cast(f"array<{kind}>").alias(name) for kind, name in (("int", "spans"), ("string", "items"))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *empty)
    for k, (index, last) in enumerate(_with_last(shards(benchmark, window, shard_words=shard_words))):
        rows = _scan(rows, spark.sparkContext.broadcast(index), not last)
        if not last:  # so that a task holds one index at a time
            scratch = scratch or Scratch(spark, "contamination")
            rows = scratch.save(f"shard{k}", rows)
            if k:
                scratch.drop(f"shard{k - 1}")
    if "n_words" not in rows.columns:
        rows = _scan(rows, spark.sparkContext.broadcast(Index([], window)), False)
    return rows.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"))


def _with_last(found: Iterator[Index]) -> Iterator[tuple[Index, bool]]:
    """Each index, and whether it's the last."""
    now = next(found, None)
    while now is not None:
        after = next(found, None)
        yield now, after is None
        now = after


def _union(lists: list[list[int]]) -> list[int]:
    """One ascending list of disjoint stretches from several."""
    out: list[int] = []
    for a, b in sorted((s[i], s[i + 1]) for s in lists for i in range(0, len(s), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the rows of ``contamination``."""
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    counted = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return counted.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs``, all columns, without what they share with the items.

    Stretches of hit words are cut out of the text, from the first word's start to the last word's end. A document of
    which more than ``most_coverage`` of the words are hit goes. Texts without a hit, null ones too, stay unchanged.
    """
    spark, scratch, columns = docs.sparkSession, None, docs.columns
    for k, (index, last) in enumerate(_with_last(shards(benchmark, window, shard_words=shard_words))):
        shared = spark.sparkContext.broadcast(index)
        if not last and not k:
            docs = docs.withColumn(_HITS, F.array().cast("array<int>"))
        docs = docs.mapInArrow(_cutter(shared, text, most_coverage) if last else _marker(shared, text), docs.schema)
        if not last:  # so that a task holds one index at a time
            scratch = scratch or Scratch(spark, "decontaminate")
            docs = scratch.save(f"shard{k}", docs)
            if k:
                scratch.drop(f"shard{k - 1}")
    return docs.select(*columns) if scratch else docs


#: Stretches of word numbers that the shards before have hit.
_HITS = "__hits"


def _marker(shared, text: str):
    """Adds a shard's stretches to those of the shards before."""

    def run(batches):
        for batch in slices(batches, text):
            place = batch.schema.get_field_index(_HITS)
            words = Words(*utf8(batch.column(batch.schema.get_field_index(text))))
            first, (hit, found) = words.first, shared.value.hits(words)
            spans = batch.column(place).to_pylist()
            for row in found:
                own = np.flatnonzero(np.diff(hit[first[row] : first[row + 1]].astype(np.int8), prepend=0, append=0)).tolist()
                spans[row] = _union([spans[row], own])
            columns = [pa.array(spans, c.type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _cutter(shared, text: str, most_coverage: float):
    """Cuts what the last shard and those before it have hit."""

    def run(batches):
        for batch in slices(batches, text):
            place, before = batch.schema.get_field_index(text), batch.schema.get_field_index(_HITS)
            raw, offsets = utf8(batch.column(place))
            words = Words(raw, offsets)
            starts, ends, first = words.starts, words.ends, words.first
            hit, found = shared.value.hits(words)
            rows = set(found)
            for row, spans in enumerate(batch.column(before).to_pylist() if before >= 0 else ()):
                for a, b in zip(spans[::2], spans[1::2]):
                    hit[first[row] + a : first[row] + b] = True
                    rows.add(row)
            if not rows:
                yield batch
                continue
            texts, keep = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
            for row in rows:
                own = hit[first[row] : first[row + 1]]
                keep[row] = own.mean() <= most_coverage
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) + first[row]
                body, at, parts = texts[row].encode(), 0, []
                for a, b in zip(edges[::2], edges[1::2]):
                    parts.append(body[at : starts[a] - offsets[row]])
                    at = ends[b - 1] - offsets[row]
                texts[row] = b"".join([*parts, body[at:]]).decode()
            columns = [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return run
