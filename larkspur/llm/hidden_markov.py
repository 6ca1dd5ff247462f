"""A hidden Markov language model over words.

Words are the emissions by way of classes: the TOP most frequent training words and the end of a text are classes of
their own, all other words fall into SHAPES classes by their ending. P(word | state) = P(class | state) * P(word | class),
with P(word | class) = (c+1)/(N+V+1) over the class's training tokens, one share being left for words not seen in
training. So the states have a bounded number of parameters while counts cover every training token.

1. One pass over the texts encodes them by chunk: each task numbers the words that it meets and writes the numbers
   and its dictionary, with training counts. Dictionaries, not tokens, are shuffled to add up the counts of words.
2. Each chunk gets the totals of its own dictionary back; no vocabulary is ever broadcast.
3. Baum-Welch: each task adds up expected counts over its texts, tasks are added up in a tree, and the driver sees at
   most 64 arrays of fixed length. The first states come from a few rounds over a bounded sample; then ROUNDS
   rounds run over all training texts.
4. Scaled forward recursion gives each whole text's exact probability under the model.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, partial_sums, slices

STATES, ROUNDS = 6, 4
TOP, SHAPES = 2048, 512
#: Texts of the sample that the first states are drawn from, and rounds over it.
SAMPLE, SAMPLE_ROUNDS = 600, 15
CHUNK_TOKENS, CHUNK_WORDS = 6_000_000, 500_000
#: Tokens of texts that are brought into the order of their lengths together, and that advance together.
SORTED_TOKENS, STEP_TOKENS = 4_000_000, 300_000
_END = 0


def _pack(ids: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(ids) else b""


def _unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def encode(docs: DataFrame) -> DataFrame:
    """From (doc_id, text, held_out): rows of texts (chunk, doc_ids, held, sizes, ids) and, one for each chunk, rows of
    dictionaries (chunk, words, counts). A chunk's name is random; a task that runs again makes new ones."""
    names = ["chunk", "doc_ids", "held", "sizes", "ids", "words", "counts"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def run(batches):
        chunk, numbers, tokens = None, {}, 0
        counts = np.zeros(0, np.int64)

        def dictionary():
            words = pa.array(list(numbers), pa.binary()).cast(pa.string())
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(counts))]
            return pa.RecordBatch.from_arrays([pa.array([chunk], types[0]), *(pa.nulls(1, t) for t in types[1:5]), *whole], names=names)

        for batch in slices(batches):
            if chunk is None:
                chunk = int.from_bytes(os.urandom(8), "little", signed=True)
            number = numbers.setdefault
            texts = batch.column(1).to_pylist()
            held = batch.column(2).to_numpy(zero_copy_only=False)
            ids = [np.array([number(w, len(numbers)) for w in t.encode().lower().split()] if t else [], np.int64) for t in texts]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            train = flat[np.repeat(~held, sizes)]
            counts = np.concatenate([counts, np.zeros(len(numbers) - len(counts), np.int64)]) + np.bincount(train, minlength=len(numbers))
            tokens += len(flat)
            yield row(chunk, batch.column(0).to_pylist(), held, sizes, _pack(flat), None, None)
            if tokens >= CHUNK_TOKENS or len(numbers) >= CHUNK_WORDS:
                yield dictionary()
                chunk, numbers, tokens, counts = None, {}, 0, np.zeros(0, np.int64)
        if chunk is not None:
            yield dictionary()

    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, words array<string>, counts array<long>")


@dataclass
class Counts:
    """What the corpus gives: tokens and distinct tokens of training, ends included, and of each class."""

    tokens: int
    distinct: int
    ends: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.class_tokens)


@dataclass
class Model:
    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # state by class

    @classmethod
    def start(cls, counts: Counts, states: int) -> "Model":
        noise = np.random.default_rng(11).normal(0, 1, (states, counts.classes))
        emit = _unigram(counts) * np.exp(noise)
        move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def learned(self, total: np.ndarray, counts: Counts) -> "Model":
        """The model of expected counts, laid out as in ``expect``, with a prior of the corpus's own class shares."""
        k, c = self.emit.shape
        first, move, emit = total[:k] + 1, total[k : k + k * k].reshape(k, k) + 1, total[k + k * k :].reshape(k, c)
        emit = emit + 50 * _unigram(counts)
        return Model(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _unigram(counts: Counts) -> np.ndarray:
    share = counts.class_tokens + 0.5
    return share / share.sum()


def _layout(texts: list[np.ndarray]):
    """Time-major order of texts of falling length: the emissions, and where each time step starts."""
    sizes = np.array([len(t) for t in texts])
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts longer than t
    starts = np.append(0, np.cumsum(active))
    time = np.concatenate([np.arange(n) for n in sizes])
    where = starts[time] + np.repeat(np.arange(len(texts)), sizes)
    flat = np.zeros(len(time), np.int64)
    flat[where] = np.concatenate(texts)
    return flat, starts


def forward(model: Model, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, the scales, and the emission probabilities, all time-major."""
    seen = model.emit.T[flat]
    alpha, scale = np.empty_like(seen), np.empty(len(flat))
    a = model.first * seen[: starts[1]]
    for t in range(len(starts) - 1):
        i, j = starts[t], starts[t + 1]
        if t:
            a = a[: j - i] @ model.move
            a *= seen[i:j]
        s = a.sum(1)
        a /= s[:, None]
        alpha[i:j], scale[i:j] = a, s
    return alpha, scale, seen


def likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each text's probability; texts of falling length, one token at least."""
    flat, starts = _layout(texts)
    _, scale, _ = forward(model, flat, starts)
    text = np.concatenate([np.arange(n) for n in np.diff(starts)])
    return np.bincount(text, np.log(scale), len(texts))


def expect(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Expected counts of first states, moves and emissions, and at the end the log likelihood."""
    flat, starts = _layout(texts)
    alpha, scale, seen = forward(model, flat, starts)
    k, c = model.emit.shape
    gamma, move = np.empty_like(alpha), np.zeros((k, k))
    seen /= scale[:, None]
    last = len(starts) - 2
    beta = np.ones((starts[last + 1] - starts[last], k))
    gamma[starts[last] :] = alpha[starts[last] :]
    for t in range(last - 1, -1, -1):
        i, j, n = starts[t], starts[t + 1], starts[t + 2] - starts[t + 1]
        ahead = seen[j : j + n] * beta
        move += alpha[i : i + n].T @ ahead
        beta = np.ones((j - i, k))
        beta[:n] = ahead @ model.move.T
        gamma[i:j] = alpha[i:j] * beta
    emitted = [np.bincount(flat, gamma[:, s], c) for s in range(k)]
    return np.concatenate([gamma[: starts[1]].sum(0), (move * model.move).ravel(), *emitted, [np.log(scale).sum()]])


def _stretches(texts: list[np.ndarray]):
    """Numbers of texts by falling length, in lots of about STEP_TOKENS tokens."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    lot = np.cumsum(sizes[order]) // STEP_TOKENS
    return np.split(order, np.flatnonzero(np.diff(lot)) + 1)


def _gathered(batches, limit: int = SORTED_TOKENS):
    """Batches joined until they hold ``limit`` tokens: (table, list of class sequences)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index("classes")).nbytes // 2
        if size >= limit:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    whole = pa.Table.from_batches(held)
    return whole, [np.frombuffer(x, np.uint16).astype(np.int64) for x in whole.column("classes").to_pylist()]


def sum_by_task(rows: DataFrame, function, length: int) -> np.ndarray:
    """Sum of ``function`` (texts -> array of ``length``) over all rows. Arrays are added within a task, then in a tree
    over the tasks; at most 64 arrays reach the driver."""

    def run(batches):
        total, n = np.zeros(length), 0
        for table, texts in _gathered(batches):
            for lot in _stretches(texts):
                total += function([texts[i] for i in lot])
            n += table.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "rows", "total"])

    parts = partial_sums(rows.select("classes").mapInArrow(run, "part int, rows long, total binary"))
    return sum((np.frombuffer(x["total"]) for x in parts.toLocalIterator()), np.zeros(length))


class HiddenMarkov:
    """``prepare`` counts and encodes the documents, ``train`` learns the states, ``score`` gives probabilities.

    Null and empty texts are a single end. Without training texts all counts are zero and the states are equal. Every row
    has a score of its own: rows with a null or a repeated doc_id too, as nothing is joined by it. Other columns of
    ``docs`` are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS, top: int = TOP, shapes: int = SHAPES, doc_id: str = "doc_id", text: str = "text"):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
        self.states, self.rounds, self.top, self.shapes = states, rounds, top, shapes
        self.scratch = Scratch(docs.sparkSession, "hmm")

    def prepare(self) -> None:
        encoded = self.scratch.save("encoded", encode(self.docs))
        texts = encoded.where("words is null").select("chunk", "doc_ids", "held", "sizes", "ids")
        entries = encoded.where("words is not null").select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "e")).select("chunk", "number", F.col("e.words").alias("word"), F.col("e.counts").alias("own"))
        shape = F.pmod(F.xxhash64(F.substring("word", -2, 2)), F.lit(self.shapes)).cast("int")
        # counts are combined before the shuffle; words of many chunks are joined where they are
        counted = entries.groupBy("word").agg(F.sum("own").alias("c"), F.count("*").alias("chunks"))
        # only frequent words are named, for the choice of the top ones
        counted = self.scratch.save("counted", counted.select("word", "c", "chunks", shape.alias("shape"), F.when(F.col("c") >= 20, F.xxhash64("word")).alias("name")))
        leaders = counted.where("c > 0")
        best = leaders.where("name is not null").orderBy(F.desc("c"), "name").limit(self.top).select("name", "c", "shape").collect()
        spark = self.docs.sparkSession
        tops = spark.createDataFrame([(r.name, i + 1) for i, r in enumerate(best)], "name long, top int")
        ends = encoded.where("words is null").agg(F.sum(F.expr("size(filter(held, x -> not x))"))).first()[0] or 0
        sums = {r.shape: r for r in leaders.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
        class_tokens, class_distinct = np.zeros(1 + self.top + self.shapes), np.zeros(1 + self.top + self.shapes)
        class_tokens[_END], class_distinct[_END] = ends, ends > 0
        for s, r in sums.items():
            class_tokens[1 + self.top + s], class_distinct[1 + self.top + s] = r.n, r.v
        tokens, distinct = int(class_tokens.sum()), int(class_distinct.sum())
        for i, r in enumerate(best):
            class_tokens[1 + i], class_distinct[1 + i] = r.c, 1
            class_tokens[1 + self.top + r.shape] -= r.c
            class_distinct[1 + self.top + r.shape] -= 1
        self.counts = counts = Counts(tokens, distinct, int(ends), class_tokens, class_distinct)
        classes = counted.join(F.broadcast(tops), "name", "left").select("word", "chunks", "c", F.coalesce("top", F.col("shape") + 1 + self.top).alias("class"))
        classed = join_groups(entries.select("chunk", "number", "word"), classes, ["word"], "chunks", hot_keys=20_000).select(F.col("chunk").alias("own"), "number", "c", "class")
        first_shape = 1 + self.top

        def attach(blocks, words):
            n = words.num_rows
            c, of = np.zeros(n, np.int64), np.zeros(n, np.int64)
            at = words.column("number").to_numpy()
            c[at], of[at] = words.column("c").to_numpy(), words.column("class").to_numpy()
            room = counts.class_tokens[of] + counts.class_distinct[of] + 1
            inside = np.where(of < first_shape, 0.0, np.log10((c + 1) / room))
            smooth, known, of = np.log10(c + 1.0), c > 0, of.astype(np.uint16)
            end = (np.log10(counts.ends + 1.0), counts.ends > 0)
            done = []
            for k in range(blocks.num_rows):
                docs, held, sizes = (blocks.column(x)[k].values for x in ("doc_ids", "held", "sizes"))
                sizes = sizes.to_numpy()
                flat, to = _unpack(blocks.column("ids")[k].as_py(), int(sizes.sum())), np.append(0, np.cumsum(sizes))
                sums = [np.append(0, np.cumsum(x[flat])) for x in (smooth, known, inside)]
                base, seen, within = (x[to[1:]] - x[to[:-1]] for x in sums)
                all_of = of[flat]
                classes = pa.array([np.append(all_of[a:b], np.uint16(_END)).tobytes() for a, b in zip(to, to[1:])], pa.binary())
                base = base + end[0] - (sizes + 1) * np.log10(counts.tokens + counts.distinct + 1)
                done.append(pa.RecordBatch.from_arrays([docs, held, pa.array(sizes + 1, pa.int64()), pa.array(seen + end[1], pa.int64()), pa.array(base), pa.array(within), classes], schema=ready))
            return pa.Table.from_batches(done, ready)

        ready = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("classes", pa.binary())])
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
        self.ready = self.scratch.save("ready", texts.groupBy("chunk").cogroup(classed.groupBy("own")).applyInArrow(attach, schema))
        self.scratch.drop("encoded")
        self.scratch.drop("counted")

    def train(self) -> Model:
        counts, train = self.counts, self.ready.where("not held_out")
        model = Model.start(counts, self.states)
        sample = [np.frombuffer(r.classes, np.uint16).astype(np.int64) for r in train.select("classes", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(SAMPLE).collect()]
        self.likelihoods = []
        for _ in range(SAMPLE_ROUNDS if sample else 0):
            total = sum(expect(model, [sample[i] for i in lot]) for lot in _stretches(sample))
            model = model.learned(total[:-1], counts)
        length = self.states * (1 + self.states + counts.classes) + 1
        for _ in range(self.rounds if sample else 0):
            shared = self.docs.sparkSession.sparkContext.broadcast(model)
            total = sum_by_task(train, lambda texts: expect(shared.value, texts), length)
            self.likelihoods.append(float(total[-1]))
            model = model.learned(total[:-1], counts)
        return model

    def score(self, model: Model) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
        shared = self.docs.sparkSession.sparkContext.broadcast(model)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

        def run(batches):
            for table, texts in _gathered(batches):
                score = np.zeros(len(texts))
                for lot in _stretches(texts):
                    score[lot] = likelihood(shared.value, [texts[i] for i in lot]) / np.log(10)
                score += table.column("within").to_numpy()
                whole = table.select(names).append_column("score", pa.array(score))
                yield from whole.to_batches()

        found = self.ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
