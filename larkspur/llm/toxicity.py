"""Toxicity by classifier chains.

The categories are predicted one after the other. Each is a logistic regression on the presence of words and
their stems, and from the second on also on the probabilities of the categories before. In training these are out-of-fold predictions, as
those of a model for its own training rows would be too sure. The model of a fold sees neither the labels of the fold nor words
that were chosen by them: words are chosen for each fold from the counts of the others.

The chain is fitted on the driver on at most ``most_labelled`` labelled documents, those with the smallest hash of
doc_id; every document is scored. The counts of words and categories of these documents are added up on the executors,
and the driver only gets the chosen words and which of them each document holds, so its memory is bounded whatever the
length of texts. Words are told apart by 64-bit hashes, without buckets, so a rare word of a long text doesn't fall on a
toxic one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, Rolling, Scratch, slices, utf8, word_bounds

MOST_LABELLED = 8_000
WORDS_KEPT = 600
FOLDS = 3
#: Chi-square of one degree of freedom beyond which a word is taken for informative.
SIGNIFICANT = 12.0


STEM = 4
_WORDS, _STEMS = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its first STEM characters, and each row's first entry. Short words are their own stem.
    Stems carry over to other forms of a word, which may be too rare to be learned one by one."""
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, offsets, WORD_BYTE)
    out = np.empty(2 * len(starts), np.uint64)
    out[0::2] = _WORDS.between(_WORDS.sums(low), starts, ends)
    begins = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))  # of characters
    after = begins[np.minimum(np.searchsorted(begins, starts) + STEM, len(begins) - 1)]
    out[1::2] = np.where(after < ends, _STEMS.between(_STEMS.sums(low), starts, np.minimum(after, ends)), out[0::2])
    return out, 2 * first


def label_columns() -> dict[str, Column]:
    """In the order of the chain: of what the labels say, junk text, toxic text, and text that is both."""
    junk, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"junk": junk, "toxic": toxic, "toxic_junk": junk & toxic}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Linear:
    """weights of word numbers, of the earlier categories' probabilities, and a bias."""

    words: np.ndarray
    chain: np.ndarray
    bias: float

    def odds(self, row: np.ndarray, word: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.words[word], len(earlier)) + earlier @ self.chain + self.bias


def fit_logistic(present: np.ndarray, earlier: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 12) -> Linear:
    """L2-regularised logistic regression by Newton's method. One class only: a constant."""
    n, k = present.shape
    if not n or y.min() == y.max():
        return Linear(np.zeros(k), np.zeros(earlier.shape[1]), -12.0 if not n or not y[0] else 12.0)
    x = np.column_stack([present, earlier, np.ones(n)]).astype(np.float32)
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(w):
        z = np.clip(x @ w, -35, 35)
        return np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2

    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        bend = (x * np.maximum(p * (1 - p), 1e-6).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(bend.astype(np.float64) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        was, now = now, loss(w)
        if was - now < 1e-4 * max(1.0, now):
            break
    return Linear(w[:k], w[k:-1], float(w[-1]))


def _widened(model: Linear, own: np.ndarray) -> Linear:
    words = np.zeros(len(own))
    words[own] = model.words
    return Linear(words, model.chain, model.bias)


@dataclass
class Chain:
    names: tuple[str, ...]
    vocabulary: np.ndarray
    models: list[Linear]
    thresholds: list[float]

    def predict(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        earlier = np.zeros((n, 0))
        for model in self.models:
            earlier = np.column_stack([earlier, _sigmoid(model.odds(row, word, earlier))])
        return earlier

    def present(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number) of the known words of each row, each once."""
        if not len(self.vocabulary) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        row = np.searchsorted(first, known, "right") - 1
        both = np.unique(row * len(self.vocabulary) + at[known])
        return both // len(self.vocabulary), both % len(self.vocabulary)


def _word_counts(rows: DataFrame, k: int, folds: int) -> DataFrame:
    """(word, held_f, with0_f..): in how many rows of each fold each word occurs, and in how many of each category."""
    names = ["held", *(f"with{i}" for i in range(k))]

    def count(batches):
        for batch in slices(batches, "text"):
            hashes, first = features(*utf8(batch.column(0)))
            fold, *ys = (c.to_numpy() for c in batch.columns[1:])
            marks = np.column_stack([np.ones(len(fold)), *ys])
            pairs = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
            row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
            words, number = np.unique(np.concatenate(pairs), return_inverse=True)
            cell = number * folds + fold[row]
            sums = [np.bincount(cell, marks[row, i], len(words) * folds).reshape(-1, folds) for i in range(k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(np.ascontiguousarray(x[:, f])) for x in sums for f in range(folds))], names=["word", *columns])

    columns = [f"{n}_{f}" for n in names for f in range(folds)]
    counts = rows.select("text", "fold", *(f"y{i}" for i in range(k))).mapInArrow(count, "word long, " + ", ".join(f"{c} double" for c in columns))
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def _select(counts: DataFrame, totals: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chosen words, and [fold, category, word] which of them each model may use; the last fold stands for all
    rows, each other one for the rows outside it. ``totals`` are [fold, rows and rows of each category].

    A model's words are those (of three of its documents at least) with the largest chi-square statistic for its category, of
    equals the smallest hash, ``keep`` of all categories together."""
    folds, k = totals.shape[0], totals.shape[1] - 1
    tops = []
    for out in range(folds + 1):
        inside = [f for f in range(folds) if f != out]
        n, *sums = totals[inside].sum(0).tolist()
        held = sum((F.col(f"held_{f}") for f in inside), F.lit(0.0))
        for i, c in enumerate(sums):
            both = sum((F.col(f"with{i}_{f}") for f in inside), F.lit(0.0))
            wide = F.greatest(held * (n - held) * c * (n - c), F.lit(1e-9))
            square = F.lit(n) * F.pow(both * n - held * c, F.lit(2.0)) / wide
            own = counts.where(held >= 3).select("word", square.alias("square")).where(F.col("square") >= SIGNIFICANT)
            own = own.orderBy(F.desc("square"), "word").limit(keep // k)
            tops.append(own.select("word", F.lit(out).alias("out"), F.lit(i).alias("category")))
    chosen = reduce(DataFrame.union, tops).toArrow()
    words, at = np.unique(chosen.column("word").to_numpy().view(np.uint64), return_inverse=True)
    its = np.zeros((folds + 1, k, len(words)), bool)
    its[chosen.column("out").to_numpy(), chosen.column("category").to_numpy(), at] = True
    return words, its


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on rows are taken, for the largest F1 on out-of-fold predictions, within 0.1 and 0.9."""
    grid = np.linspace(0.1, 0.9, 33)
    hit = np.array([(y * (p >= t)).sum() for t in grid])
    f1 = 2 * hit / np.maximum(np.array([(p >= t).sum() for t in grid]) + y.sum(), 1)
    good = grid[f1 >= f1.max() - 1e-9]
    return float(good[len(good) // 2]) if hit.max() > 0 else 0.5


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, most_labelled: int = MOST_LABELLED, words_kept: int = WORDS_KEPT, folds: int = FOLDS, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Null labels, and labels of documents that aren't there, are left out. Without a label every probability is near 0.

    A document with several labels is in a category that any of them puts it in. Of rows that share a doc_id the one with
    the smallest hash of its text is fitted. Rows are fitted in the order of a hash of doc_id, so neither the order of
    rows nor their partitions change the chain. Other columns are ignored, whatever their names.
    """
    categories = categories or label_columns()
    names, k = tuple(categories), len(categories)
    ys = [f"y{i}" for i in range(k)]
    marks = labels.select(F.col(doc_id).alias("id"), *(c.cast("double").alias(y) for y, c in zip(ys, categories.values()))).na.drop()
    marks = marks.groupBy("id").agg(*(F.max(y).alias(y) for y in ys))
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    chosen = own.select("id", "h").join(marks, "id").groupBy("id", *ys).agg(F.min("h").alias("h")).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    scratch = Scratch(docs.sparkSession, "labelled")
    chosen = scratch.save("chosen", chosen.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")))
    totals = np.zeros((folds, k + 1))
    for r in chosen.groupBy("fold").agg(F.count("*"), *(F.sum(y) for y in ys)).collect():
        totals[r.fold] = r[1:]
    n = int(totals[:, 0].sum())
    rows = own.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"])
    if n:
        enough = sum(F.col(f"held_{f}") for f in range(folds)) >= 3
        words, its = _select(scratch.save("counts", _word_counts(rows, k, folds).where(enough)), totals, words_kept)
    else:
        words, its = np.zeros(0, np.uint64), np.zeros((folds + 1, k, 0), bool)
    chain = Chain(names, words, [], [])

    def known(batches):
        for batch in slices(batches, "text"):
            row, word = chain.present(*features(*utf8(batch.column(0))))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = [word[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["words", *batch.schema.names[1:]])

    schema = "words binary, place long, id long, fold int, " + ", ".join(f"{y} double" for y in ys)
    got = rows.select("text", F.xxhash64("id").alias("place"), "id", "fold", *ys).mapInArrow(known, schema).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    y = np.column_stack([got.column(c).to_numpy() for c in ys])
    present = np.zeros((n, len(words)), np.float32)
    for i, found in enumerate(got.column("words").to_pylist()):
        present[i, np.frombuffer(found, np.int32)] = 1
    fold, earlier = got.column("fold").to_numpy(), np.zeros((n, 0))
    stays = its[folds].any(0)  # the words of the chain itself
    for i in range(k):
        own = its[folds, i]
        chain.models.append(_widened(fit_logistic(present[:, own], earlier, y[:, i]), own[stays]))
        outside = np.zeros(n)
        for f in range(folds):
            train, test, own = fold != f, fold == f, its[f, i]
            model = fit_logistic(present[train][:, own], earlier[train], y[train, i])
            outside[test] = present[test][:, own] @ model.words + earlier[test] @ model.chain + model.bias
        chain.thresholds.append(_threshold(_sigmoid(outside), y[:, i]))
        earlier = np.column_stack([earlier, _sigmoid(outside)])
    chain.vocabulary = words[stays]
    return chain


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, one probability for each category). Null and empty texts get the probabilities of no word."""
    names = [f"p_{n}" for n in chain.names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(1))
            hashes, first = features(raw, offsets)
            p = shared.value.predict(*shared.value.present(hashes, first), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=["doc_id", *names])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float | None = None, text: str = "text") -> DataFrame:
    """``docs``, all columns, without those whose probability of ``category`` is at least ``threshold``, by default the
    one that the chain has found for it."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), chain.names.index(category)
    limit = chain.thresholds[at] if threshold is None else threshold

    def run(batches):
        for batch in slices(batches, text):
            raw, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            hashes, first = features(raw, offsets)
            p = shared.value.predict(*shared.value.present(hashes, first), batch.num_rows)
            yield batch.filter(pa.array(p[:, at] < limit))

    return docs.mapInArrow(run, docs.schema)
