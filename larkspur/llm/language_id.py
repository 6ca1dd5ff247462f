"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of code points of the lower-cased text, with runs of anything but letters taken as one
space, dealt to BUCKETS by a hash. A row's value of a feature is its share of the n-grams times log((1+N)/(1+df))+1; df
is counted over all training texts. The weights are learned by follow-the-regularised-leader (FTRL-proximal) with an
elastic net, so most are exactly zero, and a temperature is then fitted on training rows that were held back.

The fit takes at most ``most_labelled`` labelled rows, those with the smallest hash of doc_id; document frequencies
and predictions take every row.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, partial_sums, slices

BUCKETS = 1 << 16
MOST_LABELLED = 8_000
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Code points up to here are looked up in a table of lower-case letters, 0x20 where there is no letter; others singly.
_PLANE = 0x30000


def _letters() -> np.ndarray:
    table = np.full(_PLANE, 0x20, np.uint32)
    for c in range(_PLANE):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low[0])
    return table


class Grams:
    """The n-grams of a batch of texts: for each its bucket, and each row's bounds."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if cls.table is None:
            cls.table = _letters()
        points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        row = np.repeat(np.arange(len(texts)), lengths)
        low = cls.table[np.minimum(points, _PLANE - 1)]
        keep = np.ones(len(low), bool)  # one space for a run of them
        keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20) | (row[1:] != row[:-1])
        low, row = low[keep].astype(np.uint64), row[keep]
        inside = low != 0x20
        found, where = [low[inside]], [row[inside]]
        for n in (2, 3):
            same = row[n - 1 :] == row[: 1 - n]
            gram = low[: 1 - n].copy()
            for i in range(1, n):
                gram |= low[i : len(low) - n + 1 + i] << np.uint64(21 * i)
            found.append(gram[same])
            where.append(row[n - 1 :][same])
        return np.concatenate(found), np.concatenate(where)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (mix(grams + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).fill_null("").to_pylist()


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in it; digits, fractions and signs in circles are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Rows, and in how many each bucket occurs. Tasks count for themselves, then counts are added up in a tree: what
    reaches the driver is 64 vectors of fixed length whatever the number of rows."""

    def count(batches):
        total, rows = np.zeros(BUCKETS), 0
        for batch in slices(batches, text, 1 << 19):
            grams, row = Grams.of(_texts(batch, text))
            distinct = np.zeros((batch.num_rows, BUCKETS), bool) if batch.num_rows <= 256 else None
            if distinct is not None:
                distinct[row, _bucket(grams)] = True
                total += distinct.sum(0)
            else:
                total += np.bincount(np.unique(row * BUCKETS + _bucket(grams)) % BUCKETS, minlength=BUCKETS)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "rows", "total"])

    parts = partial_sums(docs.select(text).mapInArrow(count, "part int, rows long, total binary")).collect()
    return sum(p["rows"] for p in parts), sum((np.frombuffer(p["total"]) for p in parts), np.zeros(BUCKETS))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # a row for each bucket: idf times the weights of the languages
    bias: np.ndarray
    temperature: float

    def odds(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        grams, row = Grams.of(texts)
        if len(grams):
            bucket, total = _bucket(grams), np.maximum(np.bincount(row, minlength=len(texts)), 1)
            for i in range(len(self.languages)):
                out[:, i] += np.bincount(row, self.weights[:, i][bucket], len(texts)) / total
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, passes: int = 3, scale: float = 60.0) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (buckets, values) rows in minibatches of 32: weights by bucket and class, and the biases.
    Values are multiplied by ``scale``, as shares of n-grams are small numbers; the weights come back for unscaled ones."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(passes):
        for block in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 32)):
            at = np.concatenate([np.append(rows[i][0], BUCKETS) for i in block])
            value = np.concatenate([np.append(rows[i][1] * scale, 1.0) for i in block])
            row = np.repeat(np.arange(len(block)), [len(rows[i][0]) + 1 for i in block])
            used, place = np.unique(at, return_inverse=True)
            w = weights(used)
            odds = np.column_stack([np.bincount(row, w[place, c] * value, len(block)) for c in range(classes)])
            error = _softmax(odds)
            error[np.arange(len(block)), y[block]] -= 1
            gradient = np.column_stack([np.bincount(place, error[row, c] * value, len(used)) for c in range(classes)])
            squared = n[used] + gradient**2
            z[used] += gradient - (np.sqrt(squared) - np.sqrt(n[used])) / alpha * w
            n[used] = squared
    all_weights = weights(slice(None))
    return all_weights[:-1] * scale, all_weights[-1]


def _temperature(odds: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the odds with the least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(odds / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", most_labelled: int = MOST_LABELLED) -> Model:
    """Learns from the text and lang of the rows where ``train`` holds and lang isn't null. Every fifth fitted row is
    held back for the temperature. Without such rows the model has no language and predicts ``und``.

    Rows are chosen by a hash of doc_id and text, so rows of one doc_id are told apart, rows with a null doc_id take
    part, and of rows equal in both and in lang one counts. Other columns are ignored, whatever their names."""
    own, body = F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit(""))
    labelled = docs.where(train & F.col(lang).isNotNull()).select(F.xxhash64(own, body, F.col(lang)).alias("row"), body.alias("text"), F.col(lang).cast("string").alias("lang"))
    n, df = document_frequency(labelled)
    if not n:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + n) / (1 + df)) + 1
    # only the keys are sorted; the texts of the chosen rows are read in a second pass and stay on the executors
    chosen = labelled.select("row").distinct().orderBy("row").limit(most_labelled)

    def shares(batches):
        for batch in slices(batches):
            grams, row = Grams.of(_texts(batch, "text"))
            bucket = _bucket(grams)
            both, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
            total = np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
            where, which = both // BUCKETS, both % BUCKETS
            value = (counts / total[where] * idf[which]).astype(np.float32)
            cut = np.searchsorted(where, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([which[a:b].astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["lang", "buckets", "shares"])

    taken = labelled.join(F.broadcast(chosen), "row").dropDuplicates(["row"])
    got = taken.select("text", "lang").mapInArrow(shares, "lang string, buckets binary, shares binary").toPandas()
    got = got.sort_values(["lang", "buckets", "shares"], kind="stable").reset_index(drop=True)
    languages = sorted(got["lang"].unique())
    y = np.searchsorted(languages, got["lang"])
    rows = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(s, np.float32).astype(float)) for b, s in zip(got["buckets"], got["shares"])]
    back = np.arange(len(rows)) % 5 == 4
    fitted = [r for r, b in zip(rows, back) if not b]
    weights, bias = ftrl(fitted, y[~back], len(languages))
    odds = np.array([bias + r[1] @ weights[r[0]] for r, b in zip(rows, back) if b]).reshape(-1, len(languages))
    return Model(languages, weights * idf[:, None], bias, _temperature(odds, y[back]))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the most probable language and its calibrated probability, ties to the first by name.
    A null text, or one without a letter, is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, limit=1 << 20):
            texts = _texts(batch, "text")
            if model.languages:
                p = _softmax(model.odds(texts) / model.temperature)
                best = p.argmax(1)
                names, score = np.array(model.languages, object)[best], p.max(1)
                none = np.array([not has_letter(t) for t in texts])
            else:
                names, score, none = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            names[none], score[none] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
