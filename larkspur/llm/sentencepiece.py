"""SentencePiece encoding and decoding in batched numpy.

A text is cut into words before each run of spaces; no piece crosses such a cut. Distinct words of a batch are encoded
once. Words of equal length advance together:

* unigram models by Viterbi: at each end position the substrings of all words and lengths are looked up by hash
  in the sorted piece keys, and the vectorised maximum of score sums is stored with its backpointer;
* byte-pair models by merges: in each round all neighbouring pairs are looked up by hash in the sorted piece keys and
  the best-scored pair of each word is joined, the first of equals. Viterbi would give other ids for such a
  model, as its scores are ranks of merges and not log probabilities. A round passes over whole words, so words of more
  than ALONE characters are merged one by one instead, with their pairs in a heap.

Characters without a piece are spelled in byte pieces where the model has them, else they are the unknown piece.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, mix, slices

SPACE = "▁"
_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_KEY = Rolling(0xC2B2AE3D27D4EB4F)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words that a worker keeps encoded; beyond, the store is emptied and filled anew.
WORDS_KEPT = 400_000
#: Characters from which on a word is merged by itself. Any value gives the same ids.
ALONE = 128


def read_model(path: str) -> "Pieces":
    """Pieces, scores and kinds of a model file, by sentencepiece's own reader of the format."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap:
        raise ValueError("models with a normalisation table aren't supported")
    spec = proto.normalizer_spec
    return Pieces([p.piece for p in proto.pieces], np.array([p.score for p in proto.pieces]), np.array([p.type for p in proto.pieces]), proto.trainer_spec.model_type == 2, spec.add_dummy_prefix, spec.remove_extra_whitespaces)


@dataclass
class Pieces:
    names: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool  # a byte-pair model
    prefix: bool = True  # a space is put before the text
    squeeze: bool = False  # runs of spaces are one, none at the ends
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self):
        usable = np.flatnonzero(np.isin(self.kinds, (NORMAL, USER)))
        points = [np.array([ord(c) for c in self.names[i]], np.uint32) for i in usable]
        keys = np.array([_KEY.between(_KEY.sums(p), np.array([0]), np.array([len(p)]))[0] for p in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a key")
        self.longest = max(map(len, points), default=1)
        self.number = {self.names[i]: int(i) for i in usable}
        # equal scores have equal places, the best is 0
        self.place = np.unique(-np.asarray(self.scores, float), return_inverse=True)[1].tolist()
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else -1
        self.bytes = np.full(256, -1)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes[int(self.names[i][3:5], 16)] = i
        self.raw = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(self.names, self.kinds)]
        self.least_score = float(self.scores[usable].min()) if len(usable) else 0.0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)

    def spelled(self, c: str) -> list[int]:
        spelled = [int(self.bytes[b]) for b in c.encode("utf-8", "replace")]
        return [self.unknown] if min(spelled) < 0 else spelled


def _sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums of every row of a matrix of equally long words."""
    n, length = points.shape
    _KEY._reach(length + 1)
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _KEY.up[:length], axis=1, out=out[:, 1:])
    return out


def _substring(sums: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Keys of the columns from each start to ``end`` of every row."""
    return mix((sums[:, end, None] - sums[:, starts]) * _KEY.down[starts] + (end - starts).astype(np.uint64))


def viterbi(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each word start, and their ids there: the segmentation with the largest sum of scores; of equal sums the shortest last
    piece. A character without a piece has id -1 and costs 10 more than the worst piece."""
    n, length = points.shape
    sums = _sums(points)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, chosen = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1)
    rows = np.arange(n)
    for end in range(1, length + 1):
        starts = np.arange(max(0, end - pieces.longest), end)[::-1]
        ids = pieces.find(_substring(sums, starts, end))
        score = np.where(ids >= 0, pieces.scores[ids], -np.inf)
        score[:, 0] = np.where(ids[:, 0] >= 0, score[:, 0], pieces.least_score - 10)
        total = best[:, starts] + score
        top = total.argmax(1)
        best[:, end], back[:, end], chosen[:, end] = total[rows, top], starts[top], ids[rows, top]
    alive, ids = np.zeros((n, length), bool), np.full((n, length), -1)
    end, active = np.full(n, length), rows
    while len(active):  # the words go back together
        start = back[active, end[active]]
        alive[active, start], ids[active, start] = True, chosen[active, end[active]]
        end[active] = start
        active = active[start > 0]
    return alive, ids


def merge(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each word start after the byte-pair merges, and their ids there, -1 for none."""
    n, length = points.shape
    sums = _sums(points)
    columns = np.arange(length)
    end = np.tile(columns + 1, (n, 1))  # of the symbol that starts here
    alive = np.ones((n, length), bool)
    rank = np.full((n, length), -np.inf)  # of the pair of the symbol that starts here and the next

    def rate(rows, starts):
        middle = end[rows, starts]
        has = middle < length
        rows, starts, middle = rows[has], starts[has], middle[has]
        stop = end[rows, middle]
        ids = pieces.find(mix((sums[rows, stop] - sums[rows, starts]) * _KEY.down[starts] + (stop - starts).astype(np.uint64)))
        rank[rows, starts] = np.where(ids >= 0, pieces.scores[ids], -np.inf)

    if length > 1:
        rows, starts = np.nonzero(alive[:, :-1])
        rate(rows, starts)
    active = np.arange(n)
    while len(active) and length > 1:
        at = rank[active].argmax(1)
        go = rank[active, at] > -np.inf
        active, at = active[go], at[go]
        if not len(active):
            break
        middle = end[active, at]
        end[active, at] = end[active, middle]
        alive[active, middle] = False
        rank[active, middle] = rank[active, at] = -np.inf
        rate(active, at)
        before = np.where(alive[active] & (columns < at[:, None]), columns, -1).max(1)
        some = before >= 0
        rank[active[some], before[some]] = -np.inf
        rate(active[some], before[some])
    rows, starts = np.nonzero(alive)
    stop = end[rows, starts]
    ids = np.full((n, length), -1)
    ids[rows, starts] = pieces.find(mix((sums[rows, stop] - sums[rows, starts]) * _KEY.down[starts] + (stop - starts).astype(np.uint64)))
    return alive, ids


def merge_alone(word: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` of one word. Its pairs wait in a heap, as the place of the score before the start, so that n characters take
    n log n steps; symbols know the end of their own and the start of the one before."""
    n, number, place, longest = len(word), pieces.number, pieces.place, pieces.longest
    end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    waiting = array("q", [-1]) * n  # place of the pair of the symbol that starts here and the next

    def rate(start: int) -> int:
        middle = end[start]
        stop = end[middle] if middle < n else 0
        piece = number.get(word[start:stop]) if 0 < stop <= start + longest else None
        waiting[start] = -1 if piece is None else place[piece]
        return waiting[start]

    heap = [rate(start) << 40 | start for start in range(n - 1)]
    heap = [pair for pair in heap if pair >= 0]
    heapify(heap)
    while heap:
        pair = heappop(heap)
        start = pair & ((1 << 40) - 1)
        if waiting[start] != pair >> 40:  # one of its symbols has been joined with another since
            continue
        middle = end[start]
        end[start], waiting[middle] = end[middle], -1
        if end[start] < n:
            before[end[start]] = start
        for changed in (start, before[start]):
            if changed >= 0 and rate(changed) >= 0:
                heappush(heap, waiting[changed] << 40 | changed)
    alive, ids, start = np.zeros(n, bool), np.full(n, -1), 0
    while start < n:
        alive[start], ids[start] = True, number.get(word[start : end[start]], -1)
        start = end[start]
    return alive, ids


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers

    def words(self, text: str) -> list[str]:
        if self.pieces.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return _CUT.findall((SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE))

    def learn(self, words: set[str]) -> None:
        """Encodes the words that aren't known yet, those of equal length together."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = list(words)
        new.sort(key=len)
        advance = merge if self.pieces.merges else viterbi
        while self.pieces.merges and new and len(new[-1]) > ALONE:
            word = new.pop()
            alive, ids = merge_alone(word, self.pieces)
            self.known[word] = self._spell(word, alive, ids) if (alive & (ids < 0)).any() else ids[alive].astype(np.int32).tobytes()
        at = 0
        while at < len(new):
            length, stop = len(new[at]), at
            most = max(1, (1 << 19) // length)
            while stop < len(new) and len(new[stop]) == length and stop - at < most:
                stop += 1
            block = new[at:stop]
            points = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(block), length)
            alive, ids = advance(points, self.pieces)
            flat = ids[alive].astype(np.int32).tobytes()
            cuts = np.append(0, np.cumsum(alive.sum(1)) * 4).tolist()
            self.known.update(zip(block, [flat[a:b] for a, b in zip(cuts, cuts[1:])]))
            for i in np.flatnonzero((alive & (ids < 0)).any(1)):
                self.known[block[i]] = self._spell(block[i], alive[i], ids[i])
            at = stop

    def _spell(self, word: str, alive: np.ndarray, ids: np.ndarray) -> bytes:
        """The ids of a word with characters that have no piece. A run of unknown ones is one piece."""
        out: list[int] = []
        for start in np.flatnonzero(alive):
            spelled = [int(ids[start])] if ids[start] >= 0 else self.pieces.spelled(word[start])
            if spelled != [self.pieces.unknown] or not out or out[-1] != self.pieces.unknown:
                out += spelled
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        self.learn({w for words in cut for w in words})
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, words)), np.int32) for words in cut]

    def decode(self, rows: list) -> list[str]:
        piece, out = self.pieces.raw.__getitem__, []
        for ids in rows:
            text = b"".join(map(piece, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
            out.append(text[1:] if self.pieces.prefix and text.startswith(" ") else text)
        return out


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", to: str = "ids", check: str | None = None) -> DataFrame:
    """``docs``, all columns, with the piece numbers of ``text`` in ``to``. Null is null; empty text has no piece.

    ``check`` names a boolean column that says whether decoding gives the text again. It is false where the text holds
    U+2581, which stands for a space. Columns of these names are replaced.
    """
    docs = docs.drop(*(c for c in (to, check) if c))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = docs.withColumn(to, F.lit(None).cast("array<int>"))
    schema = (schema.withColumn(check, F.lit(None).cast("boolean")) if check else schema).schema

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = encoder.encode([t or "" for t in texts])
            bounds = pa.array(np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
            rows = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids)))
            columns, names = [*batch.columns, rows], [*batch.schema.names, to]
            if check:
                back = encoder.decode(ids)
                columns.append(pa.array([None if t is None else t == b for t, b in zip(texts, back)], pa.bool_()))
                names.append(check)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows``, all columns, with the text of the piece numbers in ``to``. Null is null."""
    if to != ids:
        rows = rows.drop(to)
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            given = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = encoder.decode([g or [] for g in given])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if g is None else t for g, t in zip(given, texts)], pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, rows.withColumn(to, F.lit(None).cast("string")).schema)
