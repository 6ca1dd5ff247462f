"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. The byte lengths of its tokens give each token's character span, and an interval
join by binary search assigns spans to the sections, which tile the text. A token that crosses a boundary goes to the
section that holds most of its characters, of equals to the first. So the counts of the sections add up to the
document's count, which counts of sections encoded one by one don't.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_ENCODERS: dict[int, object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """What workers need to encode: pattern and ranks. The encoder is built once in each worker."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        self.pattern, self.ranks = pattern, ranks
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encoder(self):
        import tiktoken

        if id(self) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[id(self)] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return _ENCODERS[id(self)]


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Byte starts of the lines of a text; a line ends after its newline."""
    starts = np.append(0, np.flatnonzero(raw == 0x0A) + 1)
    return starts[starts < len(raw)]


def attribute_one(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. ``ends`` are the tokens' ends and ``starts`` the
    sections' starts, in bytes of the text."""
    char_of = np.cumsum((raw & 0xC0) != 0x80)  # number, from 1, of the character that a byte is in
    first, last = char_of[np.append(0, ends[:-1])] - 1, char_of[ends - 1]  # a token's characters are first..last-1
    bounds = np.append(char_of[starts] - 1, char_of[-1])
    a, b = np.searchsorted(bounds, first, "right") - 1, np.searchsorted(bounds, last - 1, "right") - 1
    owner, crossing = a.copy(), np.flatnonzero(a != b)
    for i in crossing:  # few
        parts = np.minimum(bounds[a[i] + 1 : b[i] + 2], last[i]) - np.maximum(bounds[a[i] : b[i] + 1], first[i])
        owner[i] = a[i] + parts.argmax()
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def attribute(docs: DataFrame, vocabulary: Vocabulary, sections: Callable[[np.ndarray], np.ndarray] = line_starts, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_sections, n_crossing, section_tokens): one row per document.

    ``sections`` gives the byte starts of the sections of a UTF-8 text, the first 0. Null and empty texts have no
    tokens and no sections.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"]

    def run(batches):
        vocabulary = shared.value
        encoder = vocabulary.encoder()
        for batch in slices(batches):
            rows = []
            for body in batch.column(1).to_pylist():
                if not body:
                    rows.append((0, 0, 0, 0, []))
                    continue
                ids = encoder.encode_to_numpy(body, disallowed_special=())
                raw = np.frombuffer(body.encode(), np.uint8)
                counts, crossing = attribute_one(raw, np.cumsum(vocabulary.lengths[ids]), sections(raw))
                rows.append((len(body), len(ids), len(counts), crossing, counts.astype(np.int32)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int32()))], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>")
