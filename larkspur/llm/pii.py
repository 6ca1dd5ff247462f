"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what they find always stays. Wider
patterns propose further spans: spelled-out addresses, defanged or hexadecimal IP addresses, numbers in other layouts.
Decoys are look-alikes that can't be personal data: dotted numbers that are no address, long digit runs that fail the
checksum, dates, prose with "at". They are never reported and only serve to learn from.

Labelers vote for, against or not at all on every candidate: a checksum or range, a gazetteer, helpful words nearby,
misleading words nearby, and units or signs that touch it. Expectation-maximisation estimates for each kind how reliable
each labeler is and how many proposals are real, from the patterns of votes over all documents: base spans count as real
and decoys as not, but for the checksum, by which both are chosen and which is learned from proposals alone. The
posteriors then train a logistic span classifier on votes, shape, length and neighbouring words of at most ``most_fitted``
proposals, base spans and decoys, those with the smallest hashes. It decides on the proposals.

Only counts of vote patterns, a bounded number, and the fitted spans' numbers reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

_AT = r" ?(?:\(at\)|\[at\]|\{at\}| at ) ?"
_DOT = r" ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])")
_HEXADECIMAL = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LAID_OUT = re.compile(r"(?<![0-9./_-])[0-9]{4}([./_]|  )[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9./_-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.(-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")

#: Helpful and misleading words within NEAR characters before a span, by kind.
NEAR = 32
_HELPS = {k: re.compile(rf"\b(?:{w})\b", re.I) for k, w in {
    "email": "e-?mail|mail|contact|write|reach|correo|courriel",
    "ip": "ip|ipv4|ipv6|host|server|address|adresse|login|from",
    "card": "card|credit|debit|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|telefon|call|mobile|cell|fax|whatsapp",
}.items()}
_MISLEADS = re.compile(r"\b(?:version|release|section|chapter|isbn|issn|doi|order|invoice|part|sku|serial|figure|page|ticket)\b", re.I)
#: Well-known endings of domains and first digits of card issuers.
_ENDINGS = frozenset("com org net edu gov mil int info biz io ai app dev co us uk de fr es it nl eu ca au ch at be jp cn br in ru mx se no dk fi pl pt example test".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35|62")

_UNIT_AFTER = re.compile(r"\s?(?:%|°|€|£|\$|(?:kg|g|km|cm|mm|ml|gb|mb|kb|ms|usd|eur|px|hz|rpm)\b)|[/_=]", re.I)
_SIGN_BEFORE = re.compile(r"(?:[#$€£=_/]|\bv|\bno\.)\s?$", re.I)

_DOTTED_OTHER = re.compile(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){1,7}(?![0-9])")
_DATE_LIKE = re.compile(r"(?<![0-9])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)(?![0-9])")
_AT_PROSE = re.compile(r"\b[A-Za-z]{1,20} at [A-Za-z]{1,20}\b")

SOUND, LISTED, HELPS, MISLEADS, TOUCHES = range(5)
LABELERS = 5
_POSITIVE, _ABSTAIN, _NEGATIVE = 2, 1, 0
#: What a candidate is: a decoy, a proposal or a base span.
DECOY, PROPOSED, BASE = range(3)
#: Buckets of shapes and of neighbouring words.
SHAPES, WORDS = 32, 64
MOST_FITTED = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping within a kind, in time linear in
    the text: no pattern is tried again from within a run that has failed."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _ANY_DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append((at, 1, at + size))
                at += size + 1
        for m in _DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PLUS.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider patterns that don't overlap a base span or an earlier proposal."""
    low = text.lower()
    found = []
    if "(at)" in low or "[at]" in low or "{at}" in low or (" at " in low and " dot " in low):
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text) if "at" in m.group().lower()]
    if "[.]" in low or "(.)" in low:
        found += [(m.start(), 1, m.end()) for m in _DEFANGED.finditer(text)]
    if low.count(":") >= 7:
        found += [(m.start(), 1, m.end()) for m in _HEXADECIMAL.finditer(text)]
    if _ANY_DIGIT.search(text):
        found += [(m.start(), 2, m.end()) for m in _LAID_OUT.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    out, taken = [], sorted((a, b) for a, _, b in base)
    i = last = 0
    for start, kind, end in sorted(found):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= last and not any(a < end for a, b in taken[i : i + 4] if b > start):
            out.append((start, kind, end))
            last = end
    return out


def decoys(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Look-alikes that overlap neither each other nor the spans ``taken``."""
    found = [(m.start(), 0, m.end()) for m in _AT_PROSE.finditer(text)] if " at " in text else []
    if _ANY_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _DOTTED_OTHER.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _DIGITS.finditer(text) if sum(map(str.isdigit, m.group())) >= 9]
        found += [(m.start(), 3, m.end()) for m in _DATE_LIKE.finditer(text)]
    busy = sorted((a, b) for a, _, b in taken)
    out, i, last = [], 0, 0
    for start, kind, end in sorted(found):
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        if start >= last and (i == len(busy) or busy[i][0] >= end):
            out.append((start, kind, end))
            last = end
    return out


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """The labelers' votes on a candidate."""
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits = re.sub("[^0-9]", "", body)
    if kind == 0:
        sound = len(body) <= 254 and not re.search(r"\.\.|^[.-]|-$", body) and bool(re.search(r"\.|dot", body, re.I))
        listed = re.split(r"[^a-z0-9]+", body.lower())[-1] in _ENDINGS
    elif kind == 1:
        sound = len(re.findall("[0-9]+", body)) == 4 and all(map(_octet, re.findall("[0-9]+", body))) if ":" not in body else True
        listed = not body.startswith(("0", "255"))
    elif kind == 2:
        sound, listed = 13 <= len(digits) <= 19 and luhn(digits), bool(_ISSUERS.match(digits))
    else:
        sound, listed = 10 <= len(digits) <= 15, digits.lstrip("0")[-10:-9] not in ("", "0", "1")
    return (
        _POSITIVE if sound else _NEGATIVE,
        _POSITIVE if listed else _NEGATIVE,
        _POSITIVE if _HELPS[KINDS[kind]].search(before) else _ABSTAIN,
        _NEGATIVE if _MISLEADS.search(before) else _ABSTAIN,
        _NEGATIVE if _UNIT_AFTER.match(after) or _SIGN_BEFORE.search(before) else _ABSTAIN,
    )


_LAST_WORD, _NEXT_WORD = re.compile(r"([^\W\d_]+)\W*$"), re.compile(r"\W*([^\W\d_]+)")


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % buckets


def described(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """(kind, the votes, length class, bucket of the shape, of the word before and of the word after; 0 for no word)."""
    start, kind, end = span
    shape = re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", text[start : min(end, start + 300)])))
    before, after = _LAST_WORD.search(text[max(0, start - NEAR) : start]), _NEXT_WORD.match(text[end : end + NEAR])
    words = [1 + _bucket(m.group(1).lower(), WORDS - 1) if m else 0 for m in (before, after)]
    return (kind, *votes(text, span), min(7, (end - start) // 6), _bucket(shape, SHAPES), *words)


@dataclass
class Model:
    """reliability[kind, labeler, class, vote], the share of real ones among proposals by kind, and the classifier's weights."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def posterior(self, kind: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The probability that proposals of these votes are real."""
        odds = np.log(self.prior[kind]) - np.log(1 - self.prior[kind])
        for i in range(LABELERS):
            odds = odds + np.log(self.reliability[kind, i, 1, seen[:, i]]) - np.log(self.reliability[kind, i, 0, seen[:, i]])
        return _sigmoid(odds)

    def probability(self, described: tuple[int, ...]) -> float:
        return float(_sigmoid(_features(np.array([described])) @ self.weights)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Where each number of a described candidate starts among the classifier's inputs.
_WIDTHS = (4, *(3,) * LABELERS, 8, SHAPES, WORDS, WORDS)
_STARTS = np.append(0, np.cumsum(_WIDTHS))


def _features(rows: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), int(_STARTS[-1])))
    for i, start in enumerate(_STARTS[:-1]):
        x[np.arange(len(rows)), start + rows[:, i]] = 1
    return x


#: How votes are set up: shares of against, none, for. They count as ten observations.
_SET_UP = {
    SOUND: ([0.55, 0.1, 0.35], [0.1, 0.05, 0.85]), LISTED: ([0.5, 0.1, 0.4], [0.15, 0.05, 0.8]), HELPS: ([0.02, 0.88, 0.1], [0.02, 0.58, 0.4]),
    MISLEADS: ([0.3, 0.68, 0.02], [0.05, 0.93, 0.02]), TOUCHES: ([0.3, 0.68, 0.02], [0.05, 0.93, 0.02]),
}


def estimate(kind: np.ndarray, seen: np.ndarray, what: np.ndarray, counts: np.ndarray, rounds: int = 60) -> Model:
    """EM over the patterns of votes. Nothing seen: votes count as they were set up."""
    model = Model(np.array([[[_SET_UP[i][c] for c in (0, 1)] for i in range(LABELERS)]] * 4), np.full(4, 0.5), np.zeros(int(_STARTS[-1])))
    if not len(kind):
        return model
    start = model.reliability.copy()
    proposed = what == PROPOSED
    for _ in range(rounds):
        real = np.where(proposed, model.posterior(kind, seen), what == BASE)
        for k in range(4):
            own = (kind == k) & proposed
            model.prior[k] = ((counts * real)[own].sum() + 2) / (counts[own].sum() + 4)
            for i in range(LABELERS):
                of = own if i == SOUND else kind == k
                for c, weight in ((1, counts * real), (0, counts * (1 - real))):
                    # a class's observations count as a thousand at most, so that rare votes of a huge class stay possible
                    mass = np.bincount(seen[of, i], weight[of], 3)
                    mass = mass * min(1.0, 1000 / max(mass.sum(), 1.0)) + 10 * start[k, i, c]
                    model.reliability[k, i, c] = mass / mass.sum()
    return model


def fit_classifier(model: Model, rows: np.ndarray, what: np.ndarray, l2: float = 1.0) -> Model:
    """The span classifier on the posteriors of ``rows`` (``described``); base spans are real, decoys aren't."""
    if not len(rows):  # the classifier says what the votes' set-up says
        kind, votes = np.meshgrid(np.arange(4), np.arange(3**LABELERS), indexing="ij")
        seen = np.stack([votes.ravel() // 3**i % 3 for i in range(LABELERS)], 1)
        rows = np.column_stack([kind.ravel(), seen, np.zeros((kind.size, 4), np.int64)])
        what = np.full(len(rows), PROPOSED)
    real = np.where(what == PROPOSED, model.posterior(rows[:, 0], rows[:, 1 : 1 + LABELERS]), what == BASE)
    x, w = _features(rows), model.weights
    for _ in range(30):
        p = _sigmoid(x @ w)
        bend = (x * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(bend, x.T @ (real - p) - l2 * w)
    return Model(model.reliability, model.prior, w)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, proposals(text, base)


def _all(text: str) -> Iterator[tuple[int, tuple[int, int, int]]]:
    base, more = candidates(text)
    yield from ((BASE, s) for s in base)
    yield from ((PROPOSED, s) for s in more)
    yield from ((DECOY, s) for s in decoys(text, base + more))


_DESCRIBED = ["kind", *(f"v{i}" for i in range(LABELERS)), "size", "shape", "before", "after"]


def fit(docs: DataFrame, text: str = "text", most_fitted: int = MOST_FITTED) -> Model:
    """Learns from the candidates of all documents: reliabilities from the counts of all vote patterns, the classifier
    from at most ``most_fitted`` candidates of each sort, those with the smallest hashes of themselves and their context,
    so neither the order of rows nor their partitions matter. Copies of a text give one candidate there."""
    scratch = Scratch(docs.sparkSession, "pii")
    names = ["what", *_DESCRIBED, "h"]

    def run(batches):
        for batch in batches:
            rows, hashes = [], []
            for body in batch.column(0).to_pylist():
                for what, span in _all(body) if body else ():
                    rows.append((what, *described(body, span)))
                    hashes.append(zlib.crc32(body[max(0, span[0] - 60) : span[2] + 60].encode("utf-8", "replace"), span[1]))
            found = np.array(rows, np.int32).reshape(-1, len(names) - 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in found.T), pa.array(hashes, pa.int64())], names=names)

    found = scratch.save("candidates", docs.select(text).mapInArrow(run, ", ".join(f"{c} int" for c in names[:-1]) + ", h long"))
    pattern = ["what", "kind", *(f"v{i}" for i in range(LABELERS))]
    got = found.groupBy(*pattern).agg(F.count("*").alias("n")).orderBy(*pattern).toPandas()
    model = estimate(got["kind"].to_numpy(), got[pattern[2:]].to_numpy(), got["what"].to_numpy(), got["n"].to_numpy().astype(float))
    chosen = [found.where(F.col("what") == w).distinct().orderBy("h", *_DESCRIBED).limit(most_fitted) for w in (DECOY, PROPOSED, BASE)]
    taken = np.concatenate([c.select("what", *_DESCRIBED).toPandas().to_numpy().astype(np.int64).reshape(-1, 1 + len(_DESCRIBED)) for c in chosen])
    return fit_classifier(model, taken[:, 1:], taken[:, 0])


def find(docs: DataFrame, model: Model, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) in code points, end exclusive, by start and then kind.
    ``added`` holds the proposals that the classifier accepts. Null and empty texts have none. Every row has its own, rows
    of a null or repeated doc_id too. Other columns of ``docs`` are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for body in batch.column(1).to_pylist():
                base, more = candidates(body) if body else ([], [])
                taken = []
                for s in more:
                    pattern = described(body, s)
                    if pattern not in known:
                        known[pattern] = model.probability(pattern) >= threshold
                    if known[pattern]:
                        taken.append(s)
                for to, spans in zip(columns, (base, taken)):
                    to.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, span) for c in columns)], names=["doc_id", "base", "added"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "array<struct<kind: string, start: int, end: int>>"
    return rows.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as a string."""
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered).alias("spans"))
