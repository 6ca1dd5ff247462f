"""HyperMinHash, the Merkle manifest and importance resampling against plain versions, and every query against its SQL."""

import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, hyperminhash, merkle, resample
from larkspur.llm.queries import ORACLE_SQL, QUERIES

from edge_texts import EDGES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_oracles import rows_of  # noqa: E402


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# near duplicates


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def groups_plain(rows, alike=85):
    sets = [shingles(t) for _, t in rows]
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= alike * len(a | sets[j]):
                leader[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = []
    for i, (d, t) in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None]
        c = min(known) if known else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def near_texts(r, n):
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([2, 3, 8, 9, 12, 40, 150]))] for _ in range(n)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(r.choice([0, 0, 1, 3, 9])):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 15))):
                c[r.randrange(len(c))] = f"x{r.randint(0, 50)}"
            out.append(r.choice([" ", "\n", "\t "]).join(c).upper() if r.random() < 0.3 else " ".join(c))
    return out


@pytest.mark.parametrize("options", [{}, {"small": 2}, {"small": 2, "chunk": 256}])
def test_similar_sets(docs_of, options):
    r = random.Random(3)
    texts = EDGES + near_texts(r, 40) + ["same text again and again"] * 5
    hub = [f"h{i}" for i in range(60)]
    texts += [" ".join(hub[:i] + [f"z{i}"] + hub[i + 1 :]) for i in range(0, 60, 2)]
    ids = list(range(len(texts)))
    ids[20:23], ids[30] = [None] * 3, 7
    docs = docs_of(texts, ids, node=["q"] * len(texts), key=[None] * len(texts)).repartition(5)
    got = sorted((tuple(x) for x in hyperminhash.similar_sets(docs, **options).collect()), key=repr)
    assert got == groups_plain(list(zip(ids, texts)))


def test_similar_sets_of_nothing(docs_of):
    assert hyperminhash.similar_sets(docs_of([])).collect() == []
    assert [tuple(x) for x in hyperminhash.similar_sets(docs_of([None], [None])).collect()] == [(None, 0, None, True)]


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85, 0.95])
def test_registers_estimate(share):
    r, found = np.random.default_rng(7), []
    for _ in range(60):
        h = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        both, other = round(2000 * share), (2000 - round(2000 * share)) // 2
        a, b = h[: both + other], np.concatenate([h[:both], h[both + other :]])
        m, agree = hyperminhash.agreement(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert m[0] <= hyperminhash.REGISTERS
        found.append(agree[0] / m[0])
        if share >= 0.85:
            assert agree[0] >= hyperminhash.least_agreeing(0.85)[m[0]] - 1
    assert abs(np.mean(found) - share) < 0.02


def test_chance_of_agreement():
    r = np.random.default_rng(1)
    sets = [hyperminhash.registers(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1000, 1400) for _ in range(400)]
    same = sum(int(((a == b) & (a != 0)).sum()) for a in sets[:400] for b in sets[400:])
    share = same / (400 * 400 * hyperminhash.REGISTERS)
    assert 0.8 < share / hyperminhash.chance(round(2 * math.log2(1000)), round(2 * math.log2(1400))) < 1.25


def test_empty_buckets():
    assert not hyperminhash.registers(np.zeros(0, np.uint64)).any()
    assert (hyperminhash.registers(np.array([5], np.uint64)) != 0).sum() == 1


# manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def rise(nodes, f):
    """The last node, and for each first one its path as (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + f] for i in range(0, len(level), f)]
        for k, p in enumerate(paths):
            run, i = runs[at[k] // f], at[k] % f
            p.append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[k] //= f
        level = [H(*x) for x in runs]
    return level[0], paths


def manifest_plain(rows, f):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = defaultdict(list)
    for d, t, g in rows:
        of[g].append((d is not None, d or 0, H(*map(frame, (d, t, g))), H(*map(frame, (d, (t or "") + "!" if d == 3 else t, g))), d))
    names = sorted(of, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        of[g].sort(key=lambda x: x[:4])
    subs = {g: rise([x[2] for x in of[g]], f) for g in names}
    root, over = rise([subs[g][0] for g in names], f)
    out = []
    for g, top in zip(names, over):
        for x, path in zip(of[g], subs[g][1]):
            h = x[3]
            for before, after in path + top:
                h = H(before, h, after)
            out.append((x[4], x[2], subs[g][0], root, "".join(b + a for b, a in path + top), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
@pytest.mark.parametrize("langs", [["en"], ["en", None, "é", "z", "EN", "", "a b"]])
def test_manifest(docs_of, fanout, langs):
    r = random.Random(fanout)
    texts = EDGES + [f"t{i}" for i in range(40)]
    ids = list(range(len(texts)))
    ids[4:7], ids[9], texts[20], ids[20] = [None] * 3, 8, texts[19], ids[19]
    lang = [r.choice(langs) for _ in texts]
    lang[20] = lang[19]
    docs = docs_of(texts, ids, lang=lang, n=["9"] * len(texts), grp=[None] * len(texts)).repartition(3)
    fields = lambda t: [merkle.framed(c) for c in (F.col("doc_id"), t, F.col("lang"))]
    leaf = merkle.digest(fields(F.col("text")))
    again = F.when(F.col("doc_id") == 3, merkle.digest(fields(F.concat(F.coalesce("text", F.lit("")), F.lit("!"))))).otherwise(leaf)
    got = sorted((tuple(x) for x in merkle.manifest(docs, leaf, again, fanout=fanout).collect()), key=repr)
    assert got == manifest_plain(list(zip(ids, texts, lang)), fanout)
    assert sum(not x[-1] for x in got) == 1


def test_manifest_of_nothing(docs_of):
    leaf = merkle.digest([merkle.framed(F.col("doc_id"))])
    assert merkle.manifest(docs_of([], lang=[]), leaf, leaf).collect() == []


# resampling


def features_plain(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resample_plain(docs, target, percent, least, noise=None):
    of = [features_plain(t) for _, t in docs]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in target for b in features_plain(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    draw = noise or (lambda d: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296))))
    rows = [[d, len(f), sum(map(gain, f)), 0, None] for (d, _), (_, f) in zip(docs, of)]
    for x in rows:
        x[3] = x[2] + draw(x[0])
    may = sorted((x for x, (n, _) in zip(rows, of) if n >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = k + 1
    return sorted(map(repr, map(tuple, rows)))


def test_resample(docs_of):
    r = random.Random(5)
    word = lambda: r.choice(["The", "of", "näive", "x1", "a" * 47, "b" * 48, "c" * 49, "日本", f"q{r.randint(0, 99)}"])
    texts = EDGES + [r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(0, 60))) for _ in range(80)]
    ids = list(range(len(texts)))
    ids[15], ids[20] = None, 21
    target = [" ".join(word() for _ in range(30)) for _ in range(4)] + [None, ""]
    docs = docs_of(texts, ids, score=["1"] * len(texts), idx=[None] * len(texts)).repartition(4)
    for percent, least in ((5, 20), (40, 3), (100, 0)):
        got = sorted(repr(tuple(x)) for x in resample.resample(docs, docs_of(target), percent, least).collect())
        assert got == resample_plain(list(zip(ids, texts)), target, percent, least)


def test_resample_ties_and_nothing(docs_of):
    texts, zero = ["one two three"] * 7 + [None, ""], lambda c: F.lit(0).cast("long")
    got = sorted(repr(tuple(x)) for x in resample.resample(docs_of(texts), docs_of([]), 50, 1, noise=zero).collect())
    assert got == resample_plain(list(enumerate(texts)), [], 50, 1, lambda d: 0)
    assert resample.resample(docs_of([]), docs_of(["a b"])).collect() == []


@pytest.mark.parametrize("longest", [1, 3])
def test_features_over_blocks(monkeypatch, longest):
    monkeypatch.setattr(resample, "TOGETHER", 5)
    texts = ["a b c d e f g h", "", "x " * 9, "w" * 200 + " y"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    found, of, words = resample.features(raw, np.cumsum([0] + [len(t) for t in texts]), longest=longest)
    for i, t in enumerate(texts):
        n, want = features_plain(t)
        w = re.findall(r"\w+", t)
        want = want if longest == 3 else [zlib.crc32(x.encode()) % 10000 for x in w]
        assert words[i] == n and sorted(found[of == i].tolist()) == sorted(want)


# others


def test_periodic_texts_take_linear_time():
    """One word again and again, in an item and in a text: no step climbs through all suffixes."""
    item = [b"x"] * 20_000
    index = decontaminate.Index([("long", item), ("short", [b"x"] * 3), ("pair", [b"x", b"y"])], 10)
    began = time.monotonic()
    ids = [index.spelled.index(b"x")] * 200_000
    ends = sum(1 for _ in index.ends_of_hits(ids))
    assert ends == (200_000 - 9) + (200_000 - 2) and time.monotonic() - began < 10


# every query against its SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, small):
    duck = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
