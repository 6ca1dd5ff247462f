"""Exact, near and substring deduplication and decontamination against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, exact_dedup, simhash, substring_dedup
from larkspur.llm.common import Scratch, connected

from edge_texts import EDGES


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# exact


def exact_plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("options", [{}, {"owned": 10}, {"hash_of": lambda c: F.pmod(F.xxhash64(c), F.lit(3))}])
def test_exact(docs_of, options):
    r = random.Random(1)
    texts = EDGES + [r.choice(["p", "q", "r" * 50, "s t"]) + str(r.randint(0, 30)) for _ in range(300)]
    docs = docs_of(texts, source=["x"] * len(texts)).repartition(5)
    got = sorted(tuple(x) for x in exact_dedup.exact_duplicates(docs, **options).collect())
    assert got == exact_plain(list(enumerate(texts)))
    kept = exact_dedup.deduplicate(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(g[0] for g in got if g[3])


def test_exact_is_stable_and_handles_empty(docs_of):
    docs = docs_of(["a", "b", "a"])
    once = exact_dedup.deduplicate(docs)
    assert sorted(map(tuple, exact_dedup.deduplicate(once).collect())) == sorted(map(tuple, once.collect()))
    assert exact_dedup.exact_duplicates(docs.where("false")).count() == 0 == exact_dedup.deduplicate(docs.where("false")).count()


def test_exact_repeated_rows(docs_of):
    assert [x.doc_id for x in exact_dedup.deduplicate(docs_of(["a", "a", "b"], [7, 7, 8])).orderBy("doc_id").collect()] == [7, 8]
    clash = docs_of(["a", "a", None, "", "c", "c"], [1, None, None, None, None, 5], row=list("uvwxyz"), fp=["f"] * 6, run=["r"] * 6, suspect=["s"] * 6, __sha=["t"] * 6)
    kept = exact_dedup.deduplicate(clash)
    assert kept.columns == clash.columns
    got = sorted((x.doc_id or 0, x.text or "", x["__sha"], x.suspect) for x in kept.collect())
    assert got == [(0, "", "t", "s"), (1, "a", "t", "s"), (5, "c", "t", "s")]
    found = sorted((x.doc_id or 0, x.keep_id or 0, x.group_size, x.kept) for x in exact_dedup.exact_duplicates(clash).collect())
    assert found == [(0, 0, 2, True), (0, 0, 2, True), (0, 1, 2, False), (0, 5, 2, False), (1, 1, 2, True), (5, 5, 2, True)]


@pytest.mark.parametrize("n, top", [(0, 9), (1, 9), (7, 3), (500, 2**20), (500, 2**64 - 1)])
def test_golomb_round_trip(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v)) == v).all()


def test_golomb_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    assert len(exact_dedup.golomb_encode(v)) < 7 * len(v)


@pytest.mark.parametrize("rows, owners", [(2**20, 8), (2**20, 5000), (2**20, 24_000), (2**20, 50_000), (2**17, 24_000)])
def test_messages_are_smaller_than_hashes(rows, owners):
    """Of a run of 10**11 rows: blobs, flags, and 20 bytes a message for owner, run and the bounds of both."""
    run = pa.table({"run": pa.array(np.zeros(rows, np.int64)), "fp": pa.array(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, rows))})
    sent = exact_dedup._sender(owners, exact_dedup._width(10**11))(run)
    whole = sum(map(len, sent.column("hashes").to_pylist())) + sum(map(len, sent.column("twice").to_pylist())) + 20 * sent.num_rows
    assert whole < (6 if rows == 2**20 else 9) * rows


def test_exact_suspects_are_few(docs_of):
    """A short hash makes few suspects of single texts and misses no copy; no entry stays in the catalog."""
    docs = docs_of([f"text {i}" for i in range(4000)] + [f"text {i}" for i in range(0, 4000, 40)])
    suspects = [x.row.text for x in exact_dedup.with_suspects(docs, F.col("text")).where("suspect").collect()]
    assert Counter(suspects) >= Counter({f"text {i}": 2 for i in range(0, 4000, 40)}) and len(suspects) < 220
    assert not [t.name for t in docs.sparkSession.catalog.listTables() if t.name.startswith("larkspur_rows")]


# SimHash


def components(n, linked):
    of = list(range(n))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(t, k):
    import xxhash

    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, c in counts.items() if 2 * c > len(shingles))


def test_fingerprints(docs_of):
    got = {x.doc_id: x.fp % 2**64 for x in simhash.fingerprints(docs_of(EDGES)).collect()}
    assert got == {i: plain_fingerprint(t, 3) for i, t in enumerate(EDGES)}


def test_hash_is_that_of_spark(docs_of):
    docs = docs_of(["a b c", "", "ünï"])
    for x in docs.select("text", F.xxhash64("text").alias("h")).collect():
        assert not x.text or int(simhash.shingle_hashes(x.text, 9)[0]) == x.h % 2**64


@pytest.mark.parametrize("bucket", [512, 4, 1])
def test_hamming_components(spark, bucket):
    r = random.Random(3)
    prints = []
    for base in (0, r.getrandbits(64), r.getrandbits(64)):
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            prints.append(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in simhash.hamming_components(df, bucket).collect()}
    assert got == dict(enumerate(components(len(prints), lambda i, j: ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 2)))


def test_no_rows(spark, docs_of):
    assert simhash.hamming_components(simhash.fingerprints(docs_of(["a"]).where("false"))).count() == 0
    assert simhash.drop_near_duplicates(docs_of(["a"]).where("false")).count() == 0


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1)],
        [(1, 2), (1, 3), (7, 5), (2, 1)],  # settled from the start, one edge both ways
        [(9, 1), (9, 2), (9, 3)],  # a star whose hub is the largest
        [(i, i + 1) for i in range(40)],
        [(i, 2 * i) for i in range(1, 60)],
        [(random.Random(k).randrange(300), random.Random(-k - 1).randrange(300)) for k in range(200)],
    ],
)
@pytest.mark.parametrize("batch", [10000, 3])
def test_connected(spark, edges, batch):
    """Stars are made batch by batch; with small batches several rounds are left to do."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("small", [24, 1])
def test_near_duplicates(docs_of, small):
    r = random.Random(5)
    texts = []
    for _ in range(12):  # families: an original and five copies with two words changed in 300
        w = [f"v{r.randrange(4000)}" for _ in range(300)]
        texts.append(" ".join(w))
        for _ in range(5):
            c = list(w)
            for _ in range(2):
                c[r.randrange(300)] = "changed"
            texts.append(" ".join(c))
    texts += [" ".join(f"u{r.randrange(4000)}" for _ in range(200)) for _ in range(40)] + [None, "", " "]
    docs = docs_of(texts)
    left = sorted(x.doc_id for x in simhash.drop_near_duplicates(docs, small=small).collect())
    assert left == list(range(0, 72, 6)) + list(range(72, 113))


def shingle_plain(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def near_plain(texts):
    """The smallest number of each text's component over all pairs of Jaccard similarity 0.8 or more."""
    sets, root = [shingle_plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (n := len(sets[i] & sets[j])) / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_near_duplicates_verified(docs_of):
    """Pairs around a similarity of 0.8, long and short: links are those of the shingles."""
    r = random.Random(8)
    texts = []
    for k in range(120):
        w = [f"k{k}w{i}" for i in range(r.choice([9, 24, 60, 300]))]
        c = list(w)
        for _ in range(max(1, round(len(w) * r.choice([0.015, 0.022, 0.028, 0.034])))):
            c[r.randrange(len(w))] = "changed"
        texts += [" ".join(w), " ".join(c)]
    left = sorted(x.doc_id for x in simhash.drop_near_duplicates(docs_of(texts)).collect())
    assert left == sorted(set(near_plain(texts)))


@pytest.mark.parametrize("options", [{}, {"chunk": 3000}])
def test_near_duplicates_loose_family(docs_of, options):
    """An original in mid-order with 120 copies about 0.81 alike to it and 0.68 to each other: one large bucket a key.
    Documents that share a passage only fill others."""
    r = random.Random(3)
    original = [f"v{r.randrange(9000)}" for _ in range(300)]
    texts = []
    for k in range(120):
        c = list(original)
        for p in range(r.randrange(23), 300, 52 if k % 40 else 40):
            c[p] = f"c{k}x{p}"
        texts.append(" ".join(c))
    texts.insert(60, " ".join(original))
    passage = [f"p{r.randrange(9000)}" for _ in range(200)]
    texts += [" ".join(passage + [f"o{k}x{i}" for i in range(60 + k)]) for k in range(60)]
    left = sorted(x.doc_id for x in simhash.drop_near_duplicates(docs_of(texts), **options).collect())
    plain = near_plain(texts)
    assert len(set(plain[:121])) < 5 and left == sorted(set(plain))


def test_near_duplicates_rows_of_one_id(docs_of):
    """Rows are told apart by doc_id and text, null doc_ids too; equal rows are one document."""
    w = [f"v{i}" for i in range(100)]
    a, near, other = " ".join(w), " ".join([*w[:50], "x", *w[51:]]), " ".join(f"u{i}" for i in range(100))
    docs = docs_of([a, near, other, near + " end", other, other + " end", a], [1, 2, 2, None, None, None, 1], key=list("abcdefg"), id=["x"] * 7, h=["y"] * 7, __id=["z"] * 7)
    left = sorted((x.doc_id or 0, x.text) for x in simhash.drop_near_duplicates(docs).collect())
    assert left == sorted([(1, a), (1, a), (2, other)])
    alone = docs_of([other, other + " end", None, ""], [None, None, 3, None])
    got = [(x.doc_id, x.text) for x in simhash.drop_near_duplicates(alone).collect()]
    assert len(got) == 2 and (3, None) in got and got[0][0] is None or got[1][0] is None


@pytest.mark.parametrize("small", [24, 10**6])
def test_near_duplicates_any_bucket_size(docs_of, small):
    """Loose copies of one text, 0.81 alike with it: the groups don't depend on the bucket size that is paired."""
    r = random.Random(11)
    original = [f"v{r.randrange(9000)}" for _ in range(300)]
    texts = [" ".join(original)]
    for k in range(200):
        c = list(original)
        for p in range(r.randrange(20), 300, 52):
            c[p] = f"c{k}x{p}"
        texts.append(" ".join(c))
    found = simhash.near_duplicates(docs_of(texts), small=small).collect()
    plain = near_plain(texts)
    got = {x.id: x.component_id for x in found}
    assert [got.get(i, i) for i in range(len(texts))] == plain and len(set(plain)) < 20


def test_near_duplicates_recall(docs_of):
    """Of single pairs that are 0.8 to 0.86 alike at least 0.9 are found; pairs below 0.8 never."""
    r = random.Random(12)
    texts, alike = [], []
    for k in range(300):
        n = r.choice([40, 100, 400])
        w = [f"k{k}w{i}" for i in range(n)]
        c = list(w)
        for _ in range(max(1, round(n * r.choice([0.018, 0.02, 0.022])))):
            c[r.randrange(n)] = f"c{r.random()}"
        texts += [" ".join(w), " ".join(c)]
        x, y = shingle_plain(texts[-2]), shingle_plain(texts[-1])
        alike.append(len(x & y) / len(x | y))
    found = {x.id for x in simhash.near_duplicates(docs_of(texts)).collect()}
    want = [2 * k for k, j in enumerate(alike) if 0.8 <= j < 0.86]
    assert len(want) > 100 and sum(i in found for i in want) >= 0.9 * len(want)
    assert not [k for k, j in enumerate(alike) if j < 0.8 and 2 * k in found]
    print("recall", sum(i in found for i in want) / len(want), len(want))


# substrings


def substring_plain(rows, n):
    seen = Counter(tuple(w[i : i + n]) for _, t in rows for w in [words(t)] for i in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window, anchor, batches, fan", [(35, 8, 2, 4), (35, 8, 1, 4), (10, 4, 3, 1), (6, 6, 2, 4)])
def test_substrings(docs_of, window, anchor, batches, fan):
    r = random.Random(window)
    passage = [f"p{r.randrange(50)}" for _ in range(60)]
    texts = list(EDGES)
    for i in range(60):
        w = [f"t{r.randrange(3000)}" for _ in range(r.randrange(0, 120))]
        a = r.randrange(0, 20)
        at = r.randrange(0, len(w) + 1)
        texts.append(" ".join(w[:at] + (passage[a : a + r.randrange(5, 60)] if i % 2 else []) + w[at:]))
    texts += [texts[20], texts[20], "z z z " * 30]
    docs = docs_of(texts).repartition(4)
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs, window, anchor, batches, fan).collect())
    assert got == substring_plain(list(enumerate(texts)), window)


def test_substring_ids_twice(docs_of):
    long = " ".join(f"a{i}" for i in range(40))
    docs = docs_of([long, long, "b", None], [1, 1, 1, 1], number=list("abcd"), run=list("abcd"), batch=list("abcd"))
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs).collect())
    assert got == [(1, 0, 0, ""), (1, 1, 0, "b"), (1, 40, 40, ""), (1, 40, 40, "")]
    got = [tuple(x) for x in substring_dedup.remove_repeats(docs_of([long, long + " x", long], [None, None, 2])).collect()]
    assert sorted(got, key=str) == sorted([(None, 40, 40, ""), (None, 41, 40, "x"), (2, 40, 40, "")], key=str)
    assert substring_dedup.remove_repeats(docs_of(["a"]).where("false")).count() == 0


# benchmark


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def bench_plain(rows, items, n):
    windows = defaultdict(set)
    for name, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(name)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("shard_words", [10**6, 20])
@pytest.mark.parametrize("seed", range(3))
def test_contamination(spark, docs_of, shard_words, seed):
    r = random.Random(seed)
    letters = "abcde"
    items = [(k, " ".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 9, 10, 25])))) for k in range(12)] + [(12, None), (12, "a B-c"), (None, "ünï b")]
    texts = EDGES + [" ".join(r.choice(letters + "xyz") for _ in range(r.randrange(80))) for _ in range(60)] + [items[0][1] + ", " + items[1][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs_of(texts), benchmark, 10, shard_words=shard_words)
    got = sorted(tuple(x) for x in decontaminate.report(found).collect())
    names = [("" if k is None else str(k), t) for k, t in items]
    assert got == bench_plain(list(enumerate(texts)), names, 10)


def test_decontaminate(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(15))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    body = " ".join(f"w{i}" for i in range(40))
    docs = docs_of([f"{body} {item.upper()}! End.", item, body, None, "q1 q2 q3"], source=list("abcde"))
    got = {x.doc_id: x.text for x in decontaminate.decontaminate(docs, benchmark).collect()}
    assert got == {0: f"{body} ! End.", 2: body, 3: None, 4: "q1 q2 q3"}
    same = decontaminate.decontaminate(docs, benchmark.where("false"))
    assert same.count() == 5 and same.columns == docs.columns


@pytest.mark.parametrize("shard_words", [1_000_000, 14])
def test_decontaminate_shards(spark, docs_of, shard_words):
    """Stretches of all shards count on the original text: overlaps, coverage over shards, no new neighbours."""
    w = [f"q{i}" for i in range(40)]
    items = [w[0:15], w[10:25], w[25:40]]
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    body = [f"w{i}" for i in range(40)]
    texts = [
        " ".join(body + w[0:25] + ["end"]),  # two overlapping items
        " ".join(body[:30] + w[0:15] + body[:10] + w[25:40]),  # 30 of 70 in two shards
        " ".join(body[:20] + w[0:15] + body[:4] + w[25:40]),  # 30 of 54 in two shards: gone
        " ".join(body + w[25:31] + w[0:15] + w[31:40]),  # apart in the original, neighbours after a cut
    ]
    docs = docs_of(texts, source=list("abcd"))
    out = decontaminate.decontaminate(docs, benchmark, shard_words=shard_words)
    got = {x.doc_id: x.text.split() for x in out.collect()}
    assert got == {0: [*body, "end"], 1: body[:30] + body[:10], 3: body + w[25:40]} and out.columns == docs.columns


@pytest.mark.parametrize("shard_words", [1_000_000, 14])
def test_contamination_keeps_equal_rows(spark, docs_of, shard_words):
    items = [(k, " ".join(f"q{k}x{i}" for i in range(15))) for k in range(3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs_of([items[0][1] + " and " + items[1][1]] * 2 + [None, None], ids=[7, 7, 8, 8]), benchmark, shard_words=shard_words)
    assert sorted(tuple(x) for x in found.collect()) == [(7, 31, [0, 15, 16, 31], ["0", "1"])] * 2 + [(8, 0, [], [])] * 2


def twins(n=2048):
    """Two words that every polynomial modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_contamination_of_long_words(spark, docs_of):
    one, other = twins()
    item = " ".join([*(f"q{i}" for i in range(5)), one, *(f"r{i}" for i in range(5))])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: x.n_hit for x in decontaminate.report(decontaminate.contamination(docs_of([item, item.replace(one, other)]), benchmark)).collect()}
    assert got == {0: 11, 1: 0}


def test_substrings_of_long_words(docs_of):
    one, other = twins()
    around = [[f"q{i}" for i in range(17)], [f"r{i}" for i in range(17)]]
    text = lambda w: " ".join([*around[0], w, *around[1]])
    got = {x.doc_id: x.n_removed for x in substring_dedup.remove_repeats(docs_of([text(one), text(other), "a b", text(one)])).collect()}
    assert got == {0: 35, 1: 0, 2: 0, 3: 35}


def test_substring_stretches_are_checked(docs_of, monkeypatch):
    """Stretches that the first hash takes for one are compared window by window with the second."""
    monkeypatch.setattr(substring_dedup, "_stretches", lambda by, sums, start, n, window, place: (by.between(sums, start, start + n + window - 1) if by.blind == "no" else n.astype(np.uint64)))
    plain = substring_dedup.Hashes.__init__

    def init(self, key):
        plain(self, key)
        self.checks.blind, self.grams.blind = "yes", "no"

    monkeypatch.setattr(substring_dedup.Hashes, "__init__", init)
    r = random.Random(1)
    body = [f"w{r.randrange(3000)}" for _ in range(20)]
    texts = [" ".join([f"a{k}"] * (k + 1) + body + [f"z{k // 2}x{i}" for i in range(25)]) for k in range(6)]
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs_of(texts)).collect())
    assert got == substring_plain(list(enumerate(texts)), 35)


def test_lasting_index(spark, docs_of, tmp_path):
    """Batches that are filed by several openings of an index against all that came before, over compactions."""
    r = random.Random(4)
    passages = [[f"p{k}x{r.randrange(50)}" for _ in range(45)] for k in range(6)]
    batch = lambda k: [" ".join([f"b{k}t{j}w{r.randrange(900)}" for _ in range(20)] + passages[r.randrange(6)][r.randrange(8) :] + [f"e{r.randrange(900)}"]) for j in range(8)]
    before = []
    for k in range(5):
        texts = batch(k)
        index = substring_dedup.WindowIndex(spark, fan=2, root=f"{tmp_path}/index")
        assert len(index.runs) <= 2
        history = docs_of(before, range(len(before))) if before else None
        got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs_of(texts), batches=1, index=index, history=history).collect())
        index.close()
        whole = substring_plain([(-1 - i, t) for i, t in enumerate(before)] + list(enumerate(texts)), 35)
        assert got == [x for x in whole if x[0] >= 0]
        before += texts
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs_of(["a"]), index=substring_dedup.WindowIndex(spark, root=f"{tmp_path}/index"))


def test_words_are_compared_by_their_bytes():
    """A text's word with the hash of an item's word is no hit."""
    index = decontaminate.Index([("a", [b"x%d" % i for i in range(12)])], 10)
    body = " ".join(f"x{i}" for i in range(12)).encode()
    words = lambda t: decontaminate.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    assert index.hits(words(body))[0].all()
    index.spelled[np.flatnonzero(index.vocabulary == index.key.words(np.frombuffer(b"x1", np.uint8), np.array([0]), np.array([2]))[0])[0]] = b"another"
    assert index.hits(words(body))[0].tolist() == [False] * 2 + [True] * 10


def test_long_items_are_cut(spark, docs_of):
    item = [f"q{i}" for i in range(100)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    texts = [" ".join(item[a : a + 12]) for a in range(89)] + ["q1 q2"]
    for shard_words in (10, 17, 1000):
        got = decontaminate.report(decontaminate.contamination(docs_of(texts), benchmark, shard_words=shard_words)).collect()
        assert {(x.doc_id, x.n_hit, x.n_items) for x in got} == {*((i, 12, 1) for i in range(89)), (89, 0, 0)}


def test_near_duplicates_come_by_fingerprints(spark, monkeypatch):
    """Without any shared table key the Hamming index of fingerprints alone finds copies and what is 2 or fewer bits away."""
    r = random.Random(12)
    base = [[f"w{r.randrange(3000)}" for _ in range(300)] for _ in range(40)]
    near = [[*b[:-1], "other"] for b in base[:20]]
    rows = [(i, " ".join(b)) for i, b in enumerate(base + near + base[20:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = simhash.sketches
    monkeypatch.setattr(simhash, "sketches", lambda d, k=5: real(d, k).withColumn("keys", F.array(F.xxhash64("id", "h"))))
    bits = {x.id: x.b0 & (2**64 - 1) for x in real(simhash._keyed(docs, "doc_id", "text")).collect()}
    close = {40 + i for i in range(20) if (bits[i] ^ bits[40 + i]).bit_count() <= 2}
    gone = {x.id: x.component_id for x in simhash.near_duplicates(docs).where("not stays").collect()}
    assert len(close) > 5 and set(gone) == close | set(range(60, 80))
    assert all(c == (i - 40) % 40 + 0 if i < 60 else c == i - 40 for i, c in gone.items())


def test_repeats_leave_no_tables_behind(spark, monkeypatch):
    """What a later table stands for is deleted before the last stage, the run's own index too."""
    made = []

    class Kept(Scratch):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(substring_dedup, "Scratch", Kept)
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(60)) + f" {shared}" * (i % 3 == 0)) for i in range(30)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    left = set()
    for s in made:
        fs, path = s._at(s.root)
        left |= {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
    assert left == {"documents", "windows", "doubtful"}
    assert {x.doc_id: x.n_removed for x in out.collect()} == {i: 50 * (i % 3 == 0) for i in range(30)}
