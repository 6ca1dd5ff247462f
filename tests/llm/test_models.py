"""Token counts, pieces, personal data, language, toxicity and the language model."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hidden_markov, language_id, pii, sentencepiece, token_counts, toxicity
from larkspur.llm.queries import PATTERN, TOKENIZERS

from edge_texts import EDGES

needs_files = pytest.mark.skipif(not Path(TOKENIZERS, "piece_bpe_32k.model").exists(), reason="no vocabularies here")


# token counts


@needs_files
def test_attribution(docs_of):
    vocabulary = token_counts.Vocabulary(PATTERN, token_counts.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    texts = EDGES + ["a\n\n\n\nb \n  c\n", "日本\n語😀\nx", "\n", "one\ntwo\r\nthree"]
    got = {x.doc_id: x for x in token_counts.attribute(docs_of(texts), vocabulary).collect()}
    encoder = vocabulary.encoder()
    raw = {v: k for k, v in vocabulary.ranks.items()}
    for i, t in enumerate(texts):
        t = t or ""
        lines = [n for n, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+", t)) for _ in line]
        ids, counts, at = encoder.encode_ordinary(t), Counter(), 0
        chars = [k for k, c in enumerate(t) for _ in c.encode()]  # the character of each byte
        for token in ids:
            own = Counter(lines[c] for c in set(chars[at : at + len(raw[token])]))
            counts[max(own, key=lambda s: (own[s], -s))] += 1
            at += len(raw[token])
        n = len(set(lines))
        assert (got[i].n_chars, got[i].n_tokens, got[i].n_sections) == (len(t), len(ids), n)
        assert got[i].section_tokens == [counts[s] for s in range(n)] and sum(got[i].section_tokens) == len(ids)


def test_boundary_rule():
    # three tokens over "ab|cd": the middle one holds b and c, a tie, and goes to the first section
    counts, crossing = token_counts.attribute_one(np.frombuffer(b"abcd", np.uint8), np.array([1, 3, 4]), np.array([0, 2]))
    assert counts.tolist() == [2, 1] and crossing == 1
    counts, _ = token_counts.attribute_one(np.frombuffer(b"abcd", np.uint8), np.array([1, 4]), np.array([0, 2]))
    assert counts.tolist() == [1, 1]


# pieces


@needs_files
def test_pieces_are_those_of_the_library(docs_of, spark, small):
    import sentencepiece as library

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    pieces, own = sentencepiece.read_model(path), library.SentencePieceProcessor(model_file=path)
    texts = EDGES + ["  two  spaces ", "tab\there\n\nx", "\x00\x7f", " " * 50] + [x.text for x in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows = sentencepiece.encode(docs_of(texts), pieces, check="decodes")
    got = {x.doc_id: x for x in rows.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == (None if t is None else own.encode(t)) and got[i].decodes == (None if t is None else True)
    back = {x.doc_id: x.back for x in sentencepiece.decode(rows.select("doc_id", "ids"), pieces, to="back").collect()}
    assert back == dict(enumerate(texts))


@pytest.mark.parametrize("seed", range(5))
def test_merges_of_one_word_are_those_of_blocks(seed):
    """Ties of scores, stretches of one character and characters without a piece."""
    r = random.Random(seed)
    names = ["<unk>"] + sorted({"a", "b", "▁"} | {"".join(r.choice("ab▁") for _ in range(r.randint(2, 5))) for _ in range(40)})
    pieces = sentencepiece.Pieces(names, np.array([0.0] + [-float(r.randint(1, 12)) for _ in names[1:]]), np.array([2] + [1] * (len(names) - 1)), True)
    for length in [*range(1, 12), 200]:
        block = ["".join(r.choice("aabbc▁") for _ in range(length)) for _ in range(20)] + ["a" * length]
        alive, ids = sentencepiece.merge(np.array([[ord(c) for c in w] for w in block], np.uint32), pieces)
        for k, w in enumerate(block):
            own, found = sentencepiece.merge_alone(w, pieces)
            assert (own == alive[k]).all() and (found == ids[k]).all()


@needs_files
@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "aé漢"])
def test_long_runs_without_spaces(letters):
    import sentencepiece as library

    path, r = f"{TOKENIZERS}/piece_bpe_32k.model", random.Random(3)
    run, start = "".join(r.choice(letters) for _ in range(100_000)), time.monotonic()
    encoder = sentencepiece.Encoder(sentencepiece.read_model(path))
    got = encoder.encode([run, "two " + run[:300]])
    assert time.monotonic() - start < 10
    own = library.SentencePieceProcessor(model_file=path)
    assert [x.tolist() for x in got] == [own.encode(run), own.encode("two " + run[:300])]
    assert encoder.decode(got) == [run, "two " + run[:300]]


@pytest.mark.parametrize("seed", range(5))
def test_viterbi(seed):
    r = random.Random(seed)
    names = ["<unk>"] + sorted({"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))) for _ in range(25)})
    pieces = sentencepiece.Pieces(names, np.array([0.0] + [-r.random() * 5 for _ in names[1:]]), np.array([2] + [1] * (len(names) - 1)), False)
    score = dict(zip(names[1:], pieces.scores[1:]))
    for length in range(1, 8):
        block = ["".join(r.choice("abc▁") for _ in range(length)) for _ in range(30)]
        alive, ids = sentencepiece.viterbi(np.array([[ord(c) for c in w] for w in block], np.uint32), pieces)
        for k, w in enumerate(block):
            best = -math.inf
            for cut in itertools.product([0, 1], repeat=length - 1):
                at = [0, *(i + 1 for i, c in enumerate(cut) if c), length]
                parts = [w[a:b] for a, b in zip(at, at[1:])]
                best = max(best, sum(score.get(p, pieces.least_score - 10 if len(p) == 1 else -math.inf) for p in parts))
            starts = [*np.flatnonzero(alive[k]), length]
            assert [names[i] if i >= 0 else w[a] for i, a in zip(ids[k][alive[k]], starts)] == [w[a:b] for a, b in zip(starts, starts[1:])]
            assert abs(sum(pieces.scores[i] if i >= 0 else pieces.least_score - 10 for i in ids[k][alive[k]]) - best) < 1e-9


def test_unknown_and_empty():
    pieces = sentencepiece.Pieces(["<unk>", "▁a"], np.array([0.0, -1.0]), np.array([2, 1]), True)
    encoder = sentencepiece.Encoder(pieces)
    assert [x.tolist() for x in encoder.encode(["a", "", "zz"])] == [[1], [], [0]]


# personal data

KINDS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: all(int(x) <= 255 for x in g.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda g, d: 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 10 <= len(d) <= 15),
]


def base_plain(t):
    out = []
    for k, (p, sound) in enumerate(KINDS):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if sound(m.group(), re.sub("[^0-9]", "", m.group()))]
    return sorted(out)


def test_base_spans():
    r = random.Random(2)
    parts = ["@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-1234", "..", "é"]
    for _ in range(8000):
        t = "".join(r.choice("a.@b-+ 12345678900()") if r.random() < 0.85 else r.choice(parts) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == base_plain(t)


def test_base_spans_of_long_runs():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "a@" * 50_000):
        pii.candidates(t)


def test_pii(docs_of):
    known = ["mail a.b@c.de from host 10.0.0.1", "card 4111 1111 1111 1111 call +1 (212) 555-0199"] * 30
    new = ["write to bob (at) example (dot) com", "call (212) 555-0100 now", "host 10[.]0[.]0[.]7", "card 4111.1111.1111.1111"]
    docs = docs_of(known + new + [None, "", "plain words only", "chapter 12 of 345"])
    got = {x.doc_id: x for x in pii.digest(pii.find(docs, pii.fit(docs))).collect()}
    assert got[0].spans == "email:5:13,ip:24:32" and (got[0].n_email, got[0].n_ip) == (1, 1)
    assert [got[60 + i].spans for i in range(4)] == ["email:9:35", "phone:5:19", "ip:5:19", "card:5:24"]
    assert [got[60 + i].n_email + got[60 + i].n_phone for i in range(4)] == [0] * 4
    assert all(got[i].spans == "" for i in range(64, 68))
    empty = docs.where("false")
    assert pii.find(empty, pii.fit(empty)).count() == 0


# language


def test_language(docs_of, spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(docs, ~held)
    got = language_id.predict(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang_pred == x.lang for x in got) / len(got) > 0.9 and all(0 <= x.score <= 1 for x in got)
    assert (model.weights == 0).mean() > 0.5
    edge = {x.doc_id: x for x in language_id.predict(docs_of(EDGES), model).collect()}
    assert all(edge[i].lang_pred == "und" and edge[i].score == 0 for i in (0, 1, 2)) and edge[3].lang_pred in model.languages


def test_language_without_training(docs_of):
    docs = docs_of(["abc", None], lang=[None, "en"])
    model = language_id.fit(docs.where("doc_id = 0"), F.lit(True))
    assert {x.lang_pred for x in language_id.predict(docs, model).collect()} == {"und"}


def test_grams():
    grams, row = language_id.Grams.of(["Ab1c", "", "a"])
    assert len(grams) == 3 + 5 + 4 + 1 + 2 + 1 and Counter(row.tolist()) == {0: 12, 2: 4}


# toxicity


def toxic_fixture(docs_of, spark):
    r = random.Random(4)
    texts, marks = [], []
    for i in range(600):
        w = [f"w{r.randrange(200)}" for _ in range(40)]
        toxic, junk = r.random() < 0.3, r.random() < 0.3
        if toxic:
            w[r.randrange(40)] = "vile" + r.choice("abcdefgh")
        if junk:
            w[:5] = ["zzz"] * 5
        texts.append(" ".join(w))
        marks.append((i, int(not junk), int(toxic)))
    return docs_of(texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(docs_of, spark):
    docs, labels = toxic_fixture(docs_of, spark)
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 3 > 0"))
    got = toxicity.score(docs, chain).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    limits = dict(zip(chain.names, chain.thresholds))
    assert sum((x.p_toxic >= limits["toxic"]) == (x.toxic == 1) for x in got) / len(got) > 0.97
    assert sum((x.p_junk >= limits["junk"]) == (x.quality == 0) for x in got) / len(got) > 0.97
    assert [len(m.chain) for m in chain.models] == [0, 1, 2]
    left = toxicity.drop_toxic(docs, chain)
    assert left.columns == docs.columns and 380 < left.count() < 460
    edge = toxicity.score(docs_of(EDGES), chain).collect()
    assert len(edge) == len(EDGES) and all(0 <= x.p_toxic <= 1 for x in edge)


def test_toxicity_without_labels(docs_of, spark):
    docs, labels = toxic_fixture(docs_of, spark)
    chain = toxicity.fit_chain(docs, labels.where("false"))
    assert toxicity.drop_toxic(docs, chain).count() == 600 and toxicity.score(docs.where("false"), chain).count() == 0


# language model


def plain_likelihood(model, seq):
    a = model.first * model.emit[:, seq[0]]
    for c in seq[1:]:
        a = (a @ model.move) * model.emit[:, c]
    return math.log(a.sum())


def tiny(seed, states=3, classes=5):
    r = np.random.default_rng(seed)
    share = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(r.random(s) + 0.1)
    return hidden_markov.Model(share(states), share(states, states), share(states, classes)), [np.array(sorted(r.integers(0, classes, n).tolist(), key=lambda _: r.random()), np.int64) for n in (7, 5, 5, 2, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_forward_and_expectations(seed):
    model, texts = tiny(seed)
    assert np.allclose(hidden_markov.likelihood(model, texts), [plain_likelihood(model, t) for t in texts])
    first, move, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for t in texts:
        paths = list(itertools.product(range(3), repeat=len(t)))
        p = np.array([model.first[s[0]] * model.emit[s[0], t[0]] * math.prod(model.move[a, b] * model.emit[b, c] for a, b, c in zip(s, s[1:], t[1:])) for s in paths])
        total += math.log(p.sum())
        for s, q in zip(paths, p / p.sum()):
            first[s[0]] += q
            for a, b in zip(s, s[1:]):
                move[a, b] += q
            for a, c in zip(s, t):
                emit[a, c] += q
    assert np.allclose(hidden_markov.expect(model, texts), np.concatenate([first, move.ravel(), emit.ravel(), [total]]))


def test_hidden_markov(docs_of):
    r = random.Random(6)
    texts = EDGES + [" ".join(f"{'ab'[i % 2]}{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(1, 60))) for i in range(200)]
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = hidden_markov.HiddenMarkov(docs_of(texts).repartition(3), held, states=2, top=30, shapes=8)
    model.prepare()
    trained = model.train()
    got = {x.doc_id: x for x in model.score(trained).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(w for i, s in enumerate(split) if not out(i) for w in s)
    ends = sum(not out(i) for i in range(len(texts)))
    n, v = sum(counts.values()) + ends, len(counts) + 1
    better = 0
    for i, s in enumerate(split):
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out(i), len(s) + 1, sum(w in counts for w in s) + 1, n)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in s) + math.log10((ends + 1) / (n + v + 1))
        assert abs(x.base_score - base) < 1e-6 * max(1, abs(base)) and x.score < 0
        better += x.score > x.base_score
    assert len(got) == len(texts) and better > 0.8 * len(texts)
    assert model.likelihoods == sorted(model.likelihoods)


def test_model_is_a_distribution(docs_of):
    """The probabilities of all one-word texts over the seen words and one unseen word of each class add up to at most 1."""
    model = hidden_markov.HiddenMarkov(docs_of(["a b c", "a b", "a"]), F.lit(False), states=2, top=1, shapes=2)
    model.prepare()
    trained = model.train()
    shares = np.exp(hidden_markov.likelihood(trained, [np.array([c, 0]) for c in range(4)]))
    assert 0 < shares.sum() < 1 and np.allclose(trained.emit.sum(1), 1) and np.allclose(trained.move.sum(1), 1)


def test_hidden_markov_without_training(docs_of):
    for docs, held in ((docs_of(["a b", None]), F.lit(True)), (docs_of(["a"]).where("false"), F.lit(False))):
        model = hidden_markov.HiddenMarkov(docs, held, states=2, top=4, shapes=2)
        model.prepare()
        rows = model.score(model.train()).collect()
        assert len(rows) == docs.count() and all(x.train_tokens == 0 and x.base_score == 0 and x.n_known == 0 for x in rows)


def test_toxicity_of_any_layout(docs_of, spark):
    """Neither the order of rows nor partitions, absent documents, repeated rows or doubled labels change the chain."""
    docs, labels = toxic_fixture(docs_of, spark)
    absent = spark.range(10_000, 40_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    one = toxicity.fit_chain(docs.coalesce(1), labels, most_labelled=400)
    twice = docs.union(docs).repartition(7).withColumn("h", F.lit("h")).withColumn("y0", F.lit(1))
    other = toxicity.fit_chain(twice, labels.union(labels).repartition(5).union(absent), most_labelled=400)
    assert (one.vocabulary == other.vocabulary).all() and len(one.vocabulary) > 5 and one.thresholds == other.thresholds
    assert all(np.allclose(a.words, b.words) and np.allclose(a.chain, b.chain) and np.isclose(a.bias, b.bias) for a, b in zip(one.models, other.models))


def test_toxicity_chain_by_hand(docs_of, spark):
    """Scores of the chain against plain arithmetic over words and stems, and choices against plain chi-squares."""
    docs, labels = toxic_fixture(docs_of, spark)
    chain = toxicity.fit_chain(docs, labels)
    texts = {x.doc_id: x.text for x in docs.collect()}
    marks = {x.doc_id: (x.quality == 0, x.toxic == 1, x.quality == 0 and x.toxic == 1) for x in labels.collect()}
    hashed = {}
    for t in texts.values():
        raw = np.frombuffer(t.encode(), np.uint8)
        hashes, _ = toxicity.features(raw, np.array([0, len(raw)]))
        for w, h in zip(t.split(), hashes[0::2].tolist()):
            hashed[w] = h
    held = {w: {i for i, t in texts.items() if w in t.split()} for w in hashed}
    n = len(texts)
    for k, model in enumerate(chain.models):
        yes = {i for i, m in marks.items() if m[k]}
        for w, ids in held.items():
            c = len(yes)
            square = n * (len(ids & yes) * n - len(ids) * c) ** 2 / max(len(ids) * (n - len(ids)) * c * (n - c), 1e-9)
            if len(ids) >= 3 and square >= toxicity.SIGNIFICANT:
                assert hashed[w] in chain.vocabulary
    got = {x.doc_id: (x.p_junk, x.p_toxic, x.p_toxic_junk) for x in toxicity.score(docs, chain).collect()}
    number = {h: i for i, h in enumerate(chain.vocabulary.tolist())}
    for i, t in list(texts.items())[:50]:
        raw = np.frombuffer(t.encode(), np.uint8)
        seen = {number[h] for h in toxicity.features(raw, np.array([0, len(raw)]))[0].tolist() if h in number}
        p = []
        for m in chain.models:
            p.append(1 / (1 + math.exp(-(m.bias + sum(m.words[j] for j in seen) + sum(a * b for a, b in zip(m.chain, p))))))
        assert np.allclose(got[i], p)


def test_toxicity_words_are_chosen_without_the_fold(docs_of, spark):
    """Labels by chance: each document's own word would give its label away if the fold's documents took part in the choice."""
    r = random.Random(8)
    docs = docs_of([" ".join(f"w{r.randrange(3000)}" for _ in range(60)) for _ in range(600)])
    marks = [(i, 1, int(r.random() < 0.3)) for i in range(600)]
    rows = docs.select("doc_id", "text").join(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), "doc_id")
    rows = rows.select("text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int").alias("fold"), F.col("toxic").cast("double").alias("y0"))
    held = rows.collect()
    totals = np.array([[sum(x.fold == f for x in held), sum(x.y0 for x in held if x.fold == f)] for f in range(3)], float)
    words, its = toxicity._select(toxicity._word_counts(rows, 1, 3), totals, 10_000)
    raw = lambda t: np.frombuffer(t.encode(), np.uint8)
    sets = [set(toxicity.features(raw(x.text), np.array([0, len(x.text)]))[0].tolist()) for x in held]
    for out in range(4):
        inside = [i for i, x in enumerate(held) if x.fold != out]
        n, c = len(inside), sum(held[i].y0 for i in inside)
        with_word, both = Counter(w for i in inside for w in sets[i]), Counter(w for i in inside if held[i].y0 for w in sets[i])
        want = {w for w, m in with_word.items() if m >= 3 and n * (both[w] * n - m * c) ** 2 / max(m * (n - m) * c * (n - c), 1e-9) >= toxicity.SIGNIFICANT}
        assert set(words[its[out, 0]].tolist()) == want
    assert (its[0] != its[3]).any()


#: Spans that the base patterns don't find, with a context each; the second half looks alike and is none.
REAL = [
    "write to {u} (at) example (dot) com today", "mail {u} [at] mail [dot] org please", "contact {u} at server dot net now", "call (212) 555-01{n} today",
    "phone 212-555-01{n} please", "reach the host 10[.]0[.]0[.]{n} now", "login from 192(.)168(.)1(.){n} seen", "her card 4111.1111.1111.1111 was used", "paid by visa 5555/5555/5555/4444 then",
]
LOOKALIKE = [
    "part 4111.1111.1111.11{n} of the order", "serial 1234/5678/9012/34{n} of batch", "invoice 100 200 00{n} 1 of", "see release 300[.]400[.]500[.]6{n} notes",
    "order 155 011 12{n}4 kg", "sku 999_888_77{n}", "section 999[.]1[.]1[.]{n} of the figure", "ticket 011-155-12{n}4 %", "page 9999.0000.1111.22{n} there",
]


def planted_spans():
    real = [t.format(u="bob" + "abcdefgh"[k % 8], n=10 + k) for k in range(40) for t in REAL]
    fake = [t.format(n=10 + k) for k in range(40) for t in LOOKALIKE]
    plain = ["mail a.b@c.de from host 10.0.0.1", "card 4111 1111 1111 1111 call +1 (212) 555-0199", "on 2024-01-15 at noon version 1.2.3", "he sat at home with 12.5 kg"] * 30
    return real, fake, plain


def test_pii_decides(docs_of):
    """Of proposals that look alike those without support are rejected: precision and recall of the added spans."""
    real, fake, plain = planted_spans()
    docs = docs_of(real + fake + plain)
    model = pii.fit(docs)
    got = {x.doc_id: x for x in pii.find(docs, model).collect()}
    proposed = {i: pii.candidates(t)[1] for i, t in enumerate(real + fake)}
    assert all(proposed[i] for i in range(len(real)))
    wrong = [i for i in range(len(real), len(real) + len(fake)) if proposed[i]]
    assert len(wrong) > len(fake) / 2
    caught, false = sum(bool(got[i].added) for i in range(len(real))), sum(bool(got[i].added) for i in wrong)
    assert caught >= 0.95 * len(real) and false <= 0.05 * len(wrong)
    print(f"recall {caught / len(real):.3f}, precision {caught / (caught + false):.3f}, rejected {1 - false / len(wrong):.3f}")
    other = pii.fit(docs.repartition(7).withColumn("h", F.lit(1)).withColumn("kind", F.lit("x")))
    assert np.allclose(model.weights, other.weights, atol=1e-6) and np.allclose(model.reliability, other.reliability)


def test_pii_votes_count():
    """Without data the classifier rejects what all labelers vote against and takes what they vote for."""
    model = pii.fit_classifier(pii.estimate(*(np.zeros(0, np.int64) for _ in range(4))), np.zeros((0, 10), np.int64), np.zeros(0, np.int64))
    for kind in range(4):
        assert model.probability((kind, 2, 2, 2, 1, 1, 0, 0, 0, 0)) > 0.8 and model.probability((kind, 0, 0, 1, 0, 0, 0, 0, 0, 0)) < 0.2


def test_pii_base_digest(docs_of):
    """base_sha256 and counts of the registered form against the plain patterns."""
    import hashlib

    real, fake, plain = planted_spans()
    texts = EDGES + plain[:4] + real[:9] + ["ünï 😀 a@b.c 1.2.3.4.5.6.7.8 +12 345 678 90 12"]
    docs = docs_of(texts + texts, ids=[None, 1] * len(texts), text_hash=["x"] * 2 * len(texts), base=["y"] * 2 * len(texts))
    got = sorted((x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.digest(pii.find(docs, pii.fit(docs))).collect())
    want = []
    for t in texts + texts:
        spans = base_plain(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((hashlib.sha256(joined.encode()).hexdigest(), *(sum(k == i for _, k, _ in spans) for i in range(4))))
    assert got == sorted(want)
