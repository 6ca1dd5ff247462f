"""Lasting indexes, sketches, caches and masks on small inputs."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import embedding, filters, tagging
from larkspur.operators import blocks, fulltext, metrics, neighbours, retrieval, similar
from larkspur.plans import index_queries
from larkspur.sources import views
from larkspur.streaming import ingest


@pytest.fixture(scope="module")
def words():
    r = random.Random(8)
    common = ["the", "of", "and", "é1"]
    return [" ".join(r.choice(common + [f"w{r.randint(0, 40)}"]) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", "!!", "the the the the"]


def naive_counts(texts, phrase):
    t = phrase.split()
    out = {}
    for i, x in enumerate(texts):
        w = x.split() if x != "!!" else []
        n = sum(w[k : k + len(t)] == t for k in range(len(w) - len(t) + 1))
        if n:
            out[i] = n
    return out


def test_phrases_by_places(spark, words):
    m = spark.createDataFrame([(i, t, None) for i, t in enumerate(words)], "id long, text string, compressed_text string")
    asked = ["the", "the of", "of the and", "the the the", "w1 w2", "nothing here", "THE, of", "", None, "the"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(r.query_id, r.id): r.tf for r in fulltext.search(m, q).collect()}
    want = {(k, i): n for k, p in enumerate(asked) if p and p.strip() for i, n in naive_counts(words, p.lower().replace(",", "")).items()}
    assert got == want


def test_phrases_end_at_fields(spark):
    m = spark.createDataFrame([(1, "a b", "c d"), (2, "a b c", None), (3, None, None)], "id long, text string, compressed_text string")
    q = spark.createDataFrame([(0, "b c"), (1, "c d")], "query_id long, text string")
    assert sorted((r.query_id, r.id) for r in fulltext.search(m, q).collect()) == [(0, 2), (1, 1)]


def test_frequent_phrases_are_dealt(spark, monkeypatch):
    """a phrase that all queries ask and all records hold isn't the work of one task, and its scores are made once a hit."""
    m = spark.range(400).selectExpr("id", "'the fox' AS text", "CAST(NULL AS STRING) AS compressed_text")
    q = spark.range(50).selectExpr("id AS query_id", "'the' AS text")
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(fulltext, "ASKING", 8)
    for most in (fulltext.ASKERS, 0):
        monkeypatch.setattr(fulltext, "ASKERS", most)
        before = made.value
        rows = fulltext.search(m, q, lambda found: found.mapInArrow(seen, found.schema)).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.query_id, r.id) for r in rows) == [(a, b) for a in range(50) for b in range(400)]
        assert made.value - before == 400
        tasks = [r.task for r in rows]
        assert max(map(tasks.count, set(tasks))) < len(rows) * 0.6


def test_index_deals_frequent_phrases(spark, monkeypatch, tmp_path):
    """the lasting index makes scores once a hit, and deals the hits of a phrase that all queries ask."""
    m = spark.range(200).selectExpr("id", "'the fox' AS text", "CAST(NULL AS STRING) AS compressed_text", "1D AS weight")
    q = spark.range(30).selectExpr("id AS query_id", "'the' AS text")
    index = fulltext.TextIndex(spark, str(tmp_path), shards=2)
    index.add(m, 0)
    monkeypatch.setattr(fulltext, "ASKERS", 0)
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        rows = index.search(q, lambda found: found.withColumn("made", F.monotonically_increasing_id())).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in large:
            spark.conf.unset(k)
    assert sorted((r.query_id, r.id) for r in rows) == [(a, b) for a in range(30) for b in range(200)]
    assert len({r.made for r in rows}) == 200
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < len(rows) * 0.6


def test_units_are_counted_where_they_are_made(spark):
    """places are for the pairs of longer phrases only; a whole phrase has a row a record, and each record one of its size."""
    m = spark.createDataFrame([(1, "a b a b a", "a"), (2, None, None)], "id long, text string, compressed_text string")
    q = spark.createDataFrame([(0, "a"), (1, "a b"), (2, "a b a")], "query_id long, text string")
    due = fulltext.wanted(fulltext.units(fulltext.phrases(q))).union(spark.sql("SELECT '', false"))
    got = {(r.unit, r.id, r["at"]): (r.n, r.d) for r in fulltext.counted(fulltext.places(m), due).collect()}
    assert got == {
        ("", 1, None): (1, 6), ("", 2, None): (1, 0), ("a", 1, None): (4, 6), ("a b", 1, None): (2, 6),
        ("a b", 1, 0): (1, 6), ("a b", 1, 2): (1, 6), ("b a", 1, 1): (1, 6), ("b a", 1, 3): (1, 6),
    }


def test_top_reads_fewer_postings(spark, words, tmp_path):
    """Frequent words end early, and give what the exhaustive search gives."""
    texts = words * 4
    r = random.Random(2)
    weights = [round(r.random() * 5, 3) for _ in texts]
    m = spark.createDataFrame([(i, t, None, w) for i, (t, w) in enumerate(zip(texts, weights))], "id long, text string, compressed_text string, weight double")
    index = fulltext.TextIndex(spark, str(tmp_path / "i"), shards=2, parts=2)
    index.add(m, 0)
    q = spark.createDataFrame(list(enumerate(["the", "of", "w3", "the of", "none"])), "query_id long, text string")
    live = m.where("id % 9 <> 0").select("id", F.col("weight").alias("w"))
    found, read = index.compacted(str(tmp_path / "c")).top(q, live, 5)
    every = fulltext.search(m, q).join(live, "id").withColumn("s", F.round(fulltext.similarity(F.col("bm25")) * F.col("w"), 9))
    want = retrieval.top(every, ["query_id"], [F.desc("s"), "id"], 5)
    assert sorted((x.query_id, x.rank, x.id) for x in found.collect()) == sorted((x.query_id, x.rank, x.id) for x in want.collect())
    shares = {x.phrase: x.n / x.of for x in read.collect()}
    assert shares["the"] < 0.5 and shares["of"] < 0.5


def test_index_batches_replace(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, text string, compressed_text string, weight double")
    index = fulltext.TextIndex(spark, str(tmp_path), shards=2)
    index.add(rows((1, "red fox", None, 1.0), (2, "red hen", None, 1.0)), 0)
    index.add(rows((1, "blue fox", None, 1.0)), 1)
    index.add(rows((1, "green fox", None, 1.0)), 1)  # the batch again
    q = spark.createDataFrame([(0, "red"), (1, "blue fox"), (2, "green fox")], "query_id long, text string")
    assert sorted((r.query_id, r.id) for r in index.search(q).collect()) == [(0, 2), (2, 1)]
    index.remove(rows((2, "", None, 0.0)), 2)
    assert sorted((r.query_id, r.id) for r in index.search(q).collect()) == [(2, 1)]


def test_cells(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 900)] + r.normal(size=(900, 16)) * 0.4
    x[:300] = x[0]  # a cell that holds a third of all
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    q = v.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    index = neighbours.CellIndex(spark, str(tmp_path), neighbours.train(v, cells=10), block=64).build(v)
    assert index.blocks().agg(F.sum(F.size("ids"))).first()[0] == 900
    want = retrieval.vector_top_k(v.where("embedding is not null"), q.where("embedding is not null"), 8).collect()
    key = lambda rows: sorted((a.query_id, a.rank, a.id) for a in rows)
    assert key(index.exact(q, 8, probes=1).collect()) == key(want)
    probes = index.calibrated(v, 8, 0.9)
    near = {(a.query_id, a.id) for a in index.search(q, 8, probes).collect()}
    assert len(near & {(a.query_id, a.id) for a in want}) >= 0.9 * len(want)


def test_cells_of_nothing(spark, tmp_path):
    v = spark.createDataFrame([], "id long, embedding array<double>")
    index = neighbours.CellIndex(spark, str(tmp_path), neighbours.train(v)).build(v)
    assert index.exact(v.withColumnRenamed("id", "query_id"), 3).collect() == []


def test_band_index_takes_batches(spark, tmp_path):
    r = random.Random(1)
    base = [[f"w{r.randint(0, 99)}" for _ in range(40)] for _ in range(15)]
    texts = [" ".join(b[:i] + ["new"] * (i > 0) + b[i + 1 :]) for b in base for i in (0, 5, 9)] + [None, "", " ".join(base[0][1:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = similar.BandIndex(spark, str(tmp_path / "x"))
    both = [index.add(rows.where(c), k, 0.7).collect() for k, c in enumerate(("id % 2 = 0", "id % 2 = 1"))]
    again = index.add(rows.where("id % 2 = 1"), 1, 0.7).collect()
    pairs = lambda p: {frozenset((texts[a.a], texts[a.b])) for a in p}
    assert pairs(both[0]) | pairs(both[1]) == pairs(similar.minhash_pairs(rows, 0.7).collect()) and pairs(again) == pairs(both[1])
    index.clear()
    assert index.add(rows.where("id % 2 = 1"), 1, 0.7).count() <= len(both[1])


def test_cache_asks_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def model(texts):
        with open(seen, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return np.array([[len(t), 1] for t in texts], np.float32)

    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "three")], "id long, text string")
    cache = embedding.VectorCache(spark, str(tmp_path / "c"), "m")
    cache.embed(rows.where("id < 3"), model).collect()
    first = sorted(open(seen).read().split())
    assert first == ["one", "two"] and [r.text for r in cache.unseen(rows).collect()] == ["three"]
    got = {r.id: r.embedding for r in cache.embed(rows, model).collect()}
    assert sorted(open(seen).read().split()) == ["one", "three", "two"] and got[4] is None and got[1] == got[3]
    cache.embed(rows, model).collect()
    assert sorted(open(seen).read().split()) == ["one", "three", "two"]


def test_masks_at_any_depth(spark):
    rows = spark.sql("SELECT 'a@b.cd' AS t, 7 AS n, array(map('a@b.cd', named_struct('x', 'ip 10.0.0.7', 'y', 3))) AS deep, CAST(NULL AS STRUCT<s: STRING>) AS gone, array(1) AS plain")
    got = filters.mask_rows(rows).first()
    assert got.t == "***@***.***" and got.n == 7 and got.gone is None and got.plain == [1]
    assert got.deep == [{"a@b.cd": ("ip 10.***.***.7", 3)}]
    assert filters.mask_rows(rows, keep=["t"]).first().t == "a@b.cd" and filters.mask_rows(rows).dtypes == rows.dtypes


def test_sketches(spark):
    r = random.Random(6)
    values = [(r.choice("ab"), i % 13, r.expovariate(1)) for i in range(30_000)]
    rows = spark.createDataFrame(values, "k string, day int, v double")
    parts = metrics.sketched(rows, ["k", "day"], "v")
    for x in metrics.sketch_percentiles(metrics.merged_sketches(parts, ["k"]), ["k"]).collect():
        own = np.sort([v for k, _, v in values if k == x.k])
        assert x.n == len(own) and abs(x.mean - own.mean()) < 1e-9
        for share, at in ((0.5, x.p50), (0.95, x.p95), (0.99, x.p99)):
            assert abs(np.searchsorted(own, at) / len(own) - share) < 2 * metrics.RANK_ERROR


def test_stream_keeps_hashes(spark, small, tmp_path):
    """Turns that come again in a later run, or twice in one, add no record; the state holds a row for each hash."""
    t = views.turns(spark, small).limit(30)
    run = lambda **o: ingest.ingest(ingest.read_turns(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"), **o)
    t.coalesce(1).write.json(str(tmp_path / "in"))
    run().awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert first == ingest.once(ingest.to_records(ingest.judge(t))).count()
    t.union(t).coalesce(1).withColumn("id", F.col("id") + 1_000_000).write.mode("append").json(str(tmp_path / "in"))
    last = run()
    last.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] == first


def test_hits_are_ranked_by_phrase(spark, words):
    """Equal queries get the best records of their phrase; no text is joined before, and unusable records count in the score only."""
    m = spark.createDataFrame([(i, t, None, (i * 7 % 50) / 10) for i, t in enumerate(words)], "id long, text string, compressed_text string, weight double")
    q = spark.createDataFrame([(k, p) for k, p in enumerate(["the", "of the", "THE", "the", "of and the", "none"])], "query_id long, text string")
    found = retrieval.best_hits(m, q, 4, F.col("id") % 3 != 0, lambda s, w: [F.desc(F.round(fulltext.similarity(s) * w, 9))], F.col("weight"))
    every = fulltext.search(m, q).join(m, "id").where("id % 3 <> 0")
    want = retrieval.top(every, ["query_id"], [F.desc(F.round(fulltext.similarity(F.col("bm25")) * F.col("weight"), 9)), "id"], 4)
    got = sorted((x.query_id, x.rank, x.id) for x in found.collect())
    assert got == sorted((x.query_id, x.rank, x.id) for x in want.collect()) and len({x[0] for x in got}) >= 4
    assert "text" not in found.columns


def test_known_turn_and_record_of_one_number(spark):
    """A turn and a record may have the same number: only the one whose text the session holds goes."""
    tail = spark.createDataFrame([("s", "alpha beta gamma", "so it is")], "session_id string, user_input string, assistant_response string")
    m = spark.createDataFrame([(7, "alpha  beta gamma")], "id long, text string")
    found = spark.createDataFrame([(1, "s", 7, "L1", "other words here"), (1, "s", 7, "L2", None)], "query_id long, session_id string, item_id long, source string, text string")
    assert [x.source for x in retrieval.drop_known(found, tail, m=m).collect()] == ["L1"]


def test_signatures_in_blocks(spark):
    """Digests made in blocks are those of hashlib, long and non-ASCII tokens too, and pairs sign their texts once."""
    r = random.Random(4)
    lists = [["x" * r.choice([1, 20, 51, 52, 53, 70]) + r.choice(["é", "字", ""]) + str(r.randrange(60)) for _ in range(r.randrange(1, 40))] for _ in range(40)]
    want = [[min(hashlib.md5(f"{i}_{t}".encode()).hexdigest() for t in ts) for i in range(64)] for ts in lists]
    assert similar._signatures(lists, 64) == want
    df = spark.createDataFrame([(i, " ".join(ts)) for i, ts in enumerate(lists)], "id long, text string")
    plan = similar.minhash_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_index_holds_each_place_once(spark, words, tmp_path):
    """A place is one row for its token and its pair, occurrences are numbered by record, and bounds take no second copy."""
    m = spark.createDataFrame([(i, t, t[:20], float(i % 5)) for i, t in enumerate(words)], "id long, text string, compressed_text string, weight double")
    index = fulltext.TextIndex(spark, str(tmp_path), shards=2)
    index.add(m, 0)
    rows, places = spark.read.parquet(f"{tmp_path}/postings"), fulltext.sizes(m).agg(F.sum("d")).first()[0]
    assert rows.count() == places
    most = rows.groupBy("unit", "band").agg(F.count_distinct("id").alias("n"), F.max("nth").alias("tf")).collect()
    index.bounded()
    assert sorted((b.unit, b.band, b.n, b.tf) for b in spark.read.parquet(f"{tmp_path}/blocks").collect()) == sorted((b.unit, b.band, b.n, b.tf) for b in most)
    assert rows.groupBy("unit", "id").agg((F.max("nth") != F.count("*")).alias("off")).where("off").count() == 0
    q = spark.createDataFrame(list(enumerate(["the", "the of", "of the and", "the"])), "query_id long, text string")
    rounded = lambda df: sorted((x.query_id, x.id, x.tf, round(x.bm25, 9)) for x in df.collect())
    assert rounded(index.search(q)) == rounded(fulltext.search(m, q))


def test_blocks_keep_the_best_of_a_task():
    """Blocks of queries keep k rows each however many blocks of the store they meet, also of equal vectors, of rows met twice and of
    more blocks than are held at once."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    store, asked = r.normal(size=(400, 8)), r.normal(size=(60, 8))
    store[50:250] = store[3]  # one vector two hundred times
    asked[7] = store[3]
    names = ["ids", "own", "query_ids", "asked", "least"]
    for step, rows in ((60, 60), (3, 3 * 5 * 60 // 3)):
        pairs = []
        for a in range(0, 400, 100):
            for b in range(0, 60, step):
                one = [np.arange(a, a + 100), store[a : a + 100].tobytes(), np.arange(b, b + step), asked[b : b + step].tobytes(), np.full(step, -np.inf).tobytes()]
                kinds = [pa.list_(pa.int64()), pa.binary()] * 2 + [pa.binary()]
                pairs += [pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds)], names=names)] * 2
        found = [x for b in blocks.best(iter(pairs), 5) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert len(found) == (300 if step == 60 else 300 * 4)  # blocks that are given back come in parts
        want = np.argsort(-(np.einsum("ij,kj->ik", asked, store)), axis=1, kind="stable")[:, :5]
        for q in range(60):
            own = sorted({(-s, i) for k, i, s in found if k == q})[:5]
            assert [i for _, i in own] == want[q].tolist()


def test_buckets_meet_in_blocks(spark):
    """The search by signs gives what its definition gives, and no row for a pair of a query and a record."""
    r = np.random.default_rng(9)
    x = r.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(x)], "id long, embedding array<double>")
    found = retrieval.lsh_top_k(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 6, tables=3, bits=6)
    sign = ((x @ np.random.default_rng(5).normal(size=(18, 16)).T) > 0).reshape(500, 3, 6)
    got = {}
    for a in found.collect():
        got.setdefault(a.query_id, []).append((a.rank, a.id))
    for q in range(0, 500, 20):
        may = np.flatnonzero(((sign != sign[q]).sum(2) <= 1).any(1))
        want = may[np.argsort(-(x[may] @ x[q]), kind="stable")][:6]
        assert [i for _, i in sorted(got[q])] == want.tolist()
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_stand_in_moves_no_text(spark):
    """The stand-in is made where a row is, from a seed of the JVM: nothing is shuffled and no text goes to Python."""
    texts = ["one", "é字", "", "one", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    made = embedding.embed(rows, allow_fallback=True)
    got = {r.id: r.embedding for r in made.collect()}
    assert got[4] is None and all(np.allclose(got[i], embedding.stand_in(t)) for i, t in enumerate(texts) if t is not None)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_key_words_are_found_in_slices(spark):
    """Texts are Python's a few at a time, without pandas; what is found is the same in batches longer than that."""
    from pyspark.util import PythonEvalType

    assert tagging._words_in.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    texts = [None if i % 50 == 3 else "" if i % 7 == 0 else f"a meeting {i}, git and capital 会议" if i % 3 else "plain" for i in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.w for r in rows.select("id", tagging._words_in(F.lower(F.coalesce("text", F.lit("")))).alias("w")).collect()}
    assert got == {i: [w for w in tagging._WANTED if w in (t or "")] for i, t in enumerate(texts)}


def test_cache_query_moves_texts_once(spark, small):
    """What is shown needs no text, so neither the last joins nor the keys of what is new carry one."""
    cache = embedding.VectorCache(spark, "/nowhere/at/all", "m")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, text string")
    assert cache.unseen_keys(rows).columns == ["h"] and cache.unseen_keys(rows).count() == 1
    plan = index_queries.embedding_cache(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "text = new" not in plan and "length(text" in plan


def test_cache_query_takes_empty_and_null_texts(spark, tmp_path):
    """the vector of an empty text is zero, by which nothing is divided; null texts give what SQL gives."""
    for k, texts in enumerate([["a e", "", "x", ""], ["a e", "x", "b", None], ["a e", "x", None, "a e", ""]]):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet'")
        want = c.execute(index_queries.ORACLE_SQL["embedding_cache"]).fetchall()
        assert sorted(map(tuple, index_queries.embedding_cache(spark, f"{tmp_path}/{k}").collect())) == sorted(want)


@pytest.mark.parametrize("tables, bits", [(24, 8), (3, 8), (4, 7)])
def test_signs_send_nothing_through_the_driver(spark, tables, bits):
    """copies of rows aren't broadcast because their source is small; many shared buckets make no copies. Equal rows, and queries with few
    rows near them, are found as by definition."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(x)], "id long, embedding array<double>")
    found = retrieval.lsh_top_k(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 6, tables, bits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and ("cell" in plan) == (tables * (bits + 1) < 2**bits / 4)
    sign = ((x @ np.random.default_rng(5).normal(size=(tables * bits, 16)).T) > 0).reshape(500, tables, bits)
    got = {}
    for a in found.collect():
        got.setdefault(a.query_id, []).append((a.rank, a.id, a.similarity))
    for q in range(0, 500, 20):
        may = np.flatnonzero(((sign != sign[q]).sum(2) <= 1).any(1))
        want = may[np.argsort(-np.einsum("ij,j->i", x[may], x[q]), kind="stable")][:6]
        assert [i for _, i, _ in sorted(got[q])] == want.tolist()


def test_blocks_count_what_codes_let():
    """the best of several small blocks are those of the pairs whose codes are at most one bit apart, crowded rows as well."""
    r = np.random.default_rng(4)
    x, k = np.round(r.normal(size=(400, 4))), 3
    x[100:300] = x[0]
    codes = lambda rows: (np.abs(rows) * 3 % 7).astype(np.uint8)
    rows = [x[a : a + 150] for a in range(0, 400, 150)]
    best = blocks._Best(np.arange(40), x[:40], k, np.full(40, -np.inf), codes(x[:40]))
    for a, part in zip(range(0, 400, 150), rows):
        best.meet(np.arange(a, a + len(part)), part, codes(part))
    got = best.result().to_pydict()
    near = np.array([[any(bin(int(p) ^ int(q)).count("1") <= 1 for p, q in zip(codes(x)[i], codes(x)[j])) for j in range(400)] for i in range(40)])
    for i in range(40):
        s = np.where(near[i], x @ x[i], -np.inf)
        want = [j for j in np.argsort(-s, kind="stable")[:k].tolist() if s[j] > -np.inf]
        assert [j for q, j in zip(got["query_id"], got["id"]) if q == i] == want


@pytest.mark.parametrize("threshold, n", [(0.8, 64), (0.9, 64), (0.7, 64), (0.8, 20)])
def test_pairs_by_few_numbers(spark, monkeypatch, threshold, n):
    """the first numbers alone find the pairs of whole signatures, most rows never get the others, and batches are cut."""
    r = random.Random(6)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(30)]
    texts = [" ".join(b[:i] + [f"new{r.randint(0, 9)}"] * k + b[i + k :]) for b in base for i, k in ((0, 0), (5, 1), (20, 2), (30, 4), (50, 8))]
    texts += ["", None, texts[0]] + [f"alone{i} " + " ".join(f"x{r.randint(0, 10**6)}" for _ in range(30)) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    signed = {x.id: x.s for x in rows.select("id", similar.minhash(similar.minhash_words("text"), n)["s"].alias("s")).collect() if x.s is not None}
    ids = sorted({t: i for i, t in reversed(list(enumerate(texts))) if i in signed}.values())
    parts = {i: [signed[i][k : k + 16] for k in range(0, 16 * n, 16)] for i in ids}
    for i in ids[::9]:
        w = texts[i].split()
        tokens = w + [f"{p}_{q}" for p, q in zip(w, w[1:])]
        assert parts[i] == [min(hashlib.md5(f"{k}_{t}".encode()).digest() for t in tokens) for k in range(n)]
    want = {}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = sum(p == q for p, q in zip(parts[a], parts[b]))
            if same / n >= threshold and any(parts[a][k : k + 4] == parts[b][k : k + 4] for k in range(0, n - 3, 4)):
                want[a, b] = same / n
    made, whole = [], similar.minhash
    monkeypatch.setattr(similar, "_AT_ONCE", 500)
    monkeypatch.setattr(similar, "minhash", lambda words, to=64, since=0: made.append((since, to)) or whole(words, to, since))
    got = {(x.a, x.b): x.similarity for x in similar.minhash_pairs(rows, threshold, n).collect()}
    assert got == want and len(want) > 20
    assert (made[0][1] < n) == (threshold >= 0.8)


def test_long_phrases_move_no_places(spark, words):
    """F4, F8, F9: phrases of up to RUN tokens are compared where they are found, longer ones by pairs; both as by definition."""
    r = random.Random(3)
    texts = words + [" ".join(r.choice("ab") for _ in range(40)) for _ in range(30)]
    m = spark.createDataFrame([(i, t, None if i % 3 else t[:25]) for i, t in enumerate(texts)], "id long, text string, compressed_text string")
    asked = [" ".join(t.split()[k : k + n]) for t in texts[:60:3] + texts[-9:] for k, n in ((0, 3), (4, 5), (2, 12), (1, 13), (0, 30))] + ["the", "a b a", "none of these"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(x.query_id, x.id): x.tf for x in fulltext.search(m, q).collect()}
    want = {}
    for k, p in enumerate(asked):
        for second in (False, True) if p.strip() else ():
            for i, n in naive_counts([t[:25] if second and i % 3 == 0 else "" if second else t for i, t in enumerate(texts)], p).items():
                want[k, i] = want.get((k, i), 0) + n
    assert got == want
    heads = spark.createDataFrame([("a b", "a b a b", 4), ("", "", 1)], "unit string, phrase string, m int")
    plan = fulltext.runs_counted(m, heads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_of_few_results_are_not_shuffled(spark):
    """F8, F9: records that no result stands for keep their texts where they are."""
    m = spark.range(1000).selectExpr("id", "concat('text ', id) AS text")
    found = spark.createDataFrame([(1, 7, "L2"), (2, 8, "L3"), (3, 9, "L1"), (4, 5000, "L2")], "query_id long, item_id long, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = retrieval.with_texts(found, m)
        assert "BroadcastHashJoin" in shown._jdf.queryExecution().executedPlan().toString()
        assert sorted((x.query_id, x.text) for x in shown.collect()) == [(1, "text 7"), (2, "text 8"), (3, None), (4, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
