"""Operators on hand-written inputs, against plain versions and invariants."""

import itertools
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import metadata as md
from larkspur.operators import context, lifecycle, merging, records, retrieval, similar
from larkspur.plans.queries import QUERIES
from larkspur.schema import CONFIG, MEMORIES
from larkspur.sources import views
from larkspur.sources.snapshots import Snapshots, export_archive, import_archive
from larkspur.streaming import ingest


def leaders(n, pairs):
    """The scan as it is defined."""
    near, out = {frozenset(p) for p in pairs}, {}
    for i in range(n):
        if i not in out:
            out[i] = i
            for j in range(i + 1, n):
                if j not in out and frozenset((i, j)) in near:
                    out[j] = i
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_leaders(spark, seed):
    r, n = random.Random(seed), 25
    pairs = [p for p in itertools.combinations(range(n), 2) if r.random() < 0.12]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = similar.greedy_leaders(nodes, spark.createDataFrame(pairs, "a long, b long"))
    assert {x.id: x.leader for x in got.collect()} == leaders(n, pairs)


def test_no_pairs(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    got = similar.greedy_leaders(nodes, spark.createDataFrame([], "a long, b long"))
    assert sorted((x.id, x.leader) for x in got.collect()) == [(1, 1), (2, 2)]


def test_minhash(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(0, text), (1, text + " more"), (2, "quite another thing"), (3, text), (4, ""), (5, None)], "id long, text string")
    got = {(x.a, x.b) for x in similar.minhash_pairs(df, 0.8).collect()}
    assert got == {(0, 1)}


@pytest.mark.parametrize(
    "texts, want",
    [
        (["明天去北京", "后天去北京"], "time"),
        (["去北京出差", "去上海出差"], "place"),
        (["花了100块", "花了200块"], "number"),
        (["不喜欢咖啡", "很喜欢咖啡吗"], "negation"),
        (["苹果手机好用", "吃苹果"], "context"),
        (["买了红车", "买了黑车"], "attribute"),
        (["a", "b"], None),
    ],
)
def test_conflicts(spark, texts, want):
    df = spark.createDataFrame([(1, t) for t in texts], "group_id long, text string")
    got = [x.conflict for x in similar.conflicts(df).collect()]
    assert got == ([want] if want else [])


def test_rrf(spark):
    rows = [(1, "L1", 1, "a", 0.9, 1.0), (1, "L2", 1, "b", 0.8, 1.0), (1, "L3_LOW_QUALITY", 2, "a", 0.7, 2.0)]
    df = spark.createDataFrame(rows, "query_id long, source string, rank int, text string, similarity double, weight double")
    got = {x.key: (x.rrf_score, x.source, x.rank) for x in retrieval.fuse(df).collect()}
    assert got["a"] == (round(1.2 / 61 + 0.8 / 62, 12), "L1", 1) and got["b"][2] == 2


def test_vector_top_k(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(3)
    q = df.where("id < 5").withColumnRenamed("id", "query_id")
    for block in (2, 100):
        got = retrieval.vector_top_k(df, q, 4, block).orderBy("query_id", "rank").collect()
        assert [(x.query_id, x.id) for x in got] == [(i, j) for i in range(5) for j in np.argsort(-(v @ v[i]), kind="stable")[:4].tolist()]
    near = {(x.query_id, x.id) for x in retrieval.lsh_top_k(df, q, 4).collect()}
    assert len(near & {(x.query_id, x.id) for x in got}) >= 18


def test_empty_queries(spark):
    v = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert retrieval.vector_top_k(v, v.where("false").withColumnRenamed("id", "query_id"), 3).count() == 0


def test_pack(spark):
    items = spark.createDataFrame([(1, 0, "x" * 100), (1, 1, "5 " + "y" * 200), (1, 2, "z" * 400)], "q long, pos long, text string")
    got = context.pack(items, ["q"], F.lit(200)).orderBy("place").collect()
    assert [(x.pos, x.cut) for x in got] == [(1, False), (0, False), (2, True)]
    assert context.assemble(context.pack(items, ["q"], F.lit(200)), ["q"]).first().context.count("• ") == 3


def test_time_window(spark):
    t = datetime(2024, 1, 1, 12)
    tail = spark.createDataFrame([("s", t)], "session_id string, ts timestamp_ntz")
    rows = spark.createDataFrame([(i, "s", t + timedelta(seconds=s)) for i, s in enumerate((-121, -120, 0, 120, 121))], "id long, session_id string, ts timestamp_ntz")
    assert sorted(x.id for x in retrieval.outside_window(rows, tail).collect()) == [0, 4]


def test_marks(spark, small):
    m = views.memories(spark, small)
    now = views.as_of()
    meta = F.col("metadata")
    moved = m.limit(1).select(md.mark_moved_to_l3(md.mark_moved_to_l2(meta, now), now).alias("m")).first().m
    assert moved.moved_from_l2 and moved.moved_from_l3 is None and moved.promoted_to_l2
    done = m.limit(1).select(md.clear_compression(md.mark_compressed(meta, "rule", 5, now)).alias("m")).first().m
    assert done.compressed is None and done.original_length is None


def test_insert(spark):
    empty = spark.createDataFrame([], MEMORIES)
    new = spark.createDataFrame([(1, "a")], "id long, text string").withColumns({f.name: F.lit(None).cast(f.dataType) for f in MEMORIES.fields if f.name not in ("id", "text")})
    row = records.insert(empty, new, views.as_of()).first()
    assert (row.weight, row.access_count, row.is_important, row.metadata.token_count) == (1.0, 0, False, 0) and row.text_hash


def test_idempotent(spark):
    m = spark.createDataFrame([(1, "h", False), (2, "k", True)], "id long, text_hash string, is_archived boolean")
    fresh, known = records.insert_new(m, spark.createDataFrame([(3, "h"), (4, "k"), (5, "k"), (6, "n")], "id long, text_hash string"))
    assert sorted(x.id for x in fresh.collect()) == [4, 6] and [(x.id, x.existing_id) for x in known.collect()] == [(3, 1)]


def test_weights_stay_in_range(spark, small):
    m = views.memories(spark, small)
    for out in (records.boost(m, m.select("id"), views.as_of()), lifecycle.decay(m, views.as_of())):
        low, high = out.agg(F.min("weight"), F.max("weight")).first()
        assert 0 <= low and high <= CONFIG.max_weight


def test_maintain_keeps_every_row(spark, small):
    m = views.memories(spark, small)
    out, report = lifecycle.maintain(m, views.as_of())
    gone = {r.step: r.n for r in report.collect()}.get("forget", 0)
    assert out.count() + gone == m.count() == out.select("id").distinct().count() + gone


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"), keep=2)
    with pytest.raises(FileNotFoundError):
        s.read()
    for i in range(4):
        s.commit(spark.range(i + 1))
    assert s.versions() == [3, 4] and s.read().count() == 4 and s.read(3).count() == 3
    s.compact(1)
    assert s.read().count() == 4


def test_archive_round_trip(spark, small, tmp_path):
    _, rows = lifecycle.archive(views.memories(spark, small), views.as_of())
    export_archive(rows, str(tmp_path), views.as_of())
    back = import_archive(spark, str(tmp_path), views.as_of())
    assert {x.id for x in back.collect()} == {x.original_id for x in rows.collect()}


def test_stream_equals_batch(spark, small, tmp_path):
    t = views.turns(spark, small)
    t.repartition(3).write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new to take
        ingest.ingest(ingest.read_turns(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    streamed = {x.text_hash for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = [x.text_hash for x in ingest.once(ingest.to_records(ingest.judge(t))).collect()]
    assert streamed == set(want) and spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_windowed_stream(spark, small, tmp_path):
    events = views.table(spark, small, "events")
    events.write.parquet(str(tmp_path / "e"))
    live = ingest.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = live.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, ingest.windowed(events).collect()))


def test_merge_takes_all_members(spark, small):
    """Members 21 and on add to the text before they go; equal texts don't use up places."""
    row = views.memories(spark, small).where("NOT metadata.forgotten").limit(1)
    texts = ["start"] * 25 + ["start alpha one", None, "start beta two", "start alpha one", "start gamma three"]
    given = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = row.drop("id", "text").crossJoin(given).withColumns({"group_id": F.lit(7), "metadata": F.lit(None).cast(MEMORIES["metadata"].dataType)})
    merged = merging.merge_groups(members, views.as_of()).first()
    assert merged.text == merging.merge_texts(texts) and "three" in merged.text and sorted(merged.deleted_ids) == list(range(1, 30))


def test_archive_stats_count_all(spark, monkeypatch):
    """The limit of a batch doesn't bound the statistics."""
    monkeypatch.setattr(lifecycle.archive, "__defaults__", ("age", replace(CONFIG, archive_max=1)))
    at = "/root/testdata/sf0.01"
    due = lifecycle.archive(views.memories(spark, at), views.as_of(), config=CONFIG)[1].count()
    assert due > 1 and QUERIES["archive_stats"](spark, at).first().n == due


def test_resolve(spark):
    texts = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 1, None), (4, 2, 1), (5, 2, 2), (6, 3, None), (7, 3, None), (8, None, 1), (9, None, 2)], "id long, group_id long, created_time long")
    said = spark.createDataFrame([(1, "UPDATE"), (2, "coexist"), (3, "Correct"), (None, "update")], "group_id long, action string")
    kept = similar.resolve(texts, said)
    assert kept.columns == texts.columns
    assert sorted(r.id for r in kept.collect()) == [2, 4, 5, 7, 8, 9]
    assert similar.resolve(texts, said.where("false")).count() == 9
    assert similar.resolve(texts.where("false"), said).count() == 0


def test_purge_archive(spark):
    rows = spark.sql("SELECT 1 AS original_id, timestamp '2020-01-01' AS original_created_time UNION ALL SELECT 2, timestamp '2024-01-01' UNION ALL SELECT 3, null")
    assert sorted(r.original_id for r in lifecycle.purge_archive(rows, F.lit("2023-01-01").cast("timestamp")).collect()) == [2, 3]
    assert lifecycle.purge_archive(rows).count() == 0
