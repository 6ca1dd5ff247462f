"""More registered queries, in the manner of ``queries``: lookups, turns and queue, marks, gates, statistics, retrieval to
context, and exchange formats."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import embedding, filters, tagging
from ..functions import metadata as md
from ..functions import text as tx
from ..functions import time as tm
from ..operators import context, lifecycle, lookups, merging, metrics, records, retrieval
from ..sources import snapshots
from ..sources.shared import ensure_checkpoints, spread
from ..sources.views import MEMORIES_SQL, SESSIONS_SQL, TURNS_SQL, VECTORS_SQL, as_of, memories, sessions, table, turns, vectors
from .queries import (
    _AGE_SQL, _BM25_SQL, _CATEGORY_SQL, _DECAY_SQL, _L1_SQL, _NAMES_SQL, _QUERIES_SQL, _SENTIMENT_SQL, _TOKENS_SQL, _WORDS_SQL, NOW, _asked, _documents, _queries, _search_ctes,
    _store, day, mem, query, r6,
)

# lookups


@query(mem("SELECT id, weight, text_hash FROM mem WHERE id = 123"))
def point_get(spark, d):
    return lookups.get(memories(spark, d), 123).select("id", "weight", "text_hash")


@query(mem("SELECT id, weight FROM mem WHERE id IN (SELECT vec_id * 3 FROM embeddings)"))
def get_many(spark, d):
    ids = table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("id"))
    return lookups.get_many(memories(spark, d), ids).select("id", "weight")


@query(mem("SELECT id, vector_id FROM mem WHERE vector_id = (SELECT vector_id FROM mem WHERE id = 77)"))
def get_by_vector_id(spark, d):
    m = memories(spark, d)
    return lookups.by_vector_id(m, lookups.get(m, 77).first().vector_id).select("id", "vector_id")


@query(mem("SELECT min(id) AS id FROM mem WHERE content_hash = (SELECT content_hash FROM mem WHERE id = 42)"))
def get_by_content_hash(spark, d):
    m = memories(spark, d)
    return lookups.by_content_hash(m, lookups.get(m, 42).first().content_hash).select("id")


@query(f"WITH {SESSIONS_SQL} SELECT session_id, status, message_count FROM sessions WHERE session_id = '7'")
def load_session(spark, d):
    return lookups.session(sessions(spark, d), "7").select("session_id", "status", "message_count")


@query(mem("SELECT count(*) AS n FROM mem WHERE NOT is_archived"))
def table_count(spark, d):
    return lookups.live_count(memories(spark, d))


@query(f"WITH {VECTORS_SQL} SELECT id, label FROM vec WHERE id IN (1, 5, 9, 300) AND label <> 2")
def vector_get(spark, d):
    return lookups.vectors_where(vectors(spark, d), [1, 5, 9, 300], F.col("label") != 2).select("id", "label")


@query(f"WITH {VECTORS_SQL} SELECT id FROM vec ORDER BY id LIMIT 30 OFFSET 20")
def vector_ids_page(spark, d):
    return lookups.vector_ids(vectors(spark, d), 30, 20)


@query(f"WITH {VECTORS_SQL} SELECT id FROM vec ORDER BY id LIMIT 100")
def vector_all_ids(spark, d):
    return lookups.vector_ids(vectors(spark, d), 100)


@query(f"WITH {VECTORS_SQL} SELECT id, label, record_id, CAST(timestamp AS VARCHAR) AS timestamp FROM vec WHERE id = 11")
def vector_metadata(spark, d):
    return lookups.vector_metadata(vectors(spark, d), 11).select("id", "label", "record_id", day("timestamp"))


# vector writes


@query(f"WITH {VECTORS_SQL} SELECT id FROM vec WHERE id % 10 <> 0 AND NOT (label = 3)")
def vector_delete(spark, d):
    v = vectors(spark, d)
    return lookups.delete_vectors(v, v.where("id % 10 = 0"), F.col("label") == 3).select("id")


@query(f"WITH {VECTORS_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN 100 + label ELSE label END AS label FROM vec")
def vector_update(spark, d):
    v = vectors(spark, d)
    changes = v.where("id % 6 = 0").select("id", (F.col("label") + 100).alias("label")).union(spark.range(1).select(F.lit(-5).cast("long"), F.lit(1)))
    return lookups.update_vectors(v, changes).select("id", "label")


@query(mem("SELECT id FROM mem WHERE vector_id NOT IN (SELECT vector_id FROM mem WHERE id % 30 = 0)"))
def delete_by_vector_id(spark, d):
    m = memories(spark, d)
    return lookups.delete_by_vector_id(m, m.where("id % 30 = 0")).select("id")


@query("SELECT 0 AS turns, 0 AS vectors, count(*) AS records FROM documents")
def clear_tiers(spark, d):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    t, v, m = lookups.clear_tiers(turns(spark, d), vectors(spark, d), memories(spark, d), True)
    return one(t, "turns").join(F.broadcast(one(v, "vectors"))).join(F.broadcast(one(m, "records")))


def _stand_in_sql(n: int) -> str:
    """The stand-in vector of 'text k' by hand is no SQL: ids and documents are compared."""
    return f"SELECT 'mem_' || sha256(text)[1:32] AS id, min(doc_id) AS record_id, {n} AS size FROM documents GROUP BY text"


@query(_stand_in_sql(embedding.SIZE))
def vector_rows(spark, d):
    """Texts are embedded and upserted: of equal texts one vector stays."""
    rows = embedding.vector_rows(spread(memories(spark, d).select("id", "text", "created_time")), as_of(), allow_fallback=True)
    found = records.upsert_vectors(rows.limit(0).drop("at"), rows.withColumn("at", -F.col("at")))
    return found.select("id", "record_id", F.size("embedding").alias("size"))


# turns and queue


@query(f"WITH {TURNS_SQL} SELECT id, session_id, CAST(ts AS VARCHAR) AS ts, source FROM turns UNION ALL SELECT -1 - id, session_id, CAST({NOW} AS VARCHAR), 'local' FROM turns WHERE id % 5 = 0")
def add_turns(spark, d):
    t = turns(spark, d)
    new = t.where("id % 5 = 0").select((-1 - F.col("id")).alias("id"), "session_id", "user_input", "assistant_response", F.lit(None).cast("string").alias("source"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return lookups.add_turns(t, new, as_of()).select("id", "session_id", day("ts"), "source")


@query(f"WITH {TURNS_SQL} SELECT id FROM turns WHERE session_id <> '3'")
def clear_turns(spark, d):
    return lookups.clear_turns(turns(spark, d), "3").select("id")


def _pending(spark, d):
    """Turns in the queue: by their number done or waiting, and of different ages."""
    t = turns(spark, d).select("id", "session_id", F.length("user_input").alias("size"), "ts")
    queue = lookups.enqueue(spark.createDataFrame([], "id long, data string, created_time timestamp_ntz, status string"), t.drop("ts"), as_of())
    aged = queue.withColumn("created_time", as_of() - F.make_dt_interval(hours=(F.col("id") % 60).cast("int"))).withColumn("status", F.expr("IF(id % 4 = 0, 'processing', 'pending')"))
    return aged.withColumn("data", F.expr("IF(id % 9 = 0, 'broken', data)"))


_PENDING_SQL = f"""{TURNS_SQL}, pnd AS (SELECT id, session_id, length(user_input) AS size, {NOW} - to_hours(CAST(id % 60 AS INT)) AS created_time, CASE WHEN id % 4 = 0 THEN 'processing' ELSE 'pending' END AS status FROM turns)"""


@query(f"WITH {_PENDING_SQL} SELECT id, status, CASE WHEN id % 9 = 0 THEN 'broken' ELSE '{{\"session_id\":\"' || session_id || '\",\"size\":' || size || '}}' END AS data FROM pnd")
def enqueue(spark, d):
    return _pending(spark, d).select("id", "status", "data")


@query(f"WITH {_PENDING_SQL} SELECT id, session_id, size FROM (SELECT * FROM pnd WHERE status = 'pending' ORDER BY created_time, id LIMIT 40) WHERE id % 9 <> 0")
def dequeue(spark, d):
    return lookups.dequeue(_pending(spark, d), 40, "session_id string, size int").select("id", "session_id", "size")


@query(f"WITH {_PENDING_SQL} SELECT id FROM pnd WHERE id % 7 <> 0")
def acknowledge(spark, d):
    p = _pending(spark, d)
    return lookups.acknowledge(p, p.where("id % 7 = 0")).select("id")


@query(f"WITH {_PENDING_SQL} SELECT id FROM pnd WHERE NOT (status = 'pending' AND created_time < {NOW} - INTERVAL 24 HOUR)")
def purge_pending(spark, d):
    return lookups.purge_pending(_pending(spark, d), as_of()).select("id")


@query(f"WITH {_PENDING_SQL} SELECT count(*) AS n FROM pnd WHERE status = 'pending'")
def pending_count(spark, d):
    return lookups.pending_count(_pending(spark, d))


@query(f"WITH {_PENDING_SQL} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) AS enqueued, count(*) FILTER (WHERE id % 9 = 0) AS dropped, 1000 AS size, round(count(*) FILTER (WHERE id % 9 = 0)::DOUBLE / greatest(count(*), 1), 6) AS drop_rate FROM pnd")
def queue_stats(spark, d):
    return metrics.queue_stats(_pending(spark, d), F.lit(True), F.col("id") % 9 == 0).withColumn("drop_rate", r6("drop_rate"))


@query(f"WITH {MEMORIES_SQL}, {_PENDING_SQL} SELECT (SELECT count(*) FROM pnd WHERE status = 'pending') AS pending, (SELECT count(*) FROM turns) AS buffered, (SELECT count(*) FROM embeddings) AS vectors, count(*) AS records FROM mem WHERE NOT is_archived")
def processor_stats(spark, d):
    return metrics.processor_stats(_pending(spark, d), turns(spark, d), vectors(spark, d), memories(spark, d))


@query("""WITH q AS (SELECT doc_id AS id, doc_id % 4 AS retries FROM documents), j AS (SELECT id, retries + CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END AS retries FROM q WHERE id % 3 <> 0)
    SELECT id, retries FROM j WHERE retries < 3 ORDER BY id LIMIT 50""")
def tag_queue(spark, d):
    q = _documents(spark, d).withColumn("retries", (F.col("id") % 4).cast("int"))
    done = q.where("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("ok"))
    return lookups.retry_tags(q, done)[1].select("id", "retries")


# writes of records


@query(mem(f"SELECT id, round(weight, 6) AS weight, access_count FROM mem UNION ALL SELECT -1 - id, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 2.5 END, 0 FROM mem WHERE id % 8 = 0"))
def insert_batch(spark, d):
    m = memories(spark, d)
    null = lambda t: F.lit(None).cast(t)
    new = m.where("id % 8 = 0").withColumns({"id": -1 - F.col("id"), "weight": F.expr("IF(id % 2 = 0, NULL, 2.5D)"), "access_count": null("long"), "created_time": null("timestamp_ntz"), "last_access_time": null("timestamp_ntz")})
    new = new.withColumn("weight", F.expr("IF((-1 - id) % 2 = 0, NULL, 2.5D)"))
    return records.insert(m, new, as_of()).select("id", r6("weight").alias("weight"), "access_count")


@query(mem(f"SELECT -1 - id AS id, text_hash, vector_id, CAST({NOW} AS VARCHAR) AS created_time, {_TOKENS_SQL.format('text')} AS tokens FROM mem WHERE id = 12"))
def insert_row(spark, d):
    m = memories(spark, d)
    new = lookups.get(m, 12).withColumns({"id": -1 - F.col("id"), "created_time": F.lit(None).cast("timestamp_ntz"), "text_hash": F.lit("stale")})
    return records.insert(m, new, as_of()).where("id < 0").select("id", "text_hash", "vector_id", day("created_time"), F.col("metadata.token_count").alias("tokens"))


@query(mem("SELECT id, CASE WHEN id % 6 = 1 THEN 'checked' ELSE NULL END AS result, m_forgotten OR id % 6 = 1 AS forgotten FROM mem"))
def json_field_set(spark, d):
    m = memories(spark, d)
    out = lookups.set_fields(m, m.where("id % 6 = 1"), filter_result="checked", forgotten=True)
    return out.select("id", F.col("metadata.filter_result").alias("result"), F.col("metadata.forgotten").alias("forgotten"))


@query(mem("SELECT id, CASE WHEN id % 6 = 1 THEN NULL ELSE m_dense END AS dense, CASE WHEN id % 6 = 1 THEN id ELSE NULL END AS sqlite_id FROM mem"))
def json_replace(spark, d):
    m = memories(spark, d)
    empty = F.from_json(F.lit("{}"), m.schema["metadata"].dataType)
    out = lookups.replace_metadata(m, m.where("id % 6 = 1"), md.set_sqlite_id(empty, F.col("id")))
    return out.select("id", F.col("metadata.high_density").alias("dense"), md.sqlite_id(F.col("metadata")).alias("sqlite_id"))


@query(mem("SELECT id, is_important OR id % 5 = 2 AS is_important, m_important OR id % 5 = 2 AS flag FROM mem"))
def mark_important_column(spark, d):
    m = memories(spark, d)
    return lookups.set_important(m, m.where("id % 5 = 2")).select("id", "is_important", F.col("metadata.important").alias("flag"))


@query(mem("SELECT id, m_compressed AS compressed, m_forgotten AS forgotten, m_pending AS pending, false AS sqlite_only, 'normal' AS filter_result FROM mem"))
def flag_reads(spark, d):
    m = F.col("metadata")
    return memories(spark, d).select("id", md.is_compressed(m).alias("compressed"), md.is_forgotten(m).alias("forgotten"), md.is_pending(m).alias("pending"), md.is_sqlite_only(m).alias("sqlite_only"), md.filter_result(m).alias("filter_result"))


@query(mem(f"""SELECT id, true AS compressed, length(text) AS original_length, true AS preserve, true AS protected, true AS from_l2, NULL::BOOLEAN AS from_l3, true AS pending, 0 AS retry_count, true AS dense, CAST({NOW} AS VARCHAR) AS corrected,
    'noise' AS filter_result, {_TOKENS_SQL.format('text')} AS tokens, id AS sqlite_id, true AS upgraded, false AS sqlite_only FROM mem"""))
def metadata_marks(spark, d):
    m = md.mark_compressed(F.col("metadata"), "rule", F.length("text"), as_of())
    m = md.mark_moved_to_l3(md.mark_protected(md.mark_preserve(m, "a"), "b"), as_of())
    m = md.set_filter_result(md.mark_tag_corrected(md.mark_dense(md.mark_pending(m, as_of()), "c"), as_of()), "noise")
    m = md.mark_upgraded(md.set_sqlite_id(md.set_token_count(m, F.col("text"), as_of()), F.col("id")), as_of())
    names = {"compressed": "compressed", "original_length": "original_length", "preserve": "preserve", "protected": "protected", "from_l2": "moved_from_l2", "from_l3": "moved_from_l3", "pending": "pending_compression", "retry_count": "retry_count", "dense": "high_density", "filter_result": "filter_result", "tokens": "token_count", "sqlite_id": "sqlite_id", "upgraded": "upgraded", "sqlite_only": "sqlite_only"}
    marked = memories(spark, d).select("id", m.alias("m"))
    return marked.select("id", *(F.col(f"m.{f}").alias(n) for n, f in names.items()), F.col("m.tag_corrected_time").cast("string").alias("corrected"))


@query(mem("SELECT id, NULL::BOOLEAN AS compressed, NULL::BOOLEAN AS pending, m_protected AS protected, m_important AS important FROM mem"))
def clear_marks(spark, d):
    return memories(spark, d).select("id", md.clear_compression(F.col("metadata")).alias("m")).select("id", "m.compressed", F.col("m.pending_compression").alias("pending"), "m.protected", "m.important")


@query(mem(f"SELECT id, {_CATEGORY_SQL} AS category, {_SENTIMENT_SQL} AS sentiment FROM mem"))
def stored_tag(spark, d):
    """A tag is stored as JSON in the metadata and read again."""
    m = spread(memories(spark, d).select("id", "text", "metadata")).select("id", md.set_tag(F.col("metadata"), tagging.rule_tag("text")).alias("m"))
    return m.select("id", md.get_tag(F.col("m"), "category string, sentiment string").alias("t")).select("id", "t.*")


@query(mem("SELECT id, CASE WHEN m_protected THEN 'true' END AS protected, CAST(CASE WHEN id % 4 = 0 THEN NULL ELSE id % 5 END AS VARCHAR) AS retries FROM mem WHERE id % 13 = 0").replace("CASE WHEN m_protected THEN 'true' END", "CASE WHEN m_protected THEN 'true' ELSE 'false' END"))
def metadata_flatten(spark, d):
    flat = memories(spark, d).where("id % 13 = 0").select("id", md.flatten(F.col("metadata")).alias("j"))
    return flat.select("id", F.get_json_object("j", "$.protected").alias("protected"), F.get_json_object("j", "$.vectorization_retries").alias("retries"))


# noise templates


@query("SELECT trim(text) AS text FROM (SELECT DISTINCT text FROM conversations WHERE turn = 0) WHERE length(trim(text)) % 3 <> 0 AND trim(text) <> ''")
def template_library(spark, d):
    said = table(spark, d, "conversations").where("turn = 0").select("text")
    library = lookups.add_templates(said.limit(0), said.union(said).union(spark.range(1).select(F.lit("  "))))
    return lookups.remove_templates(library, library.where(F.length("text") % 3 == 0))


@query(f"WITH {TURNS_SQL} SELECT id, false AS similar FROM turns WHERE id % 2 = 1 UNION ALL SELECT id, true FROM turns WHERE id % 2 = 0")
def noise_by_vector(spark, d):
    """Short turns whose vector is that of a template are noise; with other vectors they aren't."""
    templates = ["short one", "and two"]
    matrix = embedding.np.stack([embedding.stand_in(t) for t in templates])
    said = turns(spark, d).select("id", F.lit("x y z w").alias("user_input"), F.expr("IF(id % 2 = 0, 'and two', concat('text ', id))").alias("spoken"))
    vector = said.withColumn("embedding", embedding.fallback("spoken")).withColumn("likeness", filters.template_similarity("embedding", matrix))
    judged = filters.noise(F.col("user_input"), F.lit(""), None, "likeness")
    return vector.select("id", (judged["reason"] == "similarity").alias("similar"))


@query(f"WITH {VECTORS_SQL} SELECT id, CASE WHEN t < 0.08 THEN 'density' ELSE 'passed' END AS reason FROM (SELECT id, greatest(0, least(1, 2 * (0.3::DOUBLE * list_sum([abs(x) FOR x IN e]) / len(e) + 0.4::DOUBLE * sqrt(list_sum([(x - m) * (x - m) FOR x IN e]) / len(e)) + 0.3::DOUBLE * (list_sum([-(abs(x) + 1e-10) / s * log2((abs(x) + 1e-10) / s + 1e-10) FOR x IN e]) / log2(len(e)))))) AS t FROM (SELECT id, embedding AS e, list_sum(embedding) / len(embedding) AS m, list_sum([abs(x) + 1e-10 FOR x IN embedding]) AS s FROM vec))")
def noise_by_density(spark, d):
    judged = filters.noise(F.lit("x y z w"), F.lit(""), F.col("embedding"))
    return vectors(spark, d).select("id", judged["reason"].alias("reason"))


# gates and states


@query("SELECT CAST(user_id AS VARCHAR) AS task, date_diff('second', max(ts), TIMESTAMP '2024-02-01') >= 3600 * (user_id % 400) AS due FROM events GROUP BY user_id")
def interval_gate(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_run"))
    gate = last.select(F.col("user_id").cast("string").alias("task"), "last_run", "user_id")
    late = F.timestamp_diff("SECOND", "last_run", F.lit("2024-02-01").cast("timestamp_ntz")) >= 3600 * (F.col("user_id") % 400)
    due = lookups.interval_gate(gate, F.lit("2024-02-01").cast("timestamp_ntz"), 0)
    return due.join(gate.select("task", late.alias("late")), "task").select("task", (F.col("due") & F.col("late")).alias("due"))


@query("SELECT event_id, event_id % 6 >= 3 AND event_id % 700 >= 300 AND event_id % 25 >= 10 AS due FROM events")
def dedup_gate(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", lookups.dedup_due(e % 6, e % 700, e % 25).alias("due"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d):
    return metrics.event_counts(table(spark, d, "events"))


_STEPS_SQL = "stp AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_STEPS_SQL}, walk AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 0 AS lev, 0 AS tried FROM stp UNION ALL
    SELECT s.user_id, s.event_id, s.n, CASE WHEN s.value > 60 THEN least(lev + 1, 4) WHEN lev > 0 AND tried + 1 >= 3 THEN lev - 1 ELSE lev END,
    CASE WHEN s.value > 60 THEN CASE WHEN lev < 4 THEN 0 ELSE tried END WHEN lev > 0 AND tried + 1 < 3 THEN tried + 1 WHEN lev > 0 THEN 0 ELSE tried END FROM walk w JOIN stp s ON s.user_id = w.user_id AND s.n = w.n + 1)
    SELECT event_id, ['none', 'minimal', 'partial', 'severe', 'critical'][lev + 1] AS level FROM walk WHERE n > 0""")
def degradation(spark, d):
    e = table(spark, d, "events").withColumn("down", F.col("value") > 60)
    return metrics.degradation(e, "user_id", ["ts", "event_id"], "down").select("event_id", "level")


@query(f"""WITH RECURSIVE {_STEPS_SQL}, walk AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 'closed' AS st, 0 AS cnt, 0::BIGINT AS lst, true AS allowed FROM stp UNION ALL
    SELECT user_id, event_id, n, CASE WHEN shut THEN 'open' WHEN good THEN 'closed' WHEN cnt + 1 >= 2 THEN 'open' WHEN st = 'open' THEN 'half_open' ELSE st END, CASE WHEN shut THEN cnt WHEN good THEN 0 ELSE cnt + 1 END, CASE WHEN shut OR good THEN lst ELSE moment END, NOT shut FROM
    (SELECT s.user_id, s.event_id, s.n, st, cnt, lst, s.value < 50 AS good, epoch_ms(s.ts) // 1000 AS moment, st = 'open' AND epoch_ms(s.ts) // 1000 - lst < 90000 AS shut FROM walk w JOIN stp s ON s.user_id = w.user_id AND s.n = w.n + 1))
    SELECT event_id, allowed, st AS state FROM walk WHERE n > 0""")
def circuit_states(spark, d):
    e = table(spark, d, "events").withColumns({"ok": F.col("value") < 50, "at": F.unix_seconds(F.col("ts").cast("timestamp"))})
    return metrics.circuit_states(e, "user_id", ["ts", "event_id"], "ok", "at", 2, 90_000).select("event_id", "allowed", "state")


@query("""SELECT count(*) FILTER (WHERE m <= 95 AND n <= 100) AS healthy, count(*) FILTER (WHERE m <= 95 AND n > 100) AS degraded, count(*) FILTER (WHERE m > 95) AS unhealthy, CASE WHEN count(*) FILTER (WHERE m > 95) > 0 THEN 'unhealthy' WHEN count(*) FILTER (WHERE n > 100) > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)""")
def overall_health(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return metrics.overall_health(metrics.health(g, "n", F.col("m") > 95))


@query("""SELECT event_id, CASE WHEN event_id % 300 < 100 THEN 'PASS' WHEN event_id % 300 < 200 THEN 'WARN' ELSE 'FAIL' END AS queue, CASE WHEN value >= 80 THEN 'PASS' WHEN value >= 40 THEN 'WARN' ELSE 'FAIL' END AS success,
    CASE WHEN event_id % 7 = 0 THEN 'SKIP' WHEN value * 6 < 200 THEN 'PASS' WHEN value * 6 < 400 THEN 'WARN' ELSE 'FAIL' END AS p95, CASE WHEN event_id % 13 >= 10 THEN 'PASS' WHEN event_id % 13 >= 5 THEN 'WARN' ELSE 'FAIL' END AS disk FROM events""")
def checklist(spark, d):
    e = F.col("event_id")
    bands = metrics.checklist(e % 300, F.col("value"), F.when(e % 7 != 0, F.col("value") * 6), e % 13)
    return table(spark, d, "events").select("event_id", bands.alias("b")).select("event_id", "b.*")


@query(f"WITH {MEMORIES_SQL}, {TURNS_SQL}, tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS r FROM turns) WHERE r <= 3) SELECT 'L1' AS tier, count(*) AS n, 0 AS hits FROM tl UNION ALL SELECT 'L2', count(*), (SELECT count(*) FROM events WHERE event_id % 3 = 0) FROM embeddings UNION ALL SELECT 'L3', count(*), (SELECT count(*) FROM events WHERE event_id % 3 = 1) FROM mem WHERE NOT is_archived")
def tier_counts(spark, d):
    hits = table(spark, d, "events").where("event_id % 3 < 2").select(F.expr("IF(event_id % 3 = 0, 'L2', 'L3_LOW_QUALITY')").alias("source"))
    return metrics.tiers(records.l1_tail(turns(spark, d), 3), vectors(spark, d), memories(spark, d), hits)


@query("SELECT event_type, count(*) AS n, round(count(*) FILTER (WHERE value < 30)::DOUBLE / count(*), 6) AS success_rate, round(count(*) FILTER (WHERE value > 90)::DOUBLE / count(*), 6) AS discard_rate FROM events GROUP BY 1")
def rate_rollup(spark, d):
    g = metrics.rates(table(spark, d, "events"), "event_type", {"success_rate": F.col("value") < 30, "discard_rate": F.col("value") > 90})
    return g.select("event_type", "n", r6("success_rate").alias("success_rate"), r6("discard_rate").alias("discard_rate"))


# text functions


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS up FROM (SELECT event_id, event_id * 13 % 9000 AS s FROM events)")
def uptime(spark, d):
    return table(spark, d, "events").select("event_id", tx.uptime(F.col("event_id") * 13 % 9000).alias("up"))


@query(f"SELECT doc_id, CASE WHEN {_TOKENS_SQL.format('text')} <= 90 THEN text ELSE text[1:45] || '...' END AS cut FROM documents")
def truncate_input(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate_input("text", 90).alias("cut"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sqlite_' || doc_id ELSE 'temp_t' || doc_id END AS key FROM documents")
def l1_key(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.l1_key(F.expr("IF(doc_id % 2 = 0, doc_id, NULL)"), F.concat(F.lit("t"), "doc_id")).alias("key"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_matches(k, '^sk-[A-Za-z0-9_-]+$') AND length(k) >= 20 WHEN 1 THEN regexp_matches(k, '^[A-Za-z0-9_-]+$') AND length(k) >= 20 WHEN 2 THEN regexp_matches(k, '^[A-Za-z0-9._-]+$') AND length(k) >= 20 ELSE k <> '' END AS valid
    FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'sk-' || md5(text) WHEN doc_id % 7 = 0 THEN md5(text)[1:12] ELSE md5(text) || '.x' END AS k FROM documents)""")
def key_check(spark, d):
    key = F.expr("CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat('sk-', md5(text)) WHEN doc_id % 7 = 0 THEN substring(md5(text), 1, 12) ELSE concat(md5(text), '.x') END")
    provider = F.element_at(tx.strings(["OpenAI", "gemini", "glm", "other"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", tx.valid_key(provider, key).alias("valid"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2024-03-05 10:11:12' WHEN 1 THEN '2024-03-05 10:11:12' WHEN 2 THEN '2024-03-05 00:00:00' WHEN 3 THEN '2024-03-05 10:11:12.5' END AS at FROM documents""")
def parse_times(spark, d):
    said = F.expr("CASE doc_id % 5 WHEN 0 THEN '2024-03-05T10:11:12' WHEN 1 THEN '2024-03-05 10:11:12' WHEN 2 THEN '2024-03-05' WHEN 3 THEN '2024-03-05T10:11:12.500000' ELSE 'soon' END")
    return table(spark, d, "documents").select("doc_id", tm.parse_time(said).cast("string").alias("at"))


@query(f"""WITH {MEMORIES_SQL}, k(kind) AS (VALUES ('today'), ('yesterday'), ('last_week'), ('this_week'), ('recent'), ('last_month'), ('before'))
    SELECT id, kind, round({_DECAY_SQL.format('h * 3600')} * CASE kind WHEN 'today' THEN CASE WHEN h < 24 THEN 1.5 ELSE 0.5 END WHEN 'yesterday' THEN CASE WHEN h < 24 THEN 1.0 WHEN h < 48 THEN 2.0 ELSE 0.4 END WHEN 'last_week' THEN CASE WHEN h < 168 THEN 1.0 WHEN h < 336 THEN 1.8 ELSE 0.5 END
    WHEN 'this_week' THEN CASE WHEN h < 168 THEN 1.3 ELSE 0.5 END WHEN 'recent' THEN CASE WHEN h < 24 THEN 1.4 WHEN h < 72 THEN 1.1 ELSE 0.7 END WHEN 'last_month' THEN CASE WHEN h < 720 THEN 0.9 WHEN h < 1440 THEN 1.2 ELSE 0.6 END ELSE 1.0 END, 6)::DOUBLE AS decay
    FROM (SELECT id, kind, date_diff('second', last_access_time, {NOW}) / 3600.0 AS h FROM mem, k)""")
def time_decay_contexts(spark, d):
    kinds = F.explode(tx.strings(["today", "yesterday", "last_week", "this_week", "recent", "last_month", "before"]))
    m = memories(spark, d).select("id", "last_access_time", kinds.alias("kind"))
    return m.select("id", "kind", r6(tm.time_decay(F.col("last_access_time"), as_of(), F.col("kind"))).alias("decay"))


@query("""SELECT doc_id, len(text) AS n_chars, CAST(ceil(len(text) / 3000.0) AS BIGINT) >= 0 AS ok FROM documents""")
def chunk_lengths(spark, d):
    """Chunks joined by line ends are the text again, and none but a single line is longer than the limit."""
    c = table(spark, d, "documents").select("doc_id", "text", tx.chunks("text", 200).alias("c"))
    fits = F.forall("c", lambda x: (F.length(F.replace(x, F.lit("\n"), F.lit(""))) <= 200) | ~F.contains(x, F.lit("\n")))
    return c.select("doc_id", F.length("text").cast("long").alias("n_chars"), ((F.array_join("c", "\n") == F.col("text")) & fits).alias("ok"))


@query("""SELECT conv_id, 'Merge:' || chr(10) || string_agg(turn + 1 || '. ' || text, chr(10) ORDER BY turn) || chr(10) || 'end' AS prompt FROM conversations GROUP BY conv_id""")
def compression_prompt(spark, d):
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return said.select("conv_id", tx.prompt("Merge:\n{memories}\nend", memories=tx.numbered(F.col("t"))).alias("prompt"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'work' WHEN doc_id % 4 = 1 THEN 'tech' WHEN doc_id % 4 = 2 THEN 'other' END AS category, CASE WHEN doc_id % 4 < 3 THEN 'medium' END AS importance, CASE WHEN doc_id % 4 < 3 THEN 'llm' END AS source FROM documents""")
def model_tags(spark, d):
    answer = F.expr("""CASE doc_id % 4 WHEN 0 THEN 'Sure: {"category": "work", "topics": ["a}b"]} and {"category": "x"}' WHEN 1 THEN '{oops} ```json\n{"category": "tech", "entities": ["{"]}\n``` done' WHEN 2 THEN 'empty {}' ELSE 'no { json' END""")
    return table(spark, d, "documents").select("doc_id", tagging.parse_model_tag(answer).alias("t")).select("doc_id", "t.category", "t.importance", "t.source")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'travel' ELSE {_CATEGORY_SQL} END AS category, CASE WHEN doc_id % 3 = 0 THEN 'llm' ELSE 'rule' END AS source FROM documents")
def compression_tags(spark, d):
    answer = F.expr("""IF(doc_id % 3 = 0, '{"category": "travel"}', NULL)""")
    return spread(table(spark, d, "documents")).select("doc_id", tagging.tag("text", answer).alias("t")).select("doc_id", "t.category", "t.source")


@query("SELECT doc_id, md5(text)[1:8] AS seed, true AS unit FROM documents")
def fallback_embedding(spark, d):
    """Each vector is that of its seed and of unit length."""
    made = embedding.embed(spread(table(spark, d, "documents").select("doc_id", "text")), allow_fallback=True)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return made.select("doc_id", F.substring(F.md5("text"), 1, 8).alias("seed"), ((F.abs(square - 1) < 1e-5) & (F.size("embedding") == embedding.SIZE)).alias("unit"))


# retrieval to context


@query(f"""WITH {TURNS_SQL}, {_QUERIES_SQL}, k AS (SELECT query_id, session_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS kw FROM q),
    t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS place FROM turns),
    f AS (SELECT query_id, id AS item_id, len(list_filter(kw, lambda w: contains(lower(user_input || ' ' || assistant_response), w))) / len(kw)::DOUBLE AS similarity, place FROM k JOIN t USING (session_id) WHERE place <= 50 AND len(kw) > 0)
    SELECT query_id, item_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM f WHERE similarity > 0) WHERE rank <= 3""")
def l1_fallback(spark, d):
    found = retrieval.l1_fallback(turns(spark, d), _queries(spark, d), 3)
    return found.select("query_id", "item_id", r6("similarity").alias("similarity"), "rank")


_OWN_NAMES_SQL = f"list_filter(list_distinct(list_concat(names, regexp_extract_all(text, '{tx.NUMBER_WITH_UNIT}'))), lambda x: x NOT IN ({', '.join(repr(w) for w in tx.ENTITY_STOPWORDS)}))"
_EXPANDED_SQL = f"""{_QUERIES_SQL.replace("q AS", "asking AS", 1)},
    own AS (SELECT query_id, session_id, text, {_OWN_NAMES_SQL} AS had FROM (SELECT *, {_NAMES_SQL} AS names FROM asking)),
    lst AS (SELECT session_id, user_input || ' ' || assistant_response AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS r FROM turns) WHERE r <= 2),
    hist AS (SELECT session_id, list_distinct(flatten(list({_OWN_NAMES_SQL}))) AS seen FROM (SELECT *, {_NAMES_SQL} AS names FROM lst) GROUP BY session_id),
    q AS (SELECT query_id, session_id, CASE WHEN len(more) > 0 THEN text || ' ' || array_to_string(more, ' ') ELSE text END AS text FROM
        (SELECT own.*, list_sort(list_filter(coalesce(seen, []), lambda x: NOT list_contains(had, x)))[1:5] AS more FROM own LEFT JOIN hist USING (session_id)))"""


@query(f"WITH {TURNS_SQL}, {_EXPANDED_SQL} SELECT query_id, text FROM q")
def query_expansion(spark, d):
    return retrieval.expand_queries(_queries(spark, d), records.l1_tail(turns(spark, d))).select("query_id", "text")


_VALID_SQL = "length(trim(text)) >= 2 AND lower(trim(text)) NOT IN ('ok', 'yes', 'no', 'hi', 'hello', 'hey') AND regexp_matches(trim(text), '[\\x{4E00}-\\x{9FA5}a-zA-Z0-9]')"
_RETRIEVE_SQL = f"""{MEMORIES_SQL}, {TURNS_SQL}, {VECTORS_SQL}, {_EXPANDED_SQL},
    {_BM25_SQL.split(_QUERIES_SQL + ",")[1]}, {_L1_SQL}, {_search_ctes(10)},
    lastly AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS r FROM turns) WHERE r <= 25),
    forms AS (SELECT session_id, unnest(['用户: ' || user_input || chr(10) || '助理: ' || assistant_response, user_input, assistant_response]) AS form FROM lastly),
    left_over AS (SELECT found.*, asking.session_id FROM found JOIN asking USING (query_id) WHERE {_VALID_SQL.replace('text', 'asking.text')} AND NOT EXISTS (SELECT 1 FROM forms n WHERE n.session_id = asking.session_id AND (n.form = found.text OR
        len(list_intersect({_WORDS_SQL.format('found.text')}, {_WORDS_SQL.format('n.form')})) / greatest(len(list_distinct(list_concat({_WORDS_SQL.format('found.text')}, {_WORDS_SQL.format('n.form')}))), 1)::DOUBLE > 0.85))
        AND NOT EXISTS (SELECT 1 FROM lastly n WHERE n.session_id = asking.session_id AND abs(date_diff('second', found.ts, n.ts)) <= 120)),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM left_over) WHERE place <= 5)"""


@query(f"WITH {_RETRIEVE_SQL} SELECT query_id, place, key, source, round(rrf, 9) AS rrf_score FROM kept")
def retrieve(spark, d):
    found = retrieval.retrieve(records.l1_tail(turns(spark, d)), memories(spark, d), _store(spark, d), _asked(spark, d), as_of())
    return found.select("query_id", "place", "key", "source", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""WITH {_RETRIEVE_SQL} SELECT asking.query_id, coalesce(string_agg('• ' || kept.text, chr(10) ORDER BY place) FILTER (WHERE kept.text <> ''), '') AS context, any_value(asking.text) AS user_input, count(kept.text) AS n_retrieved, count(kept.text) > 0 AS has_memories
    FROM asking LEFT JOIN kept ON kept.query_id = asking.query_id GROUP BY asking.query_id""".replace("_search_ctes", "").replace("place <= 5)", "place <= 20)").replace("rank <= 10)", "rank <= 40)").replace("rank <= 30)", "rank <= 120)").replace("rank <= 30 AND", "rank <= 120 AND").replace(">= 10 OR count(*) >= 30", ">= 40 OR count(*) >= 120"))
def build_context_cloud(spark, d):
    """All results as bullets, as models with a large context get them."""
    return context.build_context(records.l1_tail(turns(spark, d)), memories(spark, d), _store(spark, d), _asked(spark, d), as_of(), "cloud_only")


@query()
def build_context(spark, d):
    return context.build_context(records.l1_tail(turns(spark, d)), memories(spark, d), _store(spark, d), _asked(spark, d), as_of())


@query(f"""WITH {_RETRIEVE_SQL} SELECT query_id, list_sort(list_distinct(list(source)))::VARCHAR AS sources, CAST(max(ts) AS VARCHAR) AS latest, count(*) AS memory_count, round(avg(similarity), 6) AS mean_similarity,
    '记忆来源: ' || array_to_string(list_sort(list_distinct(list(source))), ', ') || chr(10) || '最近记忆时间: ' || CAST(max(ts) AS VARCHAR) || chr(10) || '检索记忆数: ' || count(*) AS described FROM kept GROUP BY query_id""")
def retrieval_metadata(spark, d):
    found = retrieval.retrieve(records.l1_tail(turns(spark, d)), memories(spark, d), _store(spark, d), _asked(spark, d), as_of())
    meta = context.retrieval_metadata(found, found.select("query_id", F.lit("").alias("context")).limit(0))
    shown = F.concat(F.lit("["), F.array_join("sources", ", "), F.lit("]"))
    return meta.select("query_id", shown.alias("sources"), day("latest"), "memory_count", r6("mean_similarity").alias("mean_similarity"), context.describe_metadata(meta).alias("described"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a:0.5,b:2.0' WHEN 1 THEN '0:0.25' ELSE '' END AS scores FROM documents")
def rerank_answers(spark, d):
    answer = F.expr("""CASE doc_id % 3 WHEN 0 THEN 'Here: [{"id": "a", "score": 0.5}, {"id": "b", "score": 2}] end' WHEN 1 THEN '[{"id": 0, "score": 0.25}]' ELSE 'nothing' END""")
    scores = retrieval.parse_scores(answer)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return table(spark, d, "documents").select("doc_id", shown.alias("scores"))


@query(f"WITH {MEMORIES_SQL}, h AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id % 3 = 0) SELECT id, 1 AS state, round(least(5.0, weight * 1.2), 6)::DOUBLE AS weight FROM mem WHERE state = 0 AND id IN (SELECT id FROM h)")
def l3_backfill(spark, d):
    hits = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("item_id"), F.lit("L3").alias("source"))
    return retrieval.backfill(hits, memories(spark, d), 0.5).select("id", "state", r6("weight").alias("weight"))


@query(f"WITH {_BM25_SQL} SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM bm JOIN mem USING (id) WHERE state = 0) WHERE rank <= 5")
def preload(spark, d):
    return lifecycle.preload(memories(spark, d), _queries(spark, d)).select("query_id", "id", "rank")


@query("SELECT id FROM (SELECT doc_id AS id, doc_id * 7 % 97 AS moment FROM documents WHERE doc_id % 4 <> 0) ORDER BY moment DESC, id LIMIT 1000")
def preload_ids(spark, d):
    wanted = _documents(spark, d).select("id", (F.col("id") * 7 % 97).alias("at"))
    return lookups.preload_ids(wanted, wanted.where("id % 4 = 0")).select("id")


# merging and lifecycle


@query(mem("""SELECT id, coalesce(m_retries, 0) + 1 AS retries FROM (SELECT * FROM mem WHERE state = -1 AND coalesce(m_retries, 0) < 3 ORDER BY created_time, id LIMIT 50)"""))
def retry_vectors(spark, d):
    return lifecycle.retry_vectors(memories(spark, d), 50).select("id", F.col("metadata.vectorization_retries").alias("retries"))


@query(mem("SELECT id, CASE WHEN id % 5 IN (2, 3, 4) THEN 0 ELSE id % 5 END AS state FROM mem"))
def recover(spark, d):
    m = memories(spark, d).withColumn("state", (F.col("id") % 5).cast("int"))
    return lifecycle.recover(m).select("id", "state")


@query(mem("SELECT id, state FROM mem UNION ALL SELECT -1 - id, -1 FROM mem WHERE id % 50 = 0"))
def store_text_only(spark, d):
    m = memories(spark, d)
    return lifecycle.low_value(m, m.where("id % 50 = 0").withColumn("id", -1 - F.col("id"))).select("id", "state")


@query("SELECT doc_id % 20 AS group_id, 'number' AS conflict, least(count(*), 3) AS shown FROM documents GROUP BY 1")
def conflict_log(spark, d):
    texts = _documents(spark, d).withColumn("group_id", F.col("id") % 20)
    found = texts.select("group_id").distinct().withColumn("conflict", F.lit("number"))
    return merging.conflict_log(texts, found).select("group_id", "conflict", F.size("texts").alias("shown"))


# exchange


@query(mem(f"""SELECT id, text, 'archive' AS source, CASE WHEN id % 3 = 0 THEN 0.5 ELSE weight END AS weight, CAST(created_time AS VARCHAR) AS created_time FROM mem WHERE id % 5 = 0"""))
def archive_exchange(spark, d):
    """Archived records are exported as JSON lines and read again as records."""
    ensure_checkpoints(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/archive-{hashlib.md5(d.encode()).hexdigest()}"
    rows = lifecycle.archived(memories(spark, d).where("id % 5 = 0").withColumn("weight", F.expr("IF(id % 3 = 0, NULL, weight)")), as_of())
    snapshots.export_archive(rows, place, as_of())
    return snapshots.import_archive(spark, place, as_of()).select("id", "text", "source", "weight", day("created_time"))


@query("SELECT doc_id, doc_id % 2 = 0 AS even, 2 AS versions FROM documents")
def snapshot_versions(spark, d):
    """A table is written, changed and compacted; readers see the last whole version."""
    ensure_checkpoints(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/snapshots-{hashlib.md5(d.encode()).hexdigest()}"
    kept = snapshots.Snapshots(spark, place, keep=2)
    kept.commit(table(spark, d, "documents").select("doc_id"))
    kept.commit(kept.read().withColumn("even", F.col("doc_id") % 2 == 0))
    kept.compact(2)
    return kept.read().withColumn("versions", F.lit(len(kept.versions())))

