"""The registered queries of the library's own operators, each with its SQL where SQL can express it.

A query is a function of (spark, sf_dir); numbers are rounded to six places and times are text, on both sides."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters, tagging
from ..functions import metadata as md
from ..functions import text as tx
from ..functions import time as tm
from ..operators import context, lifecycle, merging, metrics, records, retrieval, similar
from ..schema import CONFIG
from ..sources.shared import settled, spread
from ..sources.views import MEMORIES_SQL, SESSIONS_SQL, TURNS_SQL, VECTORS_SQL, as_of, memories, sessions, table, turns, vectors
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-07-01'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def mem(body: str) -> str:
    return f"WITH {MEMORIES_SQL} {body}"


def r6(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def day(c: str):
    return F.col(c).cast("string").alias(c)


# scans


@query(mem(f"SELECT id, weight FROM mem WHERE weight < 0.6 AND state = 1 AND NOT is_archived ORDER BY weight, last_access_time, id LIMIT 20"))
def low_weight(spark, d):
    return records.low_weight(memories(spark, d), 20).select("id", "weight")


@query(mem(f"SELECT id, weight FROM mem WHERE weight >= 3.0 AND state = 0 AND NOT is_archived AND last_access_time >= {NOW} - INTERVAL 7 DAY ORDER BY weight DESC, last_access_time DESC, id LIMIT 20"))
def high_weight(spark, d):
    return records.high_weight(memories(spark, d), as_of(), 20).select("id", "weight")


@query(mem(f"SELECT id, weight FROM mem WHERE weight >= 2.5 AND state = -1 AND NOT is_archived AND last_access_time >= {NOW} - INTERVAL 7 DAY ORDER BY weight DESC, last_access_time DESC, id LIMIT 20"))
def upgradeable(spark, d):
    return records.upgradeable(memories(spark, d), as_of(), 20).select("id", "weight")


@query(mem("SELECT id, CAST(created_time AS VARCHAR) AS created_time FROM mem WHERE NOT is_archived ORDER BY mem.created_time DESC, id LIMIT 50"))
def recent(spark, d):
    return records.recent(memories(spark, d), 50).select("id", day("created_time"))


@query(mem("SELECT id, CAST(created_time AS VARCHAR) AS created_time FROM mem WHERE NOT is_archived AND state = 1 ORDER BY mem.created_time DESC, id LIMIT 50"))
def recent_vectorised(spark, d):
    return records.recent(memories(spark, d), 50, True).select("id", day("created_time"))


@query(mem(f"SELECT id, CAST(last_access_time AS VARCHAR) AS last_access_time FROM mem WHERE NOT is_archived AND mem.last_access_time < {NOW} - INTERVAL 30 DAY ORDER BY mem.last_access_time, id LIMIT 50"))
def unaccessed(spark, d):
    return records.unaccessed(memories(spark, d), as_of(), 30, 50).select("id", day("last_access_time"))


@query(mem("SELECT id, state FROM mem WHERE state IN (0, 2) AND NOT is_archived ORDER BY created_time DESC, id LIMIT 50"))
def unvectorised(spark, d):
    return records.by_state(memories(spark, d), [0, 2], 50).select("id", "state")


@query(mem("SELECT id, state FROM mem WHERE state = -1 AND NOT is_archived ORDER BY created_time DESC, id LIMIT 50"))
def by_state(spark, d):
    return records.by_state(memories(spark, d), [-1], 50).select("id", "state")


@query(mem("SELECT id, coalesce(m_retries, 0) AS retries FROM mem WHERE state = -1 AND coalesce(m_retries, 0) < 3 ORDER BY created_time, id LIMIT 50"))
def failed_vectors(spark, d):
    return records.failed_vectors(memories(spark, d), 50).select("id", F.coalesce("metadata.vectorization_retries", F.lit(0)).alias("retries"))


@query(mem("SELECT id FROM mem WHERE m_pending AND NOT is_archived ORDER BY id LIMIT 50"))
def pending_compression(spark, d):
    return records.pending_compression(memories(spark, d), 50).select("id")


@query(mem("SELECT id FROM mem WHERE is_important AND NOT is_archived ORDER BY created_time DESC, id LIMIT 50"))
def important(spark, d):
    return records.important(memories(spark, d), 50).select("id")


@query(mem("SELECT id, text_hash FROM mem WHERE session_id = '7' ORDER BY created_time DESC, id LIMIT 50"))
def session_memories(spark, d):
    return records.of_session(memories(spark, d), "7", 50).select("id", "text_hash")


@query(f"WITH {TURNS_SQL} SELECT id, session_id FROM turns ORDER BY ts DESC, id LIMIT 20 OFFSET 10")
def conversation_page(spark, d):
    return records.page(turns(spark, d), 20, 10).select("id", "session_id")


@query(f"WITH {TURNS_SQL} SELECT id, CAST(ts AS VARCHAR) AS ts FROM turns ORDER BY turns.ts DESC, id DESC LIMIT 10")
def recent_conversations(spark, d):
    return records.recent_turns(turns(spark, d), 10).select("id", day("ts"))


@query(f"WITH {TURNS_SQL} SELECT session_id, count(*) AS n FROM turns GROUP BY session_id")
def conversation_counts(spark, d):
    return turns(spark, d).groupBy("session_id").agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL} SELECT id, user_input FROM turns WHERE session_id = '3' ORDER BY ts, id LIMIT 100")
def session_messages(spark, d):
    return turns(spark, d).where("session_id = '3'").orderBy("ts", "id").limit(100).select("id", "user_input")


@query(f"WITH {SESSIONS_SQL} SELECT session_id FROM sessions WHERE status = 'active' ORDER BY updated_time DESC, session_id LIMIT 1")
def latest_session(spark, d):
    return sessions(spark, d).where("status = 'active'").orderBy(F.desc("updated_time"), "session_id").limit(1).select("session_id")


@query(f"WITH {SESSIONS_SQL} SELECT session_id, message_count FROM sessions WHERE status = 'active' ORDER BY updated_time DESC, session_id LIMIT 10")
def active_sessions(spark, d):
    return sessions(spark, d).where("status = 'active'").orderBy(F.desc("updated_time"), "session_id").limit(10).select("session_id", "message_count")


@query(mem("""SELECT id, substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview FROM
    (SELECT * FROM mem WHERE NOT is_archived ORDER BY created_time DESC, id LIMIT 200) WHERE m_forgotten ORDER BY created_time DESC, id LIMIT 20"""))
def forgotten_scan(spark, d):
    return records.forgotten(memories(spark, d), 20).select("id", "preview")


def _rlike_sql(patterns: list[str]) -> str:
    return "regexp_matches(text, '(?i)(?:" + "|".join(patterns).replace("'", "''") + ")')"


def _count_sql(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


_CATEGORY_SQL = "CASE greatest(" + ", ".join(_count_sql(ks) for ks in tagging.CATEGORIES.values()) + ") WHEN 0 THEN 'other' " + " ".join(f"WHEN {_count_sql(ks)} THEN '{name}'" for name, ks in tagging.CATEGORIES.items()) + " END"
_IMPORTANCE_SQL = f"CASE WHEN {_rlike_sql(tagging.HIGH)} THEN 'high' WHEN {_rlike_sql(tagging.LOW)} THEN 'low' ELSE 'medium' END"
_SENTIMENT_SQL = f"CASE WHEN {_count_sql(tagging.POSITIVE)} > {_count_sql(tagging.NEGATIVE)} THEN 'positive' WHEN {_count_sql(tagging.NEGATIVE)} > {_count_sql(tagging.POSITIVE)} THEN 'negative' ELSE 'neutral' END"
_TIME_SQL = _rlike_sql(tagging.TIME)


@query(mem(f"""SELECT id FROM (SELECT * FROM mem WHERE NOT is_archived ORDER BY created_time DESC, id LIMIT 150)
    WHERE {_SENTIMENT_SQL} = 'negative' ORDER BY created_time DESC, id LIMIT 50"""))
def tag_scan(spark, d):
    return records.tag_scan(memories(spark, d), tagging.sentiment("text") == "negative", 50).select("id")


# writes


@query(mem("""SELECT min(id) AS id, text_hash FROM mem WHERE id % 2 = 0 AND text_hash NOT IN (SELECT text_hash FROM mem WHERE id % 2 = 1 AND NOT is_archived) GROUP BY text_hash"""))
def idempotent_insert(spark, d):
    m = memories(spark, d).select("id", "text_hash", "is_archived")
    fresh, _ = records.insert_new(m.where("id % 2 = 1"), m.where("id % 2 = 0"))
    return fresh.select("id", "text_hash")


@query(mem("""SELECT b.id, a.existing_id FROM (SELECT * FROM mem WHERE id % 2 = 0) b JOIN
    (SELECT text_hash, min(id) AS existing_id FROM mem WHERE id % 2 = 1 AND NOT is_archived GROUP BY text_hash) a USING (text_hash)"""))
def exists_by_hash(spark, d):
    m = memories(spark, d).select("id", "text_hash", "is_archived")
    return records.insert_new(m.where("id % 2 = 1"), m.where("id % 2 = 0"))[1].select("id", "existing_id")


@query(mem("SELECT id, round(CASE WHEN id % 3 = 0 THEN least(5.0, weight * 1.2) ELSE weight END, 6) AS weight, access_count + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS access_count FROM mem"))
def boost_weight(spark, d):
    m = memories(spark, d).select("id", "weight", "access_count", "last_access_time")
    return records.boost(m, m.where("id % 3 = 0"), as_of()).select("id", r6("weight").alias("weight"), "access_count")


@query(mem("SELECT id, round(greatest(0.0, least(5.0, weight + CASE WHEN id % 4 = 0 THEN 1.5 WHEN id % 4 = 1 THEN -1.5 ELSE 0 END)), 6) AS weight FROM mem"))
def adjust_weight(spark, d):
    m = memories(spark, d).select("id", "weight")
    changes = m.where("id % 4 < 2").select("id", F.expr("IF(id % 4 = 0, 1.5D, -1.5D)").alias("change"))
    return records.adjust(m, changes).select("id", r6("weight").alias("weight"))


@query(mem("SELECT id, coalesce(m_retries, 0) + 1 AS retries FROM mem WHERE state = -1"))
def retry_increment(spark, d):
    return memories(spark, d).where("state = -1").select("id", md.retry(F.col("metadata"))["vectorization_retries"].alias("retries"))


@query(mem("SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE state END AS state, CASE WHEN id % 5 = 0 THEN 'v' || id ELSE vector_id END AS vector_id FROM mem"))
def state_update(spark, d):
    m = memories(spark, d).select("id", "state", "vector_id")
    updates = m.where("id % 5 = 0").select("id", F.lit(1).alias("state"), F.concat(F.lit("v"), "id").alias("vector_id"))
    return records.set_states(m, updates)


@query(mem("SELECT id, is_archived OR id % 19 = 0 AS is_archived FROM mem"))
def soft_delete(spark, d):
    m = memories(spark, d).select("id", "is_archived")
    return records.archive_flag(m, m.where("id % 19 = 0"))


@query(mem("SELECT id FROM mem WHERE id % 19 <> 0"))
def hard_delete(spark, d):
    m = memories(spark, d).select("id")
    return records.delete(m, m.where("id % 19 = 0"))


@query(f"""WITH {SESSIONS_SQL} SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(n.status, o.status) AS status, coalesce(o.message_count, 0) AS message_count FROM sessions o
    FULL JOIN (SELECT session_id, 'ended' AS status FROM sessions WHERE CAST(session_id AS INT) % 4 = 0 UNION ALL SELECT 'new', 'active') n ON o.session_id = n.session_id""")
def session_upsert(spark, d):
    s = sessions(spark, d).select("session_id", "status", "message_count")
    new = s.where("CAST(session_id AS INT) % 4 = 0").select("session_id", F.lit("ended").alias("status")).union(spark.range(1).select(F.lit("new"), F.lit("active")))
    return records.upsert(s, new, "session_id").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


@query(f"WITH {SESSIONS_SQL} SELECT session_id, status FROM sessions WHERE NOT (status = 'ended' AND updated_time < {NOW} - INTERVAL 30 DAY)")
def purge_sessions(spark, d):
    return records.purge_sessions(sessions(spark, d), as_of()).select("session_id", "status")


@query(f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN session_id = '3' THEN 'ended' ELSE status END AS status FROM sessions")
def end_session(spark, d):
    return records.end_session(sessions(spark, d), "3", "ended", as_of()).select("session_id", "status")


@query(f"""WITH {VECTORS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN -label ELSE label END AS label FROM vec""")
def vector_upsert(spark, d):
    v = vectors(spark, d).select("id", "label")
    return records.upsert_vectors(v, v.where("id % 3 = 0").select("id", (-F.col("label")).alias("label"), F.lit(1).alias("at")))


@query(mem("""SELECT id, CASE WHEN m_important THEN true ELSE id % 4 = 0 END AS important, CASE WHEN id % 4 = 0 THEN 'important' ELSE '' END AS tags FROM mem"""))
def mark_important(spark, d):
    marked = F.when(F.col("id") % 4 == 0, md.mark_important(F.col("metadata"))).otherwise(F.col("metadata"))
    m = memories(spark, d).withColumn("metadata", marked)
    return m.select("id", F.col("metadata.important").alias("important"), F.coalesce(F.array_join("metadata.tags", ","), F.lit("")).alias("tags"))


@query(mem("""SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT k FROM bad WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)) AS n_twice, count(*) FILTER (WHERE k IS NULL) AS n_no_id,
    count(*) FILTER (WHERE t IS NULL) AS n_no_text, count(*) FILTER (WHERE NOT w BETWEEN 0 AND 5) AS n_bad_weight FROM bad""").replace("WITH", "WITH bad AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 50 END AS k, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS t, doc_id % 9 - 1 AS w FROM documents),", 1))
def integrity_check(spark, d):
    broken = table(spark, d, "documents").selectExpr("IF(doc_id % 7 = 0, NULL, doc_id % 50) AS id", "IF(doc_id % 5 = 0, NULL, text) AS text", "CAST(doc_id % 9 - 1 AS DOUBLE) AS weight")
    return records.quality_report(broken)


# marks


@query(mem("""SELECT id, CASE WHEN m_protected THEN 100 WHEN m_forgotten THEN 0 WHEN m_important THEN 80 WHEN m_dense THEN 70 WHEN m_preserve THEN 60 WHEN m_compressed THEN 40 ELSE 20 END AS priority,
    m_protected OR m_dense AS skip_merge, m_protected OR m_important OR m_preserve AS protected, (m_compressed AND NOT m_recompress) OR m_protected OR m_important OR m_preserve AS skip_compression FROM mem"""))
def record_flags(spark, d):
    m = F.col("metadata")
    return memories(spark, d).select("id", md.merge_priority(m).alias("priority"), md.skip_merge(m).alias("skip_merge"), md.is_protected(m).alias("protected"), md.skip_compression(m).alias("skip_compression"))


@query(mem(f"""SELECT id, m_to_l2 AND {NOW} < m_to_l2_time + INTERVAL 24 HOUR AS from_l2, m_from_l3 AND {NOW} < m_from_l3_time + INTERVAL 48 HOUR AS from_l3, m_from_l2 AND {NOW} < m_from_l2_time + INTERVAL 24 HOUR AS back FROM mem"""))
def cooldowns(spark, d):
    m = F.col("metadata")
    return memories(spark, d).select("id", md.cooling_from_l2(m, as_of()).alias("from_l2"), md.cooling_from_l3(m, as_of()).alias("from_l3"), md.cooling_back(m, as_of()).alias("back"))


# text functions


@query("SELECT doc_id, sha256(text)[1:32] AS text_hash, md5(text)[1:16] AS content_hash, 'mem_' || sha256(text)[1:32] AS vector_id FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.text_hash("text").alias("text_hash"), tx.content_hash("text").alias("content_hash"), tx.vector_id("text").alias("vector_id"))


_TOKENS_SQL = "CAST(floor(len(regexp_extract_all({0}, '[\\x{{4E00}}-\\x{{9FFF}}]')) * 1.2::DOUBLE + len(regexp_extract_all({0}, '[\\x00-\\x7F]')) * 0.3::DOUBLE + (length({0}) - len(regexp_extract_all({0}, '[\\x{{4E00}}-\\x{{9FFF}}]')) - len(regexp_extract_all({0}, '[\\x00-\\x7F]'))) * 0.5::DOUBLE) AS BIGINT)"


@query(f"SELECT doc_id, {_TOKENS_SQL.format('text')} AS tokens, {_TOKENS_SQL.format('text')} > 4096 AS over, {_TOKENS_SQL.format('text')} <= 4096 - 100 AS fits FROM documents")
def token_estimate(spark, d):
    e = tx.tokens_with_limit("text", F.lit("other"))
    return spread(table(spark, d, "documents")).select("doc_id", e["n"].alias("tokens"), e["over"].alias("over"), tx.fits("text", F.lit("other")).alias("fits"))


@query(f"""SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE substr(text, 1, CAST(floor((100 - 3)::DOUBLE * length(text) / greatest(n, 1)) AS INT)) || '...' END AS cut
    FROM (SELECT doc_id, text, {_TOKENS_SQL.format('text')} AS n FROM documents)""")
def truncate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate_tokens("text", 100).alias("cut"))


_NUMBER_SQL = r"\d+(?:\.\d+)?(?:元|美元|块|万|千|百|亿|%|％|度|kg|ml|GB|MB|TB)?"
_DATE_SQL = r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?|\d{1,2}月\d{1,2}日"


@query(f"""SELECT doc_id, CASE WHEN stop > 65 THEN head[1:stop + 1] ELSE head END || CASE WHEN len(keys) > 0 THEN ' | 关键信息: ' || array_to_string(keys, ', ') ELSE '' END || '...' AS cut FROM (
    SELECT doc_id, text[1:130] AS head, list_concat(regexp_extract_all(text, '{_NUMBER_SQL}')[1:3], regexp_extract_all(text, '{_DATE_SQL}')[1:2]) AS keys,
    greatest({", ".join(f"CASE WHEN instr(reverse(text[1:130]), '{m}') > 0 THEN length(text[1:130]) - instr(reverse(text[1:130]), '{m}') ELSE -1 END" for m in "。.！？")}) AS stop FROM documents)""")
def smart_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.smart_truncate("text", 300).alias("cut"))


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{_NUMBER_SQL}')) * 2.0::DOUBLE + len(regexp_extract_all(text, '[A-Z][a-z]+|[\x{{4E00}}-\x{{9FA5}}]{{2,4}}(?:公司|项目|产品|版本|系统|模块)')) * 1.5::DOUBLE
    + {" + ".join(f"CAST(contains(text, '{v}') AS INT)" for v in tx.KEY_VERBS)} + len(regexp_extract_all(text, '{_DATE_SQL}|昨天|今天|明天|上周|下周')) * 1.5::DOUBLE AS importance FROM documents""")
def importance_score(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.importance("text").cast("double").alias("importance"))


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN regexp_matches(lower(text), '昨天|今天|上周|之前|刚才|什么时候|何时|when|yesterday|today|before') THEN 'time_related'
    WHEN regexp_matches(lower(text), '是什么|什么是|怎么|如何|为什么|谁|哪|what|how|why|who|which') THEN 'factual'
    WHEN regexp_matches(lower(text), '你好|嗨|哈喽|谢谢|再见|ok|好的|嗯|hello|hi|thanks|bye') THEN 'casual'
    WHEN length(text) > 100 OR len(regexp_extract_all(text, '\\?')) > 1 OR len(regexp_extract_all(text, '？')) > 1 THEN 'complex' ELSE 'default' END AS kind FROM conversations""")
def query_type(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.query_type("text").alias("kind"))


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN regexp_matches(lower(text), '今天|今日|today') THEN 'today' WHEN regexp_matches(lower(text), '昨天|昨日|yesterday') THEN 'yesterday'
    WHEN regexp_matches(lower(text), '上周|last week') THEN 'last_week' WHEN regexp_matches(lower(text), '这周|本周|this week') THEN 'this_week' WHEN regexp_matches(lower(text), '最近|刚才|recently|just now') THEN 'recent'
    WHEN regexp_matches(lower(text), '上个月|上月|last month') THEN 'last_month' WHEN regexp_matches(lower(text), '之前|以前|before|earlier') THEN 'before' ELSE 'any' END AS kind FROM conversations""")
def time_context(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tm.time_context(F.col("text"))["type"].alias("kind"))


@query(mem(f"""SELECT id, CASE WHEN h < 1 THEN 1.0 WHEN h < 6 THEN 0.8 WHEN h < 24 THEN 0.6 WHEN h < 168 THEN 0.4 ELSE 0.2 END AS decay,
    round(CASE WHEN h < 1 THEN 1.0 WHEN h < 6 THEN 0.8 WHEN h < 24 THEN 0.6 WHEN h < 168 THEN 0.4 ELSE 0.2 END * CASE WHEN h < 168 THEN 1.0 WHEN h < 336 THEN 1.8 ELSE 0.5 END, 6) AS last_week
    FROM (SELECT id, date_diff('second', last_access_time, {NOW}) / 3600.0 AS h FROM mem)"""))
def time_decay(spark, d):
    t = F.col("last_access_time")
    return memories(spark, d).select("id", tm.time_decay(t, as_of()).alias("decay"), r6(tm.time_decay(t, as_of(), F.lit("last_week"))).alias("last_week"))


_WORDS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"
_CHARS_SQL = "list_distinct(list_filter(string_split({0}, ''), lambda x: x <> ''))"
_JACCARD = "round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)::DOUBLE, 6)"


@query(f"WITH {TURNS_SQL} SELECT id, {_JACCARD} AS similarity FROM (SELECT id, {_WORDS_SQL.format('user_input')} AS a, {_WORDS_SQL.format('assistant_response')} AS b FROM turns)")
def word_jaccard(spark, d):
    return turns(spark, d).select("id", r6(tx.word_jaccard("user_input", "assistant_response")).alias("similarity"))


@query(f"WITH {TURNS_SQL} SELECT id, {_JACCARD} AS similarity FROM (SELECT id, {_CHARS_SQL.format('user_input')} AS a, {_CHARS_SQL.format('assistant_response')} AS b FROM turns)")
def char_jaccard(spark, d):
    return turns(spark, d).select("id", r6(tx.char_jaccard("user_input", "assistant_response")).alias("similarity"))


@query("""SELECT doc_id, round(least(1.0, c / 3.0 * 0.5 + p / 3.0 * 0.3 + w / 4.5 * 0.2), 6) AS similarity FROM (
    SELECT doc_id, list_sum([CAST(instr(text, k) > 0 AS INT) FOR k IN ['the', 'with', 'que']]) AS c,
    list_sum([CASE WHEN instr(text, k) = 0 THEN 0.0 WHEN instr(text, k) <= 100 THEN 1.0 WHEN instr(text, k) <= 300 THEN 0.7 ELSE 0.5 END FOR k IN ['the', 'with', 'que']])::DOUBLE AS p,
    list_sum([CASE WHEN instr(text, k) = 0 THEN 0.0 WHEN length(k) > 3 THEN 1.5 ELSE 1.0 END FOR k IN ['the', 'with', 'que']])::DOUBLE AS w FROM documents)""")
def keyword_similarity(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(tx.keyword_similarity(tx.strings(["the", "with", "que"]), "text")).alias("similarity"))


@query(r"""SELECT id, CASE WHEN text = '' OR regexp_matches(text, '^[^\p{L}\p{N}_]+$') OR len(w) = 0 THEN '""' ELSE '"' || replace(array_to_string(w, ' '), '"', '""')[1:500] || '"' END AS phrase
    FROM (SELECT conv_id * 1000 + turn AS id, text, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '' AND upper(x) NOT IN ('AND', 'OR', 'NOT', 'NEAR', 'COLUMN')) AS w FROM conversations)""")
def phrase_query(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.phrase_query("text").alias("phrase"))


def _all_sql(pattern: str, text: str = "text", group: int = 0) -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


#: RE2 has no Unicode word boundaries: each character between words is doubled, so that two names may share one, and a
#: name stands between two of them.
_NAMES_SQL = "[replace(replace(x, '  ', ' '), chr(10) || chr(10), chr(10)) FOR x IN regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{Nd}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{Nd}_])([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*|[A-Z]{2,})(?:$|[^\\p{L}\\p{Nd}_])', 1)]"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(list_concat({_all_sql(tx.CJK_NOUN)}, names), {_all_sql(tx.NUMBER_WITH_UNIT)})), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in tx.ENTITY_STOPWORDS)}))), '|') AS entities,
    array_to_string(CASE WHEN len(named) > 0 THEN named ELSE list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 1)[1:5] END, ' ') AS keywords
    FROM (SELECT *, list_concat(list_concat({_all_sql(tx.CJK_NOUN)}[1:3], names[1:2]), {_all_sql(tx.PRELOAD_NUMBER)}[1:2]) AS named FROM (SELECT *, {_NAMES_SQL} AS names FROM documents))""")
def query_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.entities("text"), "|").alias("entities"), tx.preload_keywords("text").alias("keywords"))


@query("""SELECT doc_id, length(text) >= 5 AND list_max([length(text) - length(replace(text, c, '')) FOR c IN list_distinct(list_filter(string_split(text, ''), lambda x: x <> ''))]) / length(text)::DOUBLE > 0.7 AS repetitive FROM documents""")
def repetitive(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.repetitive("text").alias("repetitive"))


@query(r"""SELECT conv_id * 1000 + turn AS id, length(trim(text)) >= 2 AND lower(trim(text)) NOT IN ('ok', 'yes', 'no', 'hi', 'hello', 'hey') AND regexp_matches(trim(text), '[\x{4E00}-\x{9FA5}a-zA-Z0-9]') AS valid FROM conversations""")
def valid_query(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.valid_query("text").alias("valid"))


@query(r"""SELECT doc_id, regexp_matches(text, '```(?:.|\n)*?```|``(?:.|\n)*?``|`[^`]+`|def\s+\w+\s*\(|class\s+\w+|function\s+\w+|import\s+\w+|from\s+\w+\s+import') OR contains(text, '流程图') AS dense FROM documents""")
def high_density(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.dense("text").alias("dense"))


@query("SELECT page_id, regexp_matches(lower(trim(url)), '^https://[^/\\s]+') OR regexp_matches(lower(trim(url)), '^http://(localhost|127\\.0\\.0\\.1)(:[0-9]+)?(/|$)') AS valid FROM pages")
def url_check(spark, d):
    return table(spark, d, "pages").select("page_id", tx.valid_url("url").alias("valid"))


_ENTROPY = "list_sum([-(abs(x) + 1e-10) / t * log2((abs(x) + 1e-10) / t + 1e-10) FOR x IN e]) / log2(len(e))"


@query(f"""WITH {VECTORS_SQL} SELECT id, round(greatest(0, least(1, 2 * (0.3::DOUBLE * list_sum([abs(x) FOR x IN e]) / len(e) + 0.4::DOUBLE * sqrt(list_sum([(x - m) * (x - m) FOR x IN e]) / len(e)) + 0.3::DOUBLE * ({_ENTROPY})))), 6) AS density, round({_ENTROPY}, 6) AS entropy
    FROM (SELECT id, embedding AS e, list_sum(embedding) / len(embedding) AS m, list_sum([abs(x) + 1e-10 FOR x IN embedding]) AS t FROM vec)""")
def information_density(spark, d):
    return vectors(spark, d).select("id", r6(tx.information_density("embedding")).alias("density"), r6(tx.vector_entropy("embedding")).alias("entropy"))


# filters and tags


def _judged(spark, d):
    return _said(spark, d).select("id", filters.noise(F.col("user_input"), F.col("assistant_response")).alias("noise"))


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _matches(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, '" + "|".join(patterns).replace("'", "''") + "')"


def _noise_ctes(source: str) -> str:
    """CTEs that end in ``noise`` (the columns of ``source``, is_noise, reason, confidence, storage)."""
    same = "list_max([length(b) - length(replace(b, c, '')) FOR c IN list_distinct(list_filter(string_split(b, ''), lambda x: x <> ''))]) / length(b)::DOUBLE > 0.7"
    return f"""
    nz AS (SELECT *, trim(coalesce(user_input, '')) AS u, trim(coalesce(assistant_response, '')) AS a, trim(coalesce(user_input, '')) || trim(coalesce(assistant_response, '')) AS b FROM {source}),
    nc AS (SELECT *, {_matches("b", filters.PROTECTED)} OR {_matches("b", filters.EMOTION)} AS is_kept, u IN ({_quoted(filters.TEMPLATES)}) AS is_template,
        CASE WHEN b = '' THEN 0.99 WHEN length(b) <= 2 THEN 0.95 WHEN u IN ({_quoted(filters.KEYWORDS)}) OR a IN ({_quoted(filters.KEYWORDS)}) THEN 0.9 WHEN {_matches("b", [f"^[{filters.INTERJECTIONS}]+$"])} THEN 0.9
        WHEN {_matches("b", filters.PATTERNS)} THEN 0.85 WHEN {_matches("b", [filters.EMOJI])} THEN 0.85 WHEN length(b) >= 5 AND {same} THEN 0.8 END AS c FROM nz),
    noise AS (SELECT * EXCLUDE (u, a, b, is_kept, is_template, c), NOT is_kept AND (is_template OR c IS NOT NULL) AS is_noise, CASE WHEN is_kept THEN 'protected' WHEN is_template THEN 'template' WHEN c IS NOT NULL THEN 'rule' ELSE 'passed' END AS reason,
        CASE WHEN is_kept THEN 0.0 WHEN is_template THEN 0.99 ELSE coalesce(c, 0.0) END::DOUBLE AS confidence,
        CASE WHEN is_kept THEN 'full' WHEN is_template OR c > 0.9 THEN 'discard' WHEN c IS NOT NULL THEN 'sqlite_only' ELSE 'full' END AS storage FROM nc)"""


#: Turns beside short and repeated ones, so that every rule has something to find.
_SAID_SQL = """
    said AS (SELECT id, session_id, ts, CASE id % 11 WHEN 0 THEN '嗯嗯' WHEN 1 THEN '好的' WHEN 2 THEN 'ok' WHEN 3 THEN '123 456' WHEN 4 THEN 'aaaaaaab' WHEN 5 THEN '😀🚀' WHEN 6 THEN ' 花了 30 元 ' ELSE user_input END AS user_input,
        CASE WHEN id % 11 IN (0, 2, 3, 4, 5, 6) THEN '' WHEN id % 11 = 1 THEN '我知道了' ELSE assistant_response END AS assistant_response FROM turns)"""


def _said(spark, d):
    user = F.expr("CASE id % 11 WHEN 0 THEN '嗯嗯' WHEN 1 THEN '好的' WHEN 2 THEN 'ok' WHEN 3 THEN '123 456' WHEN 4 THEN 'aaaaaaab' WHEN 5 THEN '😀🚀' WHEN 6 THEN ' 花了 30 元 ' ELSE user_input END")
    answer = F.expr("CASE WHEN id % 11 IN (0, 2, 3, 4, 5, 6) THEN '' WHEN id % 11 = 1 THEN '我知道了' ELSE assistant_response END")
    return turns(spark, d).withColumns({"user_input": user, "assistant_response": answer})


@query(f"WITH {TURNS_SQL}, {_SAID_SQL}, {_noise_ctes('said')} SELECT id, is_noise, reason, confidence, storage FROM noise")
def noise_filter(spark, d):
    return _judged(spark, d).select("id", "noise.*")


@query(f"WITH {TURNS_SQL}, {_SAID_SQL}, {_noise_ctes('said')} SELECT reason, storage, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM noise GROUP BY 1, 2")
def noise_stats(spark, d):
    return metrics.filter_stats(_judged(spark, d)).withColumn("share", r6("share"))


#: Conditions on the neighbours of a find, which RE2 has no look-arounds for: (before, after), and whether finds may touch.
_AROUND = {"bank_card": ("(^|[^0-9])", "($|[^0-9])", 2), "credit_card": ("(^|[^0-9])", "($|[^0-9])", 2), "ipv4": ("(^|[^0-9])", "($|[^0-9])", 2), "password": ("()", "($|[^0-9A-Za-z_])", 1)}


def _bare_pattern(rule) -> str:
    return rule.pattern.replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace(r"(?!\w)", "")


def _mask_sql(text: str) -> str:
    """The rules one after the other. A find's neighbours are put back; finds that share one take a second turn."""
    for r in filters.RULES:
        before, after, turns_ = _AROUND.get(r.name, ("", "", 1))
        to = re.sub(r"\$(\d)", lambda m: "\\" + str(int(m.group(1)) + bool(before)), r.replacement)
        groups = re.compile(_bare_pattern(r)).groups
        if before:
            to = "\\1" + to + "\\" + str(groups + 2)
        for _ in range(turns_):
            text = f"regexp_replace({text}, '{before}{_bare_pattern(r)}{after}', '{to}', 'g')"
    return text


def _finds_sql(rule, text: str = "text") -> str:
    """All finds of a rule. Where a find's neighbours count, all but digits are doubled, so that two finds may share one."""
    before, after, turns_ = _AROUND.get(rule.name, ("", "", 1))
    if turns_ == 1:
        return f"regexp_extract_all({text}, '{before}({_bare_pattern(rule)}){after}', {2 if before else 1})"
    pattern = _bare_pattern(rule).replace(filters._GAP, "(?:" + filters._GAP[:-1] + "{2})?").replace(r"\.", r"\.\.")
    doubled = f"regexp_replace({text}, '([^0-9])', '\\1\\1', 'g')"
    return f"[replace(x, '..', '.') FOR x IN regexp_extract_all({doubled}, '(?:^|[^0-9])({pattern})(?:$|[^0-9])', 1)]"


@query(f"SELECT doc_id, sha256({_mask_sql('text')}) AS masked_sha256 FROM documents")
def pii_mask(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.sha2(filters.mask("text"), 256).alias("masked_sha256"))


@query("SELECT doc_id, " + ", ".join(f"len({_finds_sql(r)}) AS n_{r.name}" for r in filters.RULES) + " FROM documents")
def pii_counts(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", *filters.detect_counts("text"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, len(f) AS n, array_to_string([x[1:3] || '***' FOR x IN f], ',') AS finds FROM (SELECT doc_id, {_finds_sql(r)} AS f FROM documents)" for r in filters.RULES) + ") WHERE n > 0")
def pii_detect(spark, d):
    found = spread(table(spark, d, "documents")).select("doc_id", filters.detect("text").alias("m")).where(F.size("m") > 0)
    return found.select("doc_id", F.explode("m").alias("rule", "finds")).select("doc_id", "rule", F.size("finds").cast("long").alias("n"), F.array_join("finds", ",").alias("finds"))


@query("SELECT count(*) AS processed, round(count(*) FILTER (WHERE " + " OR ".join(f"len({_finds_sql(r)}) > 0" for r in filters.RULES) + ")::DOUBLE / greatest(count(*), 1), 6) AS mask_rate, " + ", ".join(f"CAST(sum(len({_finds_sql(r)})) AS BIGINT) AS {r.name}" for r in filters.RULES) + " FROM documents")
def pii_stats(spark, d):
    counts = spread(table(spark, d, "documents")).select(*filters.detect_counts("text"))
    some = sum((F.col(f"n_{r.name}") for r in filters.RULES), F.lit(0)) > 0
    return counts.agg(F.count("*").alias("processed"), r6(F.count_if(some) / F.greatest(F.count("*"), F.lit(1))).alias("mask_rate"), *(F.sum(f"n_{r.name}").alias(r.name) for r in filters.RULES))


@query(f"""SELECT doc_id, {_CATEGORY_SQL} AS category, {_IMPORTANCE_SQL} AS importance, {_SENTIMENT_SQL} AS sentiment, {_TIME_SQL} AS time_sensitive,
    round(0.5 + CASE WHEN {_CATEGORY_SQL} <> 'other' THEN 0.2 ELSE 0 END + CASE WHEN {_IMPORTANCE_SQL} <> 'medium' THEN 0.1 ELSE 0 END + CASE WHEN {_SENTIMENT_SQL} <> 'neutral' THEN 0.1 ELSE 0 END + CASE WHEN {_TIME_SQL} THEN 0.1 ELSE 0 END, 6)::DOUBLE AS confidence FROM documents""")
def rule_tags(spark, d):
    t = spread(table(spark, d, "documents")).select("doc_id", tagging.rule_tag("text").alias("tag"))
    return t.select("doc_id", *(F.col(f"tag.{c}").alias(c) for c in ("category", "importance", "sentiment", "time_sensitive", "confidence")))


@query(f"SELECT {_CATEGORY_SQL} AS category, count(*) AS n FROM documents GROUP BY 1")
def category_distribution(spark, d):
    return spread(table(spark, d, "documents")).groupBy(tagging.category("text").alias("category")).agg(F.count("*").alias("n"))


_KEYWORDS = list(dict.fromkeys(k for ks in tagging.CATEGORIES.values() for k in ks))


@query(f"SELECT doc_id, array_to_string(list_filter([{_quoted(_KEYWORDS)}], lambda k: contains(lower(text), k))[1:5], ',') AS topics, array_to_string(list_distinct(list_filter({'list_concat(' * 6}{_all_sql(tagging.ENTITIES[0][0], 'text', 1)}" + "".join(f", {_all_sql(p, 'text', g)})" for p, g in tagging.ENTITIES[1:]) + ", lambda e: length(e) >= 2))[1:10], ',') AS entities FROM documents")
def topics(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(tagging.topics("text"), ",").alias("topics"), F.array_join(tagging.entities("text"), ",").alias("entities"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_CATEGORY_SQL} AS c, {_SENTIMENT_SQL} AS s, {_IMPORTANCE_SQL} AS i, {_TIME_SQL} AS ts FROM conversations),
    cat AS (SELECT conv_id, arg_max(c, (n, -f)) AS category FROM (SELECT conv_id, c, count(*) AS n, min(turn) AS f FROM t GROUP BY 1, 2) GROUP BY 1),
    sen AS (SELECT conv_id, arg_max(s, (n, -f)) AS sentiment FROM (SELECT conv_id, s, count(*) AS n, min(turn) AS f FROM t GROUP BY 1, 2) GROUP BY 1)
    SELECT conv_id, category, sentiment, importance, time_sensitive FROM cat JOIN sen USING (conv_id) JOIN
    (SELECT conv_id, CASE max(CASE i WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS importance, bool_or(ts) AS time_sensitive FROM t GROUP BY 1) USING (conv_id)""")
def tag_merge(spark, d):
    tagged = table(spark, d, "conversations").select("conv_id", "turn", tagging.rule_tag("text").alias("tag"))
    return tagging.merge_tags(tagged, "conv_id", "turn").select("conv_id", "category", "sentiment", "importance", "time_sensitive")


@query(f"SELECT {_CATEGORY_SQL} || '->work' AS pattern, count(*) AS n FROM documents WHERE doc_id % 10 = 0 GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def tag_corrections(spark, d):
    tagged = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), tagging.rule_tag("text").alias("tag"))
    fixes = tagged.where("id % 10 = 0").select("id", F.lit("work").alias("category"), F.lit(1).alias("at"))
    return tagging.correction_patterns(tagging.correct(tagged, fixes))


# retrieval


def _queries(spark, d):
    """The first one, two or three words of each conversation's first user message."""
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select(F.col("conv_id").alias("query_id"), F.col("conv_id").cast("string").alias("session_id"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), F.lit(1), (1 + F.col("conv_id") % 3).cast("int")), " ").alias("text"))


_QUERIES_SQL = r"""
    q AS (SELECT conv_id AS query_id, CAST(conv_id AS VARCHAR) AS session_id, array_to_string(regexp_split_to_array(trim(arg_min(text, turn)), '\s+')[1:1 + conv_id % 3], ' ') AS text
          FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


_L1_SQL = f"""
    k AS (SELECT query_id, session_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS kw FROM q),
    j AS (SELECT query_id, id, ts, kw, '用户: ' || user_input || chr(10) || '助理: ' || assistant_response AS text, lower(user_input) AS u, lower(assistant_response) AS a, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, id DESC) AS tail FROM k JOIN turns USING (session_id)),
    s AS (SELECT query_id, id, ts, text, list_sum([(CASE WHEN length(w) > 4 THEN 3.0 WHEN length(w) > 2 THEN 2.0 ELSE 1.0 END) * (CAST(contains(u, w) AS INT) * 2 + CAST(contains(a, w) AS INT)) FOR w IN kw])::DOUBLE AS score,
        list_sum([CAST(contains(u, w) AS INT) + CAST(contains(a, w) AS INT) FOR w IN kw]) AS hits, list_sum([CASE WHEN length(w) > 4 THEN 3.0 WHEN length(w) > 2 THEN 2.0 ELSE 1.0 END FOR w IN kw])::DOUBLE AS total, len(kw) AS n FROM j WHERE tail <= 25),
    r AS (SELECT query_id, id AS item_id, ts, text, score / (total * 3) * 0.5 + hits / (n * 2)::DOUBLE * 0.3 + (CASE WHEN date_diff('second', ts, {NOW}) < 3600 THEN 1.0 WHEN date_diff('second', ts, {NOW}) < 21600 THEN 0.8 WHEN date_diff('second', ts, {NOW}) < 86400 THEN 0.6 WHEN date_diff('second', ts, {NOW}) < 604800 THEN 0.4 ELSE 0.2 END) * 0.2 AS similarity FROM s WHERE score > 0)"""


@query(f"""WITH {TURNS_SQL}, {_QUERIES_SQL}, {_L1_SQL}
    SELECT query_id, item_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ts DESC, item_id DESC) AS rank FROM r) WHERE rank <= 5""")
def l1_keyword(spark, d):
    found = retrieval.l1_search(records.l1_tail(turns(spark, d)), _queries(spark, d), as_of(), 5)
    return found.select("query_id", "item_id", r6("similarity").alias("similarity"), "rank")


@query(mem("SELECT id, weight FROM mem WHERE NOT is_archived AND (regexp_matches(text, '(?i)worthless') OR regexp_matches(coalesce(compressed_text, ''), '(?i)worthless') OR regexp_matches(text, '(?i)license.') OR regexp_matches(coalesce(compressed_text, ''), '(?i)license.')) ORDER BY weight DESC, last_access_time DESC, id LIMIT 50"))
def like_search(spark, d):
    return retrieval.like_search(memories(spark, d), ["Worthless", "license_"], 50).select("id", "weight")


_BM25_SQL = f"""{MEMORIES_SQL}, {_QUERIES_SQL},
    tok AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(coalesce(compressed_text, '')), '[\\p{{L}}\\p{{N}}]+') AS b FROM mem),
    ph AS (SELECT query_id, len(t) AS n, array_to_string(t, ' ') AS gram FROM (SELECT query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM q) WHERE len(t) > 0),
    grams AS (SELECT id, n, array_to_string(a[i:i + n - 1], ' ') AS gram FROM tok, (SELECT DISTINCT n FROM ph), unnest(range(1, len(a) - n + 2)) AS x(i)
        UNION ALL SELECT id, n, array_to_string(b[i:i + n - 1], ' ') FROM tok, (SELECT DISTINCT n FROM ph), unnest(range(1, len(b) - n + 2)) AS x(i)),
    tf AS (SELECT query_id, id, count(*) AS tf FROM grams JOIN ph USING (n, gram) GROUP BY 1, 2),
    st AS (SELECT count(*) AS rows, avg(len(a) + len(b)) AS mean FROM tok),
    bm AS (SELECT query_id, id, tf, -greatest(ln((rows - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(a) + len(b)) / mean)) AS bm25
        FROM tf JOIN (SELECT query_id, count(*) AS n FROM tf GROUP BY 1) USING (query_id) JOIN tok USING (id), st)"""


@query(f"WITH {_BM25_SQL} SELECT query_id, id, tf, round(bm25, 6) AS bm25, round(1 / (1 + exp(bm25 / 10)), 6) AS similarity FROM bm")
def bm25_phrase(spark, d):
    rounded = lambda found: found.select("phrase", "id", "tf", r6("bm25").alias("bm25"), r6(retrieval.bm25_normalised(F.col("bm25"))).alias("similarity"))
    return retrieval.bm25_phrase(memories(spark, d), _queries(spark, d), rounded)


@query(f"""WITH {_BM25_SQL}, c AS (SELECT query_id, id AS item_id, 1 / (1 + exp(bm25 / 10)) AS s, CASE WHEN state = -1 THEN weight * 0.5 ELSE weight END AS w, CASE WHEN state = -1 THEN 'L3_LOW_QUALITY' ELSE 'L3' END AS source
    FROM bm JOIN mem USING (id) WHERE NOT is_archived AND NOT m_forgotten)
    SELECT query_id, item_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s * w, 9) DESC, item_id) AS rank FROM c) WHERE rank <= 10""")
def l3_search(spark, d):
    return retrieval.l3_search(memories(spark, d), _queries(spark, d), 10).select("query_id", "item_id", "source", "rank")


_VECTOR_SQL = "list_sum([x[1] * x[2] FOR x IN list_zip(v.embedding, q.embedding)])"


def _vector_queries(spark, d):
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query(f"""WITH {VECTORS_SQL} SELECT query_id, id, round(s, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM
    (SELECT q.id AS query_id, v.id, {_VECTOR_SQL} AS s FROM vec v, vec q WHERE q.id % 20 = 0)) WHERE rank <= 10""")
def vector_topk(spark, d):
    return retrieval.vector_top_k(vectors(spark, d), _vector_queries(spark, d), 10).select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank")


@query(f"""WITH {VECTORS_SQL} SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM
    (SELECT q.id AS query_id, v.id, {_VECTOR_SQL} AS s FROM vec v, vec q WHERE q.id % 20 = 0 AND v.label = 1 AND v.record_id >= 0)) WHERE rank <= 10""")
def vector_topk_filtered(spark, d):
    return retrieval.vector_top_k(vectors(spark, d).where("label = 1 AND record_id >= 0"), _vector_queries(spark, d), 10).select("query_id", "id", "rank")


@query()
def vector_topk_lsh(spark, d):
    return retrieval.lsh_top_k(vectors(spark, d), _vector_queries(spark, d), 10).select("query_id", "id", r6("similarity").alias("similarity"), "rank")


def _two_sources(spark, d):
    """Phrase hits and, as a second source, the records of the own session by weight."""
    q, m = _queries(spark, d), memories(spark, d)
    l3 = retrieval.l3_ranked(m, q, 15)
    of = m.where("NOT is_archived").select("session_id", F.col("id").alias("item_id"), F.substring("text", 1, retrieval.KEY).alias("key"), "weight")
    own = q.select("query_id", "session_id").join(of, "session_id")
    l2 = retrieval.top(own.withColumns({"similarity": F.col("weight") / 5, "source": F.lit("L2")}), ["query_id"], [F.desc("weight"), "item_id"], 15)
    columns = ["query_id", "item_id", "key", "similarity", "source", "weight", "rank"]
    return q, m, l3.select(columns).unionByName(l2.select(columns))


_RRF_SQL = f"""{_BM25_SQL}, c AS (SELECT query_id, id AS item_id, text, 1 / (1 + exp(bm25 / 10)) AS s, CASE WHEN state = -1 THEN weight * 0.5 ELSE weight END AS w FROM bm JOIN mem USING (id) WHERE NOT is_archived AND NOT m_forgotten),
    l3 AS (SELECT query_id, text, rank, 0.8 / (60 + rank) AS share, 2 AS o FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s * w, 9) DESC, item_id) AS rank FROM c) WHERE rank <= 15),
    l2 AS (SELECT query_id, text, rank, 1.0 / (60 + rank) AS share, 1 AS o FROM (SELECT q.query_id, mem.text, row_number() OVER (PARTITION BY q.query_id ORDER BY weight DESC, mem.id) AS rank FROM q JOIN mem USING (session_id) WHERE NOT is_archived) WHERE rank <= 15),
    f AS (SELECT query_id, text[1:100] AS key, sum(share) AS rrf, arg_min(text, (o, rank)) AS text, CASE WHEN min(o) = 1 THEN 'L2' ELSE 'L3' END AS family FROM (SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1, 2)"""


@query(f"WITH {_RRF_SQL} SELECT query_id, key, round(rrf, 9) AS rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, key) AS rank FROM f) WHERE rank <= 5")
def rrf_fusion(spark, d):
    _, _, results = _two_sources(spark, d)
    return retrieval.fuse(results, 5).select("query_id", "key", F.round("rrf_score", 9).alias("rrf_score"), "rank")


_TERMS_SQL = "list_distinct(regexp_extract_all(lower({0}), '[\\x{{4E00}}-\\x{{9FA5}}]+|[a-zA-Z]+'))"


@query(f"""WITH {_RRF_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, key) AS r FROM f) WHERE r <= 10),
    b AS (SELECT query_id, key, round(round(rrf, 12) * (1 + least(len(list_intersect({_TERMS_SQL.format('q.text')}, {_TERMS_SQL.format('top.text')})) * 0.1::DOUBLE, 0.3) + CASE family WHEN 'L2' THEN 0.1 ELSE 0 END + 0.05), 12) AS s FROM top JOIN q USING (query_id))
    SELECT query_id, key, round(s, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM b""")
def rule_rerank(spark, d):
    q, m, results = _two_sources(spark, d)
    return retrieval.rerank(retrieval.with_texts(settled(retrieval.fuse(results, 10)), m), q).select("query_id", "key", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def _asked(spark, d):
    """Each conversation's query with a session and, for a vector, that of the store whose place is the query's number."""
    v = vectors(spark, d).select((F.row_number().over(Window.orderBy("id")) - 1).alias("place"), "embedding")
    n = v.agg(F.count("*").alias("n"))  # one row
    asked = _queries(spark, d).join(F.broadcast(n)).withColumn("place", F.expr("query_id % n"))
    return asked.join(v, "place").select("query_id", "session_id", "text", "embedding")


def _store(spark, d):
    return vectors(spark, d).where("record_id >= 0").select(F.col("record_id").alias("id"), "embedding")


def _search_ctes(k: int, ask: str = "q") -> str:
    """CTEs that end in ``found`` (query_id, rank, source, key, text, rrf, ts, similarity, weight) for the queries ``ask``."""
    recall = 3 * k
    return f"""
    placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM vec),
    asked AS (SELECT query_id, embedding FROM {ask} JOIN placed ON place = query_id % (SELECT count(*) FROM vec)),
    l1 AS (SELECT query_id, text, similarity, 'L1' AS source, 1.0::DOUBLE AS weight, rank, ts, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ts DESC, item_id DESC) AS rank FROM r WHERE similarity >= 0.3) WHERE rank <= {recall}),
    enough AS (SELECT query_id FROM l1 GROUP BY 1 HAVING count(*) FILTER (WHERE similarity >= 0.95) >= {k} OR count(*) >= {recall}),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, v.record_id AS id, {_VECTOR_SQL} AS s FROM vec v, asked q WHERE v.record_id >= 0 AND query_id NOT IN (SELECT query_id FROM enough))) WHERE rank <= {recall}),
    l2 AS (SELECT query_id, text, s AS similarity, 'L2' AS source, weight, rank, created_time AS ts, id AS item_id FROM near JOIN mem USING (id) WHERE s >= 0.3 AND NOT m_forgotten),
    cand AS (SELECT query_id, id AS item_id, text, created_time AS ts, 1 / (1 + exp(bm25 / 10)) AS similarity, CASE WHEN state = -1 THEN weight * 0.5 ELSE weight END AS weight, CASE WHEN state = -1 THEN 'L3_LOW_QUALITY' ELSE 'L3' END AS source
        FROM bm JOIN mem USING (id) WHERE NOT is_archived AND NOT m_forgotten AND query_id NOT IN (SELECT query_id FROM enough)),
    l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity * weight, 9) DESC, item_id) AS rank FROM cand) WHERE rank <= {recall} AND similarity >= 0.3),
    every AS (SELECT query_id, text, similarity, source, weight, rank, ts, item_id, 1.2 / (60 + rank) AS share, 0 AS o FROM l1 UNION ALL SELECT *, 1.0 / (60 + rank), 1 FROM l2
        UNION ALL SELECT query_id, text, similarity, source, weight, rank, ts, item_id, 0.8 / (60 + rank), 2 FROM l3),
    fused AS (SELECT query_id, text[1:100] AS key, sum(share) AS rrf, arg_min(text, (o, rank)) AS text, arg_min(source, (o, rank)) AS source, arg_min(ts, (o, rank)) AS ts, arg_min(similarity, (o, rank)) AS similarity, arg_min(weight, (o, rank)) AS weight, arg_min(item_id, (o, rank)) AS item_id FROM every GROUP BY 1, 2),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, key) AS rank FROM fused) WHERE rank <= {k})"""


_DECAY_SQL = "CASE WHEN {0} < 3600 THEN 1.0 WHEN {0} < 21600 THEN 0.8 WHEN {0} < 86400 THEN 0.6 WHEN {0} < 604800 THEN 0.4 ELSE 0.2 END"
_AGE_SQL = f"date_diff('second', ts, {NOW})"


@query(f"WITH {_BM25_SQL}, {TURNS_SQL}, {VECTORS_SQL}, {_L1_SQL}, {_search_ctes(5)} SELECT query_id, rank, source, key, round(rrf, 9) AS rrf_score, round(similarity * similarity * {_DECAY_SQL.format(_AGE_SQL)} * weight, 6)::DOUBLE AS combined_score FROM found")
def hybrid_search(spark, d):
    found = retrieval.search(records.l1_tail(turns(spark, d)), memories(spark, d), _store(spark, d), _asked(spark, d), as_of())
    return found.select("query_id", "rank", "source", "key", F.round("rrf_score", 9).alias("rrf_score"), r6("combined_score").alias("combined_score"))


def _results(spark, d):
    """Turns of two sessions side by side as results, a part of which the tail holds."""
    t = turns(spark, d)
    text = F.concat(F.lit("用户: "), "user_input", F.lit("\n助理: "), "assistant_response")
    return t.select(F.col("id").alias("item_id"), F.lit(1).alias("query_id"), "session_id", text.alias("text"), F.expr("ts + make_dt_interval(0, 0, CAST(id % 7 AS INT), 0)").alias("ts"))


@query(f"""WITH {TURNS_SQL}, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS r FROM turns) WHERE r <= 2),
    known AS (SELECT session_id, unnest(['用户: ' || user_input || chr(10) || '助理: ' || assistant_response, user_input, assistant_response]) AS form FROM tail),
    own AS (SELECT id, session_id, '用户: ' || user_input || chr(10) || '助理: ' || assistant_response AS text FROM turns)
    SELECT 1 AS query_id, id AS item_id FROM own o WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.session_id = o.session_id AND (n.form = o.text OR
        len(list_intersect({_WORDS_SQL.format('o.text')}, {_WORDS_SQL.format('n.form')})) / greatest(len(list_distinct(list_concat({_WORDS_SQL.format('o.text')}, {_WORDS_SQL.format('n.form')}))), 1)::DOUBLE > 0.85))""")
def l1_anti_join(spark, d):
    tail = records.l1_tail(turns(spark, d), 2)
    return retrieval.drop_known(_results(spark, d), tail).select("query_id", "item_id")


@query(f"""WITH {TURNS_SQL}, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS r FROM turns) WHERE r <= 2)
    SELECT id AS item_id FROM turns o WHERE NOT EXISTS (SELECT 1 FROM tail n WHERE n.session_id = o.session_id AND abs(date_diff('second', o.ts + to_minutes(CAST(o.id % 7 AS INT)), n.ts)) <= 120)""")
def time_window_anti(spark, d):
    return retrieval.outside_window(_results(spark, d), records.l1_tail(turns(spark, d), 2)).select("item_id")


# duplicates and merging


@query("SELECT doc_id AS id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents) WHERE doc_id <> keep_id")
def exact_duplicates(spark, d):
    return similar.exact_duplicates(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(mem(f"SELECT id, keep_id FROM (SELECT id, min(id) OVER (PARTITION BY text) AS keep_id FROM mem WHERE created_time >= {NOW} - INTERVAL 90 DAY) WHERE id <> keep_id"))
def exact_duplicates_since(spark, d):
    return similar.exact_duplicates(memories(spark, d).select("id", "text", "created_time"), since=as_of() - records.days(90))


@query("SELECT id, keep_id FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS keep_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) WHERE id <> keep_id AND r <= 1000")
def incremental_duplicates(spark, d):
    return similar.incremental_duplicates(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_MINHASH_SQL = """
    txt AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text),
    wrd AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}_]+') AS w FROM txt),
    tkn AS (SELECT DISTINCT id, unnest(list_concat(w, [w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))])) AS t FROM wrd),
    sig AS (SELECT id, i, min(md5(i || '_' || t)) AS h FROM tkn, range(64) AS x(i) GROUP BY 1, 2),
    whole AS (SELECT id, list(h ORDER BY i) AS s FROM sig GROUP BY 1),
    bnd AS (SELECT id, i, array_to_string(s[i * 4 + 1:i * 4 + 4], '') AS h FROM whole, range(16) AS x(i)),
    cnd AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bnd x JOIN bnd y ON x.i = y.i AND x.h = y.h AND x.id < y.id),
    pairs AS (SELECT a, b, similarity FROM (SELECT a, b, len(list_filter(range(1, 65), lambda i: x.s[i] = y.s[i])) / 64::DOUBLE AS similarity FROM cnd JOIN whole x ON x.id = a JOIN whole y ON y.id = b) WHERE similarity >= 0.8)"""


def _groups_sql(nodes: str) -> str:
    """The leaders of a scan of ``nodes`` in order of id over ``pairs``, one row after the other."""
    return f"""
    nds AS (SELECT id, row_number() OVER (ORDER BY id) AS n, (SELECT coalesce(list(a), []) FROM pairs WHERE b = nodes.id) AS smaller FROM {nodes} nodes),
    walk AS (SELECT 0::BIGINT AS n, [-1]::BIGINT[] AS lead UNION ALL SELECT nds.n, CASE WHEN list_has_any(lead, smaller) THEN lead ELSE list_append(lead, id) END FROM walk JOIN nds ON nds.n = walk.n + 1),
    done AS (SELECT lead FROM walk ORDER BY n DESC LIMIT 1)
    SELECT id, coalesce(list_min(list_intersect(smaller, lead)), id) AS leader FROM nds, done"""


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_MINHASH_SQL} SELECT a, b, similarity FROM pairs")
def minhash_pairs(spark, d):
    return similar.minhash_pairs(_documents(spark, d), 0.8).select("a", "b", r6("similarity").alias("similarity"))


@query(f"WITH RECURSIVE {_MINHASH_SQL}, {_groups_sql('(SELECT doc_id AS id FROM documents)')}")
def minhash_groups(spark, d):
    m = _documents(spark, d)
    return similar.greedy_leaders(m, similar.minhash_pairs(m, 0.8))


def _vector_rows(spark, d):
    """Vectors with the beginnings, of different lengths, of their records' texts."""
    v = vectors(spark, d).where("record_id >= 0").select("id", "embedding", F.col("timestamp").alias("created_time"))
    return v.join(_documents(spark, d), "id").withColumn("text", F.expr("substring(text, 1, CAST(id % 300 AS INT))"))


_LIMIT = "CASE WHEN length({0}) < 20 THEN 0.33 WHEN length({0}) > 200 THEN 0.85 ELSE 0.3 END"
_VECTOR_PAIRS_SQL = f"""{VECTORS_SQL}, own AS (SELECT vec.*, text[1:id % 300] AS text FROM vec JOIN documents ON doc_id = id WHERE record_id >= 0),
    pairs AS (SELECT v.id AS a, q.id AS b FROM own v JOIN own q ON v.id < q.id AND abs(date_diff('second', v.timestamp, q.timestamp)) <= 86400 WHERE {_VECTOR_SQL} >= greatest({_LIMIT.format('v.text')}, {_LIMIT.format('q.text')}))"""


@query(f"WITH {_VECTOR_PAIRS_SQL} SELECT a, b FROM pairs")
def vector_pairs(spark, d):
    return similar.vector_pairs(_vector_rows(spark, d), 0.3).select("a", "b")


@query(f"WITH RECURSIVE {_VECTOR_PAIRS_SQL}, {_groups_sql('own')}")
def vector_groups(spark, d):
    rows = _vector_rows(spark, d)
    return similar.greedy_leaders(rows, similar.vector_pairs(rows, 0.3))


@query(r"""WITH g AS (SELECT doc_id % 150 AS group_id, text FROM documents),
    f AS (SELECT DISTINCT group_id, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM g),
    t AS (SELECT DISTINCT group_id, unnest(regexp_extract_all(text, 'the [a-z]{6}|[0-9]{2}[a-z]+')) AS v FROM g WHERE group_id % 3 = 0)
    SELECT group_id, 'time' AS conflict FROM t GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT group_id, 'number' FROM f WHERE group_id NOT IN (SELECT group_id FROM t GROUP BY 1 HAVING count(*) > 1) GROUP BY 1 HAVING count(*) > 1""")
def conflicts(spark, d):
    texts = table(spark, d, "documents").select((F.col("doc_id") % 150).alias("group_id"), "text")
    thirds = texts.where("group_id % 3 = 0")
    found = similar.conflicts(thirds, times=["the [a-z]{6}", "[0-9]{2}[a-z]+"], numbers=["[0-9]+"])
    return found.union(similar.conflicts(texts.where("group_id % 3 <> 0"), numbers=["[0-9]+"]))


def _members(spark, d):
    """Records of equal text as groups."""
    m = memories(spark, d)
    same = m.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n >= 2").select("h", "text", "group_id")
    return m.withColumn("h", F.xxhash64("text")).join(same, ["h", "text"]).drop("h")


#: Groups of two merge here, as the tables hold few larger ones. Texts of a group are equal, so that they conflict only if one
#: of them holds two dates.
_PAIRS_MERGE = dataclasses.replace(CONFIG, merge_min_group=2)
_MERGED_SQL = """
    grp AS (SELECT *, min(id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n, NOT (m_protected OR m_dense) AS joins,
        CASE WHEN m_protected THEN 100 WHEN m_forgotten THEN 0 WHEN m_important THEN 80 WHEN m_dense THEN 70 WHEN m_preserve THEN 60 WHEN m_compressed THEN 40 ELSE 20 END AS p FROM mem),
    mrg AS (SELECT group_id, arg_min(id, (-p, created_time, id)) FILTER (WHERE joins) AS id, max(weight) AS weight, CAST(sum(access_count) AS BIGINT) AS access_count,
        CASE WHEN any_value(length(text)) <= 500 THEN any_value(text) ELSE any_value(text)[1:497] || '...' END AS text, list(id ORDER BY -p, created_time, id) FILTER (WHERE joins) AS ids,
        max(m_to_l2_time) FILTER (WHERE joins) AS latest, arg_min(m_to_l2_time, (-p, created_time, id)) FILTER (WHERE joins) AS promoted, bool_or(m_forgotten) FILTER (WHERE joins) AS had_forgotten FROM grp
        WHERE n >= 2 AND len(list_distinct(regexp_extract_all(text, '\\d{4}[-/年]\\d{1,2}[-/月]\\d{1,2}[日号]?'))) <= 1 GROUP BY group_id HAVING count(*) FILTER (WHERE joins) >= 2)"""


@query(mem("""SELECT group_id, id, text, weight, access_count, array_to_string(ids, ',') AS merged_ids, array_to_string(list_filter(ids, lambda x: x <> id), ',') AS deleted, had_forgotten, CAST(promoted AS VARCHAR) AS promoted FROM mrg""").replace("FROM documents\n    )", "FROM documents\n    ), " + _MERGED_SQL))
def merge_groups(spark, d):
    merged = merging.merge_groups(_members(spark, d), as_of(), _PAIRS_MERGE)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return merged.select("group_id", "id", "text", "weight", "access_count", joined("metadata.merged_ids").alias("merged_ids"), joined("deleted_ids").alias("deleted"), "had_forgotten", F.col("metadata.promoted_time").cast("string").alias("promoted"))


@query(mem("""SELECT mem.id, coalesce(mrg.weight, mem.weight) AS weight, CASE WHEN mrg.id IS NULL THEN state ELSE 0 END AS state, coalesce(mrg.access_count, mem.access_count) AS access_count, md5(coalesce(mrg.text, mem.text)) AS text_md5
    FROM mem LEFT JOIN mrg ON mem.id = mrg.id WHERE mem.id NOT IN (SELECT unnest(list_filter(ids, lambda x: x <> id)) FROM mrg)""").replace("FROM documents\n    )", "FROM documents\n    ), " + _MERGED_SQL))
def apply_merge(spark, d):
    merged = merging.merge_groups(_members(spark, d), as_of(), _PAIRS_MERGE)
    return merging.apply_merge(memories(spark, d), merged).select("id", "weight", "state", "access_count", F.md5("text").alias("text_md5"))


# lifecycle


_FREE = "NOT is_archived AND NOT is_important AND NOT is_protected"
_DECAYED = f"CASE WHEN created_time < {NOW} - INTERVAL 30 DAY AND weight > 0.3 AND {_FREE} THEN weight * 0.95 ELSE weight END"


@query(mem(f"SELECT id, round({_DECAYED}, 6) AS weight FROM mem"))
def decay(spark, d):
    return lifecycle.decay(memories(spark, d), as_of()).select("id", r6("weight").alias("weight"))


@query(mem(f"SELECT id, vector_id FROM (SELECT *, {_DECAYED} AS w FROM mem) WHERE w < 0.3 AND state = 1 AND coalesce(vector_id, '') <> '' AND NOT is_important AND NOT is_protected"))
def forget(spark, d):
    return lifecycle.forget(lifecycle.decay(memories(spark, d), as_of()))[1]


@query(mem(f"""SELECT id FROM (SELECT * FROM mem WHERE weight < 0.6 AND state = 1 AND NOT is_archived ORDER BY weight, last_access_time, id LIMIT 20)
    WHERE NOT (m_to_l2 AND {NOW} < m_to_l2_time + INTERVAL 24 HOUR) AND NOT (m_from_l3 AND {NOW} < m_from_l3_time + INTERVAL 48 HOUR)"""))
def l2_to_l3(spark, d):
    return lifecycle.to_text_store(memories(spark, d), as_of())[1].select("id")


@query(mem(f"""SELECT id FROM (SELECT * FROM mem WHERE weight >= 3.0 AND state = 0 AND NOT is_archived AND last_access_time >= {NOW} - INTERVAL 7 DAY ORDER BY weight DESC, last_access_time DESC, id LIMIT 10)
    WHERE NOT (m_from_l2 AND {NOW} < m_from_l2_time + INTERVAL 24 HOUR)"""))
def l3_to_l2(spark, d):
    return lifecycle.to_vector_store(memories(spark, d), as_of())[1]


@query(mem(f"""SELECT id, CASE WHEN id IN (SELECT id FROM mem WHERE weight >= 2.5 AND state = -1 AND NOT is_archived AND last_access_time >= {NOW} - INTERVAL 7 DAY ORDER BY weight DESC, last_access_time DESC, id LIMIT 10) THEN 1 ELSE state END AS state FROM mem"""))
def upgrade(spark, d):
    return lifecycle.upgrade(memories(spark, d), as_of())[0].select("id", "state")


_LATIN = ["license", "password", "the"]


@query(rf"""SELECT doc_id, CASE WHEN len(k) > 0 AND length(array_to_string(k[1:5], '')) < length(text) * 0.7::DOUBLE THEN array_to_string(k[1:5], '') WHEN length(text) > 2000 THEN text[1:2000] || '...' END AS short FROM (
    SELECT doc_id, text, list_transform(list_filter(list_transform(s, lambda x, i: {{'x': x, 'i': i}}), lambda e: list_position(s, e.x) = e.i), lambda e: e.x) AS k FROM (
    SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN trim(x[1:length(x) - 1]) || right(x, 1) ELSE trim(x) END), lambda x: NOT regexp_matches(x, '^[.!?]?$') AND regexp_matches(x, 'license|password|the')) AS s FROM documents))""")
def rule_compress(spark, d):
    return table(spark, d, "documents").select("doc_id", lifecycle.rule_compress("text", CONFIG, _LATIN, ".!?").alias("short"))


_DENSE_SQL = _matches("text", [tx.CODE.replace(r"[\s\S]", r"(?:.|\n)"), *tx.DENSE_PHRASES])
_SHORT_SQL = f"""list_filter(list_transform(regexp_extract_all(text, '[^。！？\n]*[。！？\n]|[^。！？\n]+$'), lambda x: CASE WHEN regexp_matches(x, '[。！？\n]$') THEN trim(x[1:length(x) - 1]) || right(x, 1) ELSE trim(x) END), lambda x: NOT regexp_matches(x, '^[。！？\n]?$') AND {_matches('x', lifecycle.KEY_WORDS)})"""
_COMPRESS_SQL = f"""
    srt AS (SELECT *, CASE WHEN len(k) > 0 AND length(array_to_string(k[1:5], '')) < length(text) * 0.7::DOUBLE THEN array_to_string(k[1:5], '') WHEN length(text) > 2000 THEN text[1:2000] || '...' END AS short FROM
        (SELECT *, list_transform(list_filter(list_transform(s, lambda x, i: {{'x': x, 'i': i}}), lambda e: list_position(s, e.x) = e.i), lambda e: e.x) AS k FROM (SELECT *, {_SHORT_SQL} AS s FROM mem)))"""


def _due_sql(source: str) -> str:
    return f"""(SELECT id, text, short, CASE WHEN {_DENSE_SQL} THEN 'preserved' WHEN length(short) < length(text) * 0.6 THEN 'compressed' ELSE 'pending' END AS outcome FROM
        (SELECT * FROM {source} WHERE NOT is_archived AND last_access_time < {NOW} - INTERVAL 15 DAY ORDER BY last_access_time, id LIMIT 50)
        WHERE NOT ((m_compressed AND NOT m_recompress) OR m_protected OR m_important OR m_preserve) AND weight < 4.0 AND length(text) >= 100)"""


@query(f"WITH {MEMORIES_SQL}, {_COMPRESS_SQL} SELECT id, outcome FROM {_due_sql('srt')}")
def compress(spark, d):
    return lifecycle.compress(memories(spark, d), as_of())[1]


@query(f"""WITH {MEMORIES_SQL}, {_COMPRESS_SQL}, scan AS (SELECT id FROM mem WHERE m_pending AND NOT is_archived ORDER BY id LIMIT 10)
    SELECT id, CASE WHEN id IN (SELECT id FROM scan) AND length(short) < length(text) * 0.6 THEN short ELSE compressed_text END AS compressed_text,
    CASE WHEN id IN (SELECT id FROM scan) AND NOT coalesce(length(short) < length(text) * 0.6, false) THEN 1 ELSE 0 END AS retry_count FROM srt""")
def retry_compression(spark, d):
    return lifecycle.retry_compression(memories(spark, d), as_of()).select("id", "compressed_text", F.coalesce("metadata.retry_count", F.lit(0)).alias("retry_count"))


@query(mem("SELECT id, CASE WHEN id % 23 = 0 THEN 0 ELSE state END AS state, m_forgotten OR id % 23 = 0 AS forgotten FROM mem"))
def mark_forgotten(spark, d):
    m = memories(spark, d)
    return lifecycle.mark_forgotten(m, m.where("id % 23 = 0").select("id"), "asked", as_of()).select("id", "state", F.col("metadata.forgotten").alias("forgotten"))


@query(mem("SELECT id, false AS forgotten, true AS needs_revectorization FROM mem WHERE m_forgotten"))
def restore_forgotten(spark, d):
    m = memories(spark, d).where("metadata.forgotten")
    return lifecycle.restore_forgotten(m, m.select("id")).select("id", F.col("metadata.forgotten").alias("forgotten"), F.col("metadata.needs_revectorization").alias("needs_revectorization"))


_ARCHIVE = f"created_time < {NOW} - INTERVAL 180 DAY AND weight < 0.3 AND {_FREE} AND NOT m_protected AND NOT m_important AND NOT m_preserve"


@query(mem(f"SELECT id AS original_id, weight, 'age' AS archive_reason FROM mem WHERE {_ARCHIVE} ORDER BY weight, created_time, id LIMIT 10000"))
def archive(spark, d):
    return lifecycle.archive(memories(spark, d), as_of())[1].select("original_id", "weight", "archive_reason")


@query(mem(f"SELECT 'age' AS archive_reason, count(*) AS n FROM mem WHERE {_ARCHIVE} HAVING count(*) > 0"))
def archive_stats(spark, d):
    return metrics.archive_stats(lifecycle.archived(lifecycle.archive_due(memories(spark, d), as_of()), as_of())).select("archive_reason", "n")


@query(f"WITH {VECTORS_SQL} SELECT id FROM vec WHERE record_id NOT IN (SELECT doc_id FROM documents)")
def orphans(spark, d):
    return lifecycle.orphans(vectors(spark, d), memories(spark, d)).select("id")


@query(f"WITH {MEMORIES_SQL}, {VECTORS_SQL} SELECT id FROM mem WHERE state = 1 AND id NOT IN (SELECT record_id FROM vec)")
def ghosts(spark, d):
    return lifecycle.ghosts(memories(spark, d), vectors(spark, d)).select("id")


@query(f"WITH {MEMORIES_SQL}, {VECTORS_SQL} SELECT id, CASE WHEN state = 1 AND id NOT IN (SELECT record_id FROM vec) THEN 0 ELSE state END AS state FROM mem")
def repair(spark, d):
    return lifecycle.repair(memories(spark, d), vectors(spark, d))[0].select("id", "state")


@query(f"WITH {MEMORIES_SQL}, {VECTORS_SQL} SELECT vec.id, CAST(coalesce(mem.created_time, vec.timestamp) AS VARCHAR) AS timestamp FROM vec LEFT JOIN mem ON vec.record_id = mem.id")
def timestamp_sync(spark, d):
    return lifecycle.sync_times(vectors(spark, d), memories(spark, d)).select("id", day("timestamp"))


#: What each step takes. Earlier ones matter to ``forget``, as records that moved down have no vector to lose, and to retries.
_STEPS_SQL = f"""
    down AS ({ORACLE_SQL['l2_to_l3']}), comp AS (SELECT id FROM ({ORACLE_SQL['compress']})), up AS ({ORACLE_SQL['l3_to_l2']}),
    upg AS (SELECT id FROM mem WHERE weight >= 2.5 AND state = -1 AND NOT is_archived AND last_access_time >= {NOW} - INTERVAL 7 DAY ORDER BY weight DESC, last_access_time DESC, id LIMIT 10),
    gone AS (SELECT id FROM ({ORACLE_SQL['forget']}) WHERE id NOT IN (SELECT id FROM down)),
    steps AS (SELECT 'to_text_store' AS step, id FROM down UNION ALL SELECT 'compress', id FROM comp UNION ALL SELECT 'to_vector_store', id FROM up UNION ALL SELECT 'upgrade', id FROM upg UNION ALL SELECT 'forget', id FROM gone)"""


@query(f"WITH {MEMORIES_SQL}, {_STEPS_SQL} SELECT step, count(*) AS n FROM steps GROUP BY step")
def maintain_report(spark, d):
    return lifecycle.maintain(memories(spark, d), as_of())[1]


_TRIED_SQL = "tried AS (SELECT id FROM mem WHERE state = -1 AND coalesce(m_retries, 0) < 3 AND id NOT IN (SELECT id FROM upg) ORDER BY created_time, id LIMIT 20)"


@query(f"""WITH {MEMORIES_SQL}, {VECTORS_SQL}, {_STEPS_SQL}, {_TRIED_SQL} SELECT step, count(*) AS n FROM (SELECT * FROM steps UNION ALL SELECT 'retry_vectors', id FROM tried
    UNION ALL SELECT 'orphans', id FROM vec WHERE record_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'ghosts', id FROM mem WHERE state = 1 AND id NOT IN (SELECT id FROM down) AND id NOT IN (SELECT id FROM gone) AND id NOT IN (SELECT record_id FROM vec)) GROUP BY step""")
def maintain_all(spark, d):
    """The whole run: moves, compression, merging of what came back, vectors of what needs one, and repair."""
    return lifecycle.maintain_all(memories(spark, d), vectors(spark, d), as_of(), allow_fallback=True)[2]


@query(f"""WITH {MEMORIES_SQL}, {VECTORS_SQL}, {_STEPS_SQL}, {_TRIED_SQL}, new AS (SELECT id FROM up UNION SELECT id FROM upg UNION SELECT id FROM tried)
    SELECT record_id, 'new' AS origin FROM (SELECT id AS record_id FROM new)
    UNION ALL SELECT record_id, 'old' FROM vec WHERE record_id IN (SELECT doc_id FROM documents) AND record_id NOT IN (SELECT id FROM new) AND record_id NOT IN (SELECT id FROM down) AND record_id NOT IN (SELECT id FROM gone)""")
def maintain_vectors(spark, d):
    """The vector store after the whole run."""
    # an old vector may be as young as the run, so old ones are marked before it
    held = vectors(spark, d).withColumn("origin", F.lit("old"))
    kept = lifecycle.maintain_all(memories(spark, d), held, as_of(), allow_fallback=True)[1]
    return kept.select("record_id", F.coalesce("origin", F.lit("new")).alias("origin"))


# context


def _session_items(spark, d):
    """All messages of a conversation as the items of one query."""
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")


_PACK_SQL = rf"""
    i AS (SELECT conv_id, turn AS pos, text, {_TOKENS_SQL.format('text')} + 10 AS cost, len(regexp_extract_all(text, '{_NUMBER_SQL}')) * 2.0::DOUBLE + len(regexp_extract_all(text, '[A-Z][a-z]+|[\x{{4E00}}-\x{{9FA5}}]{{2,4}}(?:公司|项目|产品|版本|系统|模块)')) * 1.5::DOUBLE + len(regexp_extract_all(text, '{_DATE_SQL}|昨天|今天|明天|上周|下周')) * 1.5::DOUBLE AS importance FROM conversations),
    u AS (SELECT *, row_number() OVER w AS place, sum(cost) OVER w AS used FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY importance DESC, pos)),
    o AS (SELECT *, min(CASE WHEN used > 300 THEN place END) OVER (PARTITION BY conv_id) AS first_over FROM u)"""


@query(f"WITH {_PACK_SQL} SELECT conv_id, pos, place, cost, coalesce(place = first_over, false) AS cut FROM o WHERE first_over IS NULL OR place < first_over OR (place = first_over AND 300 - (used - cost) > 50)")
def greedy_pack(spark, d):
    return context.pack(_session_items(spark, d), ["conv_id"], F.lit(300)).select("conv_id", "pos", "place", "cost", "cut")


@query()
def bucket_fill(spark, d):
    items = _session_items(spark, d)
    role = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "role")
    named = items.join(role, ["conv_id", "pos"])
    parts = context.buckets(named.where("role = 'user'"), named.where("role = 'system'"), named.where("role = 'assistant'"), "conv_id")
    return context.fill(parts, "conv_id", 1000)


_QUERY_TYPE_SQL = """CASE WHEN regexp_matches(lower(text), '昨天|今天|上周|之前|刚才|什么时候|何时|when|yesterday|today|before') THEN 'time_related' WHEN regexp_matches(lower(text), '是什么|什么是|怎么|如何|为什么|谁|哪|what|how|why|who|which') THEN 'factual'
    WHEN regexp_matches(lower(text), '你好|嗨|哈喽|谢谢|再见|ok|好的|嗯|hello|hi|thanks|bye') THEN 'casual' WHEN length(text) > 100 OR len(regexp_extract_all(text, '\\?')) > 1 OR len(regexp_extract_all(text, '？')) > 1 THEN 'complex' ELSE 'default' END"""


@query(rf"""SELECT id, CASE WHEN fits THEN m ELSE greatest(CASE WHEN u > 200 THEN free - least(u, 300) ELSE free END, 300) END::BIGINT AS memory, CASE WHEN fits OR u <= 200 THEN u ELSE least(u, 300) END::BIGINT AS user FROM (
    SELECT *, 200 + m + u + 3000 <= 8192 AS fits, greatest(floor(4992 * CASE kind WHEN 'time_related' THEN 0.7::DOUBLE WHEN 'factual' THEN 0.6 WHEN 'casual' THEN 0.3 WHEN 'complex' THEN 0.5 ELSE 0.4 END), 500) AS free FROM (
    SELECT conv_id * 1000 + turn AS id, {_TOKENS_SQL.format('text')} AS u, conv_id * 37 % 7000 AS m, {_QUERY_TYPE_SQL} AS kind FROM conversations))""")
def token_budget(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", (F.col("conv_id") * 37 % 7000).alias("m"))
    return t.select("id", context.memory_budget(F.col("text"), F.col("m")).alias("b")).select("id", "b.memory", "b.user")


@query(f"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    c AS (SELECT *, sum({_TOKENS_SQL.format('text')} + 5) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM l)
    SELECT doc_id, coalesce(string_agg(c.text, chr(10) ORDER BY pos), '') AS text FROM documents LEFT JOIN c USING (doc_id) WHERE used <= 200 GROUP BY doc_id
    UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE used <= 200)""")
def keep_lines(spark, d):
    return context.keep_lines(table(spark, d, "documents"), "doc_id", 200)


# metrics


@query(mem(f"SELECT count(*) AS total, round(avg(weight), 3) AS mean_weight, count(*) FILTER (WHERE weight > 2) AS heavy, count(*) FILTER (WHERE weight < 0.6) AS light, count(*) FILTER (WHERE last_access_time >= {NOW} - INTERVAL 1 DAY) AS recent FROM mem WHERE NOT is_archived"))
def store_stats(spark, d):
    return metrics.store_stats(memories(spark, d), as_of())


@query(mem("SELECT CASE WHEN state = 1 THEN 'L2' ELSE 'L3' END AS tier, count(*) AS n FROM mem WHERE NOT is_archived GROUP BY 1"))
def tier_stats(spark, d):
    return metrics.tier_stats(memories(spark, d))


@query(f"WITH {VECTORS_SQL} SELECT count(*) AS n, CAST(min(timestamp) AS VARCHAR) AS first, CAST(max(timestamp) AS VARCHAR) AS last FROM vec")
def vector_stats(spark, d):
    return metrics.vector_stats(vectors(spark, d)).select("n", day("first"), day("last"))


@query("""WITH s AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 1000),
    g AS (SELECT event_type, list_sort(list(value)) AS s, avg(value) AS mean, max(value) AS most, count(*) AS n FROM s GROUP BY 1)
    SELECT event_type, n, s[n // 2 + 1] AS p50, CASE WHEN n >= 20 THEN s[CAST(floor(n * 0.95::DOUBLE) AS INT) + 1] ELSE most END AS p95, CASE WHEN n >= 100 THEN s[CAST(floor(n * 0.99::DOUBLE) AS INT) + 1] ELSE most END AS p99, round(mean, 6) AS mean, most FROM g""")
def latency_percentiles(spark, d):
    last = metrics.last_samples(table(spark, d, "events"), "event_type", ["ts", "event_id"])
    return metrics.percentiles(last, "event_type", "value").withColumn("mean", r6("mean"))


@query("SELECT event_type, count(*) AS n, round(count(*) FILTER (WHERE value < 50)::DOUBLE / greatest(count(*), 1), 6) AS hit_rate FROM events GROUP BY 1")
def hit_rates(spark, d):
    return metrics.rates(table(spark, d, "events"), "event_type", {"hit_rate": F.col("value") < 50}).withColumn("hit_rate", r6("hit_rate"))


@query("""SELECT user_id, n, CASE WHEN m > 95 THEN 'unhealthy' WHEN n > 100 THEN 'degraded' ELSE 'healthy' END AS status, CASE WHEN n < 100 THEN 'PASS' WHEN n < 200 THEN 'WARN' ELSE 'FAIL' END AS queue FROM (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)""")
def health_rollup(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return metrics.health(g, "n", F.col("m") > 95).select("user_id", "n", "status", metrics.band(F.col("n"), 100, 200).alias("queue"))


@query("""SELECT event_id, round(greatest(10, least(300, 2 * s[least(CAST(floor(len(s) * 0.95::DOUBLE) AS INT) + 1, len(s))])), 6) AS timeout FROM (SELECT event_id, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING)) AS s FROM events)""")
def adaptive_timeout(spark, d):
    return metrics.adaptive_timeout(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value").select("event_id", r6("timeout").alias("timeout"))


@query("""WITH e AS (SELECT *, value < 50 AS ok, sum(CAST(value < 50 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
    SELECT event_id, CAST(f AS BIGINT) AS failures, NOT ok AND f % 5 = 0 AS opens FROM (SELECT event_id, ok, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS f FROM e)""")
def circuit_breaker(spark, d):
    return metrics.circuit(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50).select("event_id", F.col("failures"), "opens")


@query("SELECT event_id, greatest(0, 10 - floor(event_id % 4000 / 300))::BIGINT AS priority, event_id % 4000 > 600 AS starving FROM events")
def task_priority(spark, d):
    waited = F.col("event_id") % 4000
    return table(spark, d, "events").select("event_id", metrics.effective_priority(F.lit(10), waited).cast("long").alias("priority"), metrics.starving(waited).alias("starving"))


# streams, as batches of the same plans


@query("SELECT CAST(time_bucket(INTERVAL 60 MINUTE, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2")
def windowed_metrics(spark, d):
    w = ingest.windowed(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r6("mean").alias("mean"), "most")


@query("""SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    w = ingest.sessions(table(spark, d, "events"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "n")


@query(f"""WITH {TURNS_SQL}, {_SAID_SQL}, msk AS (SELECT id, session_id, ts, {_mask_sql('user_input')} AS user_input, {_mask_sql('assistant_response')} AS assistant_response FROM said), {_noise_ctes('msk')},
    rec AS (SELECT id, CASE storage WHEN 'full' THEN 1 ELSE -1 END AS state, '用户: ' || user_input || chr(10) || '助理: ' || assistant_response AS text FROM noise WHERE storage <> 'discard'),
    one AS (SELECT arg_min(id, id) AS id, arg_min(state, id) AS state, text FROM rec GROUP BY text)
    SELECT id, sha256(text)[1:32] AS text_hash, state, {_TOKENS_SQL.format('text')} AS token_count, {_CATEGORY_SQL} AS category FROM one""")
def ingest_batch(spark, d):
    r = ingest.once(ingest.to_records(ingest.judge(_said(spark, d))))
    return r.select("id", "text_hash", "state", "token_count", F.col("tag.category").alias("category"))


@query(f"WITH {TURNS_SQL} SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS r FROM turns) WHERE r <= 3")
def l1_tail(spark, d):
    return records.l1_tail(turns(spark, d), 3).select("id", "session_id")
