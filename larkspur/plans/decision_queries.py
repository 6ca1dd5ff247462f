"""Registered queries of decisions: what a model or a rule says about rows, and what stays after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lifecycle, records, retrieval, similar
from ..schema import CONFIG
from ..sources.views import SESSIONS_SQL, as_of, memories, sessions, table
from .queries import _LATIN, NOW, ORACLE_SQL, _matches, mem, query
from .queries import vector_topk as _vector_topk

# conflicts


@query("""WITH d AS (SELECT doc_id, doc_id % 150 AS group_id, n_chars, text FROM documents),
    g AS (SELECT group_id, count(DISTINCT v) AS kinds FROM (SELECT group_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS v FROM d) GROUP BY 1),
    a AS (SELECT group_id, CASE kinds % 4 WHEN 0 THEN 'Update' WHEN 1 THEN 'correct' WHEN 2 THEN 'Coexist' END AS action FROM g WHERE kinds > 1)
    SELECT doc_id AS id, group_id FROM d LEFT JOIN a USING (group_id)
    QUALIFY coalesce(lower(action) NOT IN ('update', 'correct'), true) OR row_number() OVER (PARTITION BY group_id ORDER BY n_chars DESC NULLS LAST, doc_id DESC) = 1""")
def resolve_conflicts(spark, d):
    """Groups of documents whose numbers differ get a decision by how many kinds there are; what it leaves of each group."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 150).alias("group_id"), "n_chars", "text")
    found = texts.select("group_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("v"))
    kinds = found.distinct().groupBy("group_id").agg(F.count("*").alias("kinds")).where("kinds > 1")
    said = kinds.select("group_id", F.expr("CASE kinds % 4 WHEN 0 THEN 'Update' WHEN 1 THEN 'correct' WHEN 2 THEN 'Coexist' END").alias("action"))
    return similar.resolve(texts, said, order="n_chars").select("id", "group_id")


# reranking


@query(f"""WITH t AS ({ORACLE_SQL['vector_topk']}), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1),
    s AS (SELECT t.query_id, id, similarity, CAST(rank AS INTEGER) AS was, n, CASE WHEN n > 3 AND query_id % 3 <> 0 AND rank % 2 = 1 THEN (id * 7919 % 1000)::DOUBLE / 1000 ELSE similarity END AS score FROM t JOIN n USING (query_id))
    SELECT query_id, id, was, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM s""")
def model_rerank(spark, d):
    """The nearest vectors of each query in the order of a model's answers. The stand-in for the model scores every other
    result by its id, and gives no JSON for a third of the queries."""
    ranked = _vector_topk(spark, d).withColumnsRenamed({"similarity": "rrf_score"}).withColumn("was", F.col("rank"))
    scored = F.format_string('{"id": "%d", "score": %.3f}', F.col("rank") - 1, F.col("id") * 7919 % 1000 / 1000)
    said = ranked.where("rank % 2 = 1").groupBy("query_id").agg(F.array_join(F.collect_list(scored), ", ").alias("s"))
    answers = said.select("query_id", F.when(F.col("query_id") % 3 == 0, "no order").otherwise(F.concat(F.lit("So: ["), "s", F.lit("]"))).alias("answer"))
    return retrieval.rerank_by_model(ranked, answers).select("query_id", "id", F.col("was").cast("int").alias("was"), F.round("rrf_score", 5).alias("score"), "rank")


# sessions, archive, compression


@query(f"WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN session_id = '7' THEN 'archived' ELSE status END AS status, message_count FROM sessions")
def archive_session(spark, d):
    return records.end_session(sessions(spark, d), "7", "archived", as_of()).select("session_id", "status", "message_count")


@query(mem(f"SELECT id, text FROM mem WHERE id % 5 = 0 AND NOT coalesce(created_time < {NOW} - INTERVAL 60 DAY, false)"))
def archive_purge(spark, d):
    """What an archive holds after the records made over sixty days ago have gone."""
    kept = lifecycle.archived(memories(spark, d).where("id % 5 = 0"), as_of())
    return lifecycle.purge_archive(kept, as_of() - F.make_dt_interval(F.lit(60))).select(F.col("original_id").alias("id"), "text")


@query(f"""WITH r AS ({ORACLE_SQL['rule_compress']}), s AS (SELECT doc_id, short, text, CASE WHEN length(text) % 3 = 0 THEN text[1:40] WHEN length(text) % 3 = 1 THEN '' END AS model FROM r JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN model <> '' THEN 'model' WHEN short <> '' THEN 'rule' WHEN text <> '' THEN 'head' END AS strategy,
    CASE WHEN model <> '' THEN model WHEN short <> '' THEN short WHEN text <> '' THEN text[1:80] END AS short FROM s""")
def compression_chain(spark, d):
    """The first of three strategies that gives a text: a model's answer (a stand-in that fails or is empty for two thirds),
    key sentences, the beginning."""
    model = F.expr("CASE WHEN length(text) % 3 = 0 THEN substring(text, 1, 40) WHEN length(text) % 3 = 1 THEN '' END")
    short = lifecycle.chain({"model": model, "rule": lifecycle.rule_compress("text", CONFIG, _LATIN, ".!?"), "head": F.substring("text", 1, 80)})
    return table(spark, d, "documents").select("doc_id", short["strategy"].alias("strategy"), short["text"].alias("short"))


# fixed phrases, each set into texts of the tables


def _listed(words: list[str]) -> str:
    return "['" + "', '".join(words) + "']"


_N_DENSE, _N_STOP = len(tx.DENSE_PHRASES), len(tx.QUERY_STOPWORDS)


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % {2 * _N_DENSE} < {_N_DENSE} THEN coalesce(text, '')[1:50] || ({_listed(tx.DENSE_PHRASES)})[CAST(doc_id % {2 * _N_DENSE} + 1 AS INTEGER)] || 'x' ELSE text END AS text FROM documents)
    SELECT doc_id, coalesce({_matches('text', [tx.CODE.replace(chr(91) + chr(92) + 's' + chr(92) + 'S]', '(?:.|' + chr(92) + 'n)'), *tx.DENSE_PHRASES])}, false) AS dense FROM t""")
def dense_phrases(spark, d):
    """Half of the documents have one of the phrases behind their first 50 characters."""
    at = F.col("doc_id") % (2 * _N_DENSE)
    phrase = F.get(tx.strings(tx.DENSE_PHRASES), at.cast("int"))
    text = F.when(at < _N_DENSE, F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 50), phrase, F.lit("x"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.dense(text).alias("dense"))


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN ' ' || upper(w) || ' ' WHEN 1 THEN w || coalesce(text, '')[1:3] ELSE text END AS text
    FROM (SELECT *, ({_listed(tx.QUERY_STOPWORDS)})[CAST(conv_id % {_N_STOP} + 1 AS INTEGER)] AS w FROM conversations))
    SELECT id, coalesce(length(trim(text)) >= 2 AND NOT list_contains({_listed(tx.QUERY_STOPWORDS)}, lower(trim(text))) AND regexp_matches(trim(text), '[\\x{{4E00}}-\\x{{9FA5}}a-zA-Z0-9]'), false) AS valid FROM t""")
def query_stopwords(spark, d):
    """Turns in place of whose text, or before its first letters, one of the words that are no query stands."""
    w = F.get(tx.strings(tx.QUERY_STOPWORDS), (F.col("conv_id") % _N_STOP).cast("int"))
    begun = F.concat(w, F.substring(F.coalesce("text", F.lit("")), 1, 3))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), F.upper(w), F.lit(" "))).when(F.col("turn") % 3 == 1, begun).otherwise(F.col("text"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.valid_query(text).alias("valid"))
