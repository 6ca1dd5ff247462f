"""Tables and the views that are derived from them by integer rules, the same here and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import AS_OF, METADATA

BASE = "TIMESTAMP_NTZ '2024-07-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: weight, times, state and flags follow from doc_id."""
    d = table(spark, sf_dir, "documents")
    created = f"{BASE} - make_dt_interval(CAST((doc_id * 53) % 240 AS INT), CAST((doc_id * 7) % 24 AS INT), 0, 0)"
    accessed = f"{BASE} - make_dt_interval(CAST((doc_id * 29) % 60 AS INT), 0, 0, 0)"
    marks = {
        "compressed": "doc_id % 6 = 0",
        "pending_compression": "doc_id % 9 = 0",
        "forgotten": "doc_id % 11 = 0",
        "high_density": "doc_id % 14 = 0",
        "preserve": "doc_id % 15 = 0",
        "protected": "doc_id % 13 = 0",
        "important": "doc_id % 21 = 0",
        "needs_recompression": "doc_id % 18 = 0",
        "promoted_to_l2": "doc_id % 8 = 0",
        "promoted_time": f"{BASE} - make_dt_interval(0, CAST(doc_id % 50 AS INT), 0, 0)",
        "moved_from_l3": "doc_id % 8 = 1",
        "moved_from_l3_time": f"{BASE} - make_dt_interval(0, CAST(doc_id % 90 AS INT), 0, 0)",
        "moved_from_l2": "doc_id % 8 = 2",
        "moved_from_l2_time": f"{BASE} - make_dt_interval(0, CAST(doc_id % 60 AS INT), 0, 0)",
        "vectorization_retries": "IF(doc_id % 4 = 0, NULL, doc_id % 5)",
    }
    flags = F.struct(*(F.expr(marks.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in METADATA.fields))
    return d.select(
        F.col("doc_id").alias("id"),
        "text",
        F.expr("IF(doc_id % 6 = 0, substring(text, 1, 60), NULL)").alias("compressed_text"),
        "source",
        F.expr("CAST((doc_id * 37) % 500 AS DOUBLE) / 100D").alias("weight"),
        F.expr("(doc_id * 11) % 40").alias("access_count"),
        F.expr(f"greatest({created}, {accessed})").alias("last_access_time"),
        F.expr(created).alias("created_time"),
        flags.alias("metadata"),
        F.expr("doc_id % 17 = 0").alias("is_archived"),
        tx.vector_id("text").alias("vector_id"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN -1 WHEN doc_id % 10 <= 4 THEN 0 ELSE 1 END").alias("state"),
        tx.text_hash("text").alias("text_hash"),
        F.expr("doc_id % 21 = 0").alias("is_important"),
        F.expr("doc_id % 13 = 0").alias("is_protected"),
        F.expr("CAST(doc_id % 100 AS STRING)").alias("session_id"),
        tx.content_hash("text").alias("content_hash"),
    )


#: The same in DuckDB, flags as m_ columns.
MEMORIES_SQL = """
    mem AS (
        SELECT doc_id AS id, text, CASE WHEN doc_id % 6 = 0 THEN text[1:60] END AS compressed_text, source,
               CAST((doc_id * 37) % 500 AS DOUBLE) / 100 AS weight, (doc_id * 11) % 40 AS access_count,
               TIMESTAMP '2024-07-01' - to_days(CAST((doc_id * 53) % 240 AS INT)) - to_hours(CAST((doc_id * 7) % 24 AS INT)) AS created_time,
               greatest(created_time, TIMESTAMP '2024-07-01' - to_days(CAST((doc_id * 29) % 60 AS INT))) AS last_access_time,
               doc_id % 17 = 0 AS is_archived, 'mem_' || sha256(text)[1:32] AS vector_id,
               CASE WHEN doc_id % 10 = 0 THEN -1 WHEN doc_id % 10 <= 4 THEN 0 ELSE 1 END AS state,
               sha256(text)[1:32] AS text_hash, doc_id % 21 = 0 AS is_important, doc_id % 13 = 0 AS is_protected,
               CAST(doc_id % 100 AS VARCHAR) AS session_id, md5(text)[1:16] AS content_hash,
               doc_id % 6 = 0 AS m_compressed, doc_id % 9 = 0 AS m_pending, doc_id % 11 = 0 AS m_forgotten,
               doc_id % 14 = 0 AS m_dense, doc_id % 15 = 0 AS m_preserve, doc_id % 13 = 0 AS m_protected,
               doc_id % 21 = 0 AS m_important, doc_id % 18 = 0 AS m_recompress,
               doc_id % 8 = 0 AS m_to_l2, TIMESTAMP '2024-07-01' - to_hours(CAST(doc_id % 50 AS INT)) AS m_to_l2_time,
               doc_id % 8 = 1 AS m_from_l3, TIMESTAMP '2024-07-01' - to_hours(CAST(doc_id % 90 AS INT)) AS m_from_l3_time,
               doc_id % 8 = 2 AS m_from_l2, TIMESTAMP '2024-07-01' - to_hours(CAST(doc_id % 60 AS INT)) AS m_from_l2_time,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 END AS m_retries
        FROM documents
    )"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user message that an assistant message follows directly; a session is a conversation."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    ahead = Window.partitionBy("conv_id").orderBy("turn")
    paired = c.withColumn("next_role", F.lead("role").over(ahead)).withColumn("next_text", F.lead("text").over(ahead))
    ts = f"{BASE} - make_dt_interval(CAST(conv_id % 90 AS INT), 0, 0, 0) + make_dt_interval(0, 0, CAST(turn AS INT), 0)"
    return paired.where("role = 'user' AND next_role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("text").alias("user_input"),
        F.col("next_text").alias("assistant_response"),
        F.lit("local").alias("source"),
        F.expr(ts).alias("ts"),
    )


TURNS_SQL = """
    turns AS (
        SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, text AS user_input,
               next_text AS assistant_response, 'local' AS source,
               TIMESTAMP '2024-07-01' - to_days(CAST(conv_id % 90 AS INT)) + to_minutes(CAST(turn AS INT)) AS ts
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'
    )"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation: status by its number, updated at its last turn."""
    c = table(spark, sf_dir, "conversations")
    ts = F.expr(f"{BASE} - make_dt_interval(CAST(conv_id % 90 AS INT), 0, 0, 0) + make_dt_interval(0, 0, CAST(turn AS INT), 0)")
    status = F.expr("CASE conv_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'ended' ELSE 'archived' END")
    return c.groupBy("conv_id").agg(F.min(ts).alias("created_time"), F.max(ts).alias("updated_time"), F.count("*").alias("message_count")).select(
        F.col("conv_id").cast("string").alias("session_id"), status.alias("status"), "created_time", "updated_time", "message_count"
    )


SESSIONS_SQL = """
    sessions AS (
        SELECT CAST(conv_id AS VARCHAR) AS session_id,
               CASE conv_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'ended' ELSE 'archived' END AS status,
               min(TIMESTAMP '2024-07-01' - to_days(CAST(conv_id % 90 AS INT)) + to_minutes(CAST(turn AS INT))) AS created_time,
               max(TIMESTAMP '2024-07-01' - to_days(CAST(conv_id % 90 AS INT)) + to_minutes(CAST(turn AS INT))) AS updated_time,
               count(*) AS message_count
        FROM conversations GROUP BY conv_id
    )"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a vector store, unit length; every seventh has no record, so that there are orphans."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), tx.normalised("embedding").alias("embedding"), "label",
        F.expr("IF(vec_id % 7 = 0, -1 - vec_id, vec_id)").alias("record_id"),
        F.expr(f"{BASE} - make_dt_interval(CAST((vec_id * 53) % 240 AS INT), CAST((vec_id * 7 + vec_id % 2) % 24 AS INT), 0, 0)").alias("timestamp"),
    )


VECTORS_SQL = """
    vec AS (
        SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS embedding,
               label, CASE WHEN vec_id % 7 = 0 THEN -1 - vec_id ELSE vec_id END AS record_id,
               TIMESTAMP '2024-07-01' - to_days(CAST((vec_id * 53) % 240 AS INT)) - to_hours(CAST((vec_id * 7 + vec_id % 2) % 24 AS INT)) AS timestamp
        FROM embeddings
    )"""
