"""Lookups by key, and the small writes of turns, the pending queue, vectors and tiers. Like all writes here these take a
table and give the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as md

# lookups: a condition on one key, which a source can push down; for many keys a semi-join


def get(m: DataFrame, record_id: int) -> DataFrame:
    return m.where(F.col("id") == record_id)


def get_many(m: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return m.join(ids.select(key).distinct(), key, "left_semi")


def by_vector_id(m: DataFrame, vector_id: str) -> DataFrame:
    return m.where(F.col("vector_id") == vector_id)


def by_content_hash(m: DataFrame, content_hash: str) -> DataFrame:
    """The first record with this hash."""
    return m.where(F.col("content_hash") == content_hash).orderBy("id").limit(1)


def session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id)


def session_messages(turns: DataFrame, session_id: str, n: int) -> DataFrame:
    return turns.where(F.col("session_id") == session_id).orderBy("ts", "id").limit(n)


def conversation_counts(turns: DataFrame, session_id: str | None = None) -> DataFrame:
    own = turns if session_id is None else turns.where(F.col("session_id") == session_id)
    return own.groupBy("session_id").agg(F.count("*").alias("n"))


def active_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The last ``n`` active sessions; the latest one for 1."""
    return sessions.where("status = 'active'").orderBy(F.desc("updated_time"), "session_id").limit(n)


def live_count(m: DataFrame) -> DataFrame:
    return m.where(~F.col("is_archived")).agg(F.count("*").alias("n"))


# vectors


def vectors_where(vectors: DataFrame, ids: list | None = None, where: Column | None = None) -> DataFrame:
    """By ids, a condition, or both."""
    out = vectors if ids is None else vectors.where(F.col("id").isin(ids))
    return out if where is None else out.where(where)


def vector_ids(vectors: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """A page of ids, in their order."""
    return vectors.select("id").orderBy("id").offset(offset).limit(n)


def vector_metadata(vectors: DataFrame, vector_id) -> DataFrame:
    """All but the vector itself."""
    return vectors.where(F.col("id") == vector_id).drop("embedding")


def delete_vectors(vectors: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Without those of the ids, or of the condition."""
    out = vectors if ids is None else vectors.join(ids.select("id").distinct(), "id", "left_anti")
    return out if where is None else out.where(~F.coalesce(where, F.lit(False)))


def update_vectors(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of ``changes`` (id and any others) replace the old ones where they aren't null; unknown ids are left out."""
    new = changes.select("id", *(F.col(c).alias(f"__{c}") for c in changes.columns if c != "id"))
    j = vectors.join(new, "id", "left")
    return j.select(*((F.coalesce(f"__{c}", c) if c in changes.columns and c != "id" else F.col(c)).alias(c) for c in vectors.columns))


def delete_by_vector_id(m: DataFrame, vector_ids: DataFrame) -> DataFrame:
    return m.join(vector_ids.select("vector_id").distinct(), "vector_id", "left_anti").select(*m.columns)


def cleared(df: DataFrame) -> DataFrame:
    """The next, empty version of a table."""
    return df.limit(0)


def clear_tiers(turns: DataFrame, vectors: DataFrame, m: DataFrame, keep_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All tiers without rows; the text store may stay."""
    return cleared(turns), cleared(vectors), m if keep_text else cleared(m)


# turns and the pending queue


def add_turns(turns: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Appends turns; a missing time is ``as_of``, a missing source ``local``."""
    filled = rows.withColumns({"ts": F.coalesce("ts", as_of), "source": F.coalesce("source", F.lit("local"))})
    return turns.unionByName(filled, allowMissingColumns=True)


def clear_turns(turns: DataFrame, session_id: str | None = None) -> DataFrame:
    return cleared(turns) if session_id is None else turns.where(~F.coalesce(F.col("session_id") == session_id, F.lit(False)))


def enqueue(pending: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Appends rows (id and any fields) as JSON with status pending: (id, data, created_time, status)."""
    fields = [c for c in rows.columns if c != "id"]
    return pending.unionByName(rows.select("id", F.to_json(F.struct(*fields)).alias("data"), as_of.alias("created_time"), F.lit("pending").alias("status")))


def dequeue(pending: DataFrame, n: int, schema: str) -> DataFrame:
    """The oldest ``n`` waiting rows with their fields; data that isn't JSON is left out."""
    first = pending.where("status = 'pending'").orderBy("created_time", "id").limit(n)
    parsed = first.withColumn("d", F.from_json("data", schema)).where(F.get_json_object("data", "$").isNotNull())
    return parsed.select("id", "created_time", "d.*")


def acknowledge(pending: DataFrame, ids: DataFrame) -> DataFrame:
    return pending.join(ids.select("id").distinct(), "id", "left_anti")


def purge_pending(pending: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    old = (F.col("created_time") < as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("status") == "pending")
    return pending.where(~F.coalesce(old, F.lit(False)))


def pending_count(pending: DataFrame) -> DataFrame:
    return pending.agg(F.count_if(F.col("status") == "pending").alias("n"))


def retry_tags(queue: DataFrame, done: DataFrame, most: int = 3, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """(next queue, taken): of texts that wait for a model's tag (id, text, retries) those ``done`` (id, ok) go if they
    succeeded and count a retry if not; of the others with less than ``most`` retries the first ``n`` are taken."""
    j = queue.join(done.select("id", "ok"), "id", "left")
    after = j.where(~F.coalesce("ok", F.lit(False))).withColumn("retries", F.col("retries") + F.col("ok").isNotNull().cast("int")).drop("ok")
    return after, after.where(F.col("retries") < most).orderBy("id").limit(n)


# fields


def set_fields(m: DataFrame, ids: DataFrame, **values) -> DataFrame:
    """The metadata of these records with fields set."""
    return replace_metadata(m, ids, md.put(F.col("metadata"), **values))


def replace_metadata(m: DataFrame, ids: DataFrame, metadata: Column) -> DataFrame:
    j = m.join(ids.select("id").distinct().withColumn("__on", F.lit(True)), "id", "left")
    return j.withColumn("metadata", F.when(F.col("__on"), metadata).otherwise(F.col("metadata"))).select(*m.columns)


def set_important(m: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    """The column form of the mark; the flag in the metadata follows."""
    j = m.join(ids.select("id").distinct().withColumn("__on", F.lit(True)), "id", "left")
    changed = {"is_important": F.when(F.col("__on"), F.lit(on)).otherwise(F.col("is_important")), "metadata": F.when(F.col("__on"), md.put(F.col("metadata"), important=on)).otherwise(F.col("metadata"))}
    return j.withColumns(changed).select(*m.columns)


# gates and templates


def interval_gate(last_runs: DataFrame, as_of: Column, least: Column | int) -> DataFrame:
    """(task, due): tasks (task, last_run) whose last run lies ``least`` seconds back, or that never ran."""
    return last_runs.select("task", F.coalesce(F.timestamp_diff("SECOND", "last_run", as_of) >= least, F.lit(True)).alias("due"))


def dedup_due(idle: Column, seconds_since: Column, n_vectors: Column, interval: int = 300) -> Column:
    """Whether idle time is used for deduplication."""
    return (idle >= 3) & (seconds_since >= interval) & (n_vectors >= 10)


def add_templates(library: DataFrame, rows: DataFrame) -> DataFrame:
    """Noise templates (text): trimmed, not empty, each once."""
    new = rows.select(F.trim("text").alias("text")).where("text <> ''")
    return library.select("text").unionByName(new).distinct()


def remove_templates(library: DataFrame, rows: DataFrame) -> DataFrame:
    return library.select("text").join(rows.select("text").distinct(), "text", "left_anti")


def preload_ids(wanted: DataFrame, done: DataFrame, most: int = 1000) -> DataFrame:
    """Ids (id, at) that wait to be preloaded: without those done, and of the rest the ``most`` newest."""
    return wanted.join(done.select("id").distinct(), "id", "left_anti").orderBy(F.desc("at"), "id").limit(most)
