"""Scans and writes of record snapshots. A write takes a snapshot and gives the next one; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx
from ..schema import CONFIG, LOW_VALUE, METADATA, TEXT_ONLY, VECTORISED, Config


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


# scans: conditions are pushed to the source, and order with limit is a top-k without a full sort


def low_weight(m: DataFrame, n: int, config: Config = CONFIG) -> DataFrame:
    limit = config.min_weight * config.low_weight_multiplier
    return m.where((F.col("weight") < limit) & (F.col("state") == VECTORISED) & ~F.col("is_archived")).orderBy("weight", "last_access_time", "id").limit(n)


def high_weight(m: DataFrame, as_of: Column, n: int, config: Config = CONFIG) -> DataFrame:
    live = (F.col("weight") >= config.max_weight * config.promote_share) & (F.col("state") == TEXT_ONLY) & ~F.col("is_archived")
    return m.where(live & (F.col("last_access_time") >= as_of - days(7))).orderBy(F.desc("weight"), F.desc("last_access_time"), "id").limit(n)


def upgradeable(m: DataFrame, as_of: Column, n: int, config: Config = CONFIG) -> DataFrame:
    live = (F.col("weight") >= config.max_weight * config.upgrade_share) & (F.col("state") == LOW_VALUE) & ~F.col("is_archived")
    return m.where(live & (F.col("last_access_time") >= as_of - days(7))).orderBy(F.desc("weight"), F.desc("last_access_time"), "id").limit(n)


def recent(m: DataFrame, n: int, vectorised_only: bool = False) -> DataFrame:
    live = ~F.col("is_archived") & ((F.col("state") == VECTORISED) if vectorised_only else F.lit(True))
    return m.where(live).orderBy(F.desc("created_time"), "id").limit(n)


def unaccessed(m: DataFrame, as_of: Column, after_days: int, n: int) -> DataFrame:
    return m.where(~F.col("is_archived") & (F.col("last_access_time") < as_of - days(after_days))).orderBy("last_access_time", "id").limit(n)


def by_state(m: DataFrame, states: list[int], n: int) -> DataFrame:
    return m.where(F.col("state").isin(states) & ~F.col("is_archived")).orderBy(F.desc("created_time"), "id").limit(n)


def failed_vectors(m: DataFrame, n: int, config: Config = CONFIG) -> DataFrame:
    retries = F.coalesce(F.col("metadata.vectorization_retries"), F.lit(0))
    return m.where((F.col("state") == LOW_VALUE) & (retries < config.vector_retries)).orderBy("created_time", "id").limit(n)


def pending_compression(m: DataFrame, n: int) -> DataFrame:
    return m.where(F.col("metadata.pending_compression") & ~F.col("is_archived")).orderBy("id").limit(n)


def important(m: DataFrame, n: int) -> DataFrame:
    return m.where(F.col("is_important") & ~F.col("is_archived")).orderBy(F.desc("created_time"), "id").limit(n)


def of_session(m: DataFrame, session_id: str, n: int) -> DataFrame:
    return m.where(F.col("session_id") == session_id).orderBy(F.desc("created_time"), "id").limit(n)


def page(turns: DataFrame, n: int, offset: int = 0, session_id: str | None = None) -> DataFrame:
    rows = turns if session_id is None else turns.where(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("ts"), "id").offset(offset).limit(n)


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n, in ascending order."""
    return turns.orderBy(F.desc("ts"), F.desc("id")).limit(n).orderBy("ts", "id")


def latest(m: DataFrame, n: int) -> DataFrame:
    return m.where(~F.col("is_archived")).orderBy(F.desc("created_time"), "id").limit(n)


def tag_scan(m: DataFrame, condition: Column, k: int) -> DataFrame:
    """The first k of the latest 3k records that satisfy a condition on their tag."""
    return latest(m, 3 * k).where(condition).orderBy(F.desc("created_time"), "id").limit(k)


def forgotten(m: DataFrame, k: int) -> DataFrame:
    """Forgotten ones of the latest 10k records with a preview of 100 characters."""
    rows = latest(m, 10 * k).where(F.col("metadata.forgotten")).orderBy(F.desc("created_time"), "id").limit(k)
    return rows.withColumn("preview", F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")))


# writes


def insert(m: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Appends with hashes, times, flags and token count filled in."""
    unset = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in METADATA.fields))
    meta = F.coalesce(F.col("metadata"), unset)
    filled = rows.withColumns({
        "created_time": F.coalesce("created_time", as_of), "last_access_time": F.coalesce("last_access_time", "created_time", as_of),
        "weight": F.coalesce("weight", F.lit(1.0)), "access_count": F.coalesce("access_count", F.lit(0)),
        "text_hash": tx.text_hash("text"), "content_hash": tx.content_hash("text"), "vector_id": tx.vector_id("text"),
        "is_important": md.flag(meta, "important"), "is_protected": md.flag(meta, "protected"),
        "metadata": md.set_token_count(meta, F.col("text"), as_of),
    })
    return m.unionByName(filled, allowMissingColumns=True)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the smallest ``order``; a row is carried by its struct, so nothing is sorted."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__row"))
    return best.select(key, "__row.*").select(*rows.columns)


def insert_new(m: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, known rows with existing_id): by text hash against records that aren't archived, and within the batch
    the first id of each hash is new."""
    held = m.where(~F.col("is_archived")).groupBy("text_hash").agg(F.min("id").alias("existing_id"))
    fresh = first_of(rows, "text_hash", "id").join(held, "text_hash", "left_anti")
    return fresh, rows.join(held, "text_hash")


def boost(m: DataFrame, hits: DataFrame, as_of: Column, config: Config = CONFIG) -> DataFrame:
    """Hit records weigh more, up to the limit, and count an access."""
    hit = hits.select("id").distinct().withColumn("__hit", F.lit(True))
    j = m.join(hit, "id", "left")
    on = F.col("__hit").isNotNull()
    return j.withColumns({
        "weight": F.when(on, F.least(F.lit(config.max_weight), F.col("weight") * config.boost)).otherwise(F.col("weight")),
        "access_count": F.col("access_count") + on.cast("int"),
        "last_access_time": F.when(on, as_of).otherwise(F.col("last_access_time")),
    }).drop("__hit")


def adjust(m: DataFrame, changes: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Adds ``change`` to the weight of each id, within the limits."""
    total = changes.groupBy("id").agg(F.sum("change").alias("__change"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(config.max_weight), F.col("weight") + F.coalesce("__change", F.lit(0.0))))
    return m.join(total, "id", "left").withColumn("weight", weight).drop("__change")


def set_states(m: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (id, state, vector_id); null fields leave the old value. The last by ``at`` counts if there is one."""
    u = updates.groupBy("id").agg(F.max_by("state", "at").alias("__state"), F.max_by("vector_id", "at").alias("__vector")) if "at" in updates.columns else updates.select("id", F.col("state").alias("__state"), F.col("vector_id").alias("__vector"))
    return m.join(u, "id", "left").withColumns({"state": F.coalesce("__state", "state"), "vector_id": F.coalesce("__vector", "vector_id")}).drop("__state", "__vector")


def archive_flag(m: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    return m.join(gone, "id", "left").withColumn("is_archived", F.col("is_archived") | F.col("__gone").isNotNull()).drop("__gone")


def delete(m: DataFrame, ids: DataFrame) -> DataFrame:
    return m.join(ids.select("id").distinct(), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, column by column where they aren't null."""
    n = new.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in new.columns if c != key))
    j = old.join(n, key, "full_outer")
    return j.select(key, *((F.coalesce(f"__{c}", c) if c in new.columns else F.col(c)).alias(c) for c in old.columns if c != key))


def end_session(sessions: DataFrame, session_id: str, status: str, as_of: Column) -> DataFrame:
    own = F.col("session_id") == session_id
    return sessions.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "updated_time": F.when(own, as_of).otherwise(F.col("updated_time"))})


def purge_sessions(sessions: DataFrame, as_of: Column, after_days: int = 30) -> DataFrame:
    old = (F.col("status") == "ended") & (F.col("updated_time") < as_of - days(after_days))
    return sessions.where(~F.coalesce(old, F.lit(False)))


def upsert_vectors(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """By id; of several new rows with one id the last by ``at`` counts."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "at")]), "at").alias("__r")).select("id", "__r.*")
    return vectors.join(last, "id", "left_anti").unionByName(last, allowMissingColumns=True)


def quality_report(m: DataFrame) -> DataFrame:
    """One row: rows, ids that occur more than once, null ids and texts, weights out of range."""
    per_id = m.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("no_text"), F.count_if(~F.col("weight").between(0, CONFIG.max_weight)).alias("bad_weight"))
    return per_id.agg(F.sum("n").alias("n_rows"), F.count_if(F.expr("n > 1 and id is not null")).alias("n_twice"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_no_id"), F.sum("no_text").alias("n_no_text"), F.sum("bad_weight").alias("n_bad_weight"))


def l1_tail(turns: DataFrame, size: int = CONFIG.l1_size) -> DataFrame:
    """The last ``size`` turns of each session."""
    last = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return turns.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= size).drop("__r")
