"""How records age: decay, moves between the stores, compression, archive, and repair. Every step takes a snapshot and
``as_of`` and gives the next snapshot; a whole maintenance run is one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx
from ..functions.embedding import embed
from ..schema import CONFIG, LOW_VALUE, TEXT_ONLY, VECTORISED, Config
from ..sources.shared import settled
from . import merging, records

# Sentences that hold one of these are kept by rule compression.
KEY_WORDS = ["重要", "关键", "必须", "决定", "结论", "注意", "总结", "目标", "计划", "问题", "解决", "需要"]


def meta() -> Column:
    return F.col("metadata")


def decay(m: DataFrame, as_of: Column, config: Config = CONFIG) -> DataFrame:
    """Old live records that nothing protects lose weight once."""
    old = (F.col("created_time") < as_of - records.days(config.forget_age_days)) & (F.col("weight") > config.min_weight)
    free = ~F.col("is_archived") & ~F.col("is_important") & ~F.col("is_protected")
    return m.withColumn("weight", F.when(old & free, F.col("weight") * config.decay_rate).otherwise(F.col("weight")))


def forgettable(config: Config = CONFIG) -> Column:
    return (F.col("weight") < config.min_weight) & (F.col("state") == VECTORISED) & (F.coalesce(F.col("vector_id"), F.lit("")) != "") & ~F.col("is_important") & ~F.col("is_protected")


def forget(m: DataFrame, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(what stays, id and vector_id of what goes)."""
    return m.where(~forgettable(config)), m.where(forgettable(config)).select("id", "vector_id")


#: Keeps the rows that a step chooses as they are.
AS_IS = lambda rows: rows


def bounded(rows: DataFrame) -> DataFrame:
    """The rows that a step chooses, made once and sent to all tasks; their number is bounded by the settings' batches."""
    return F.broadcast(settled(rows))


def _changed(m: DataFrame, chosen: DataFrame, **columns: Column) -> DataFrame:
    mark = chosen.select("id").withColumn("__on", F.lit(True))
    j = m.join(mark, "id", "left")
    return j.withColumns({name: F.when(F.col("__on"), value).otherwise(F.col(name)) for name, value in columns.items()}).drop("__on")


def to_text_store(m: DataFrame, as_of: Column, config: Config = CONFIG, hold=AS_IS) -> tuple[DataFrame, DataFrame]:
    """(snapshot, moved): the lightest vectorised records that aren't cooling down give up their vector."""
    scan = records.low_weight(m, config.move_batch, config)
    cooling = md.cooling_from_l2(meta(), as_of, config.cooldown_hours) | md.cooling_from_l3(meta(), as_of, config.cooldown_hours)
    moved = hold(scan.where(F.col("vector_id").isNotNull() & ~cooling).select("id", "vector_id"))
    return _changed(m, moved, state=F.lit(TEXT_ONLY), metadata=md.mark_moved_to_l3(meta(), as_of)), moved


def to_vector_store(m: DataFrame, as_of: Column, config: Config = CONFIG, hold=AS_IS) -> tuple[DataFrame, DataFrame]:
    """(snapshot, moved): the heaviest recently used records of the text store get a vector."""
    moved = hold(records.high_weight(m, as_of, config.promote_batch, config).where(~md.cooling_back(meta(), as_of, config.cooldown_hours)).select("id"))
    return _changed(m, moved, state=F.lit(VECTORISED), vector_id=tx.vector_id("text"), metadata=md.mark_moved_to_l2(meta(), as_of)), moved


def upgrade(m: DataFrame, as_of: Column, config: Config = CONFIG, hold=AS_IS) -> tuple[DataFrame, DataFrame]:
    moved = hold(records.upgradeable(m, as_of, config.promote_batch, config).select("id"))
    return _changed(m, moved, state=F.lit(VECTORISED), vector_id=tx.vector_id("text"), metadata=md.mark_upgraded(meta(), as_of)), moved


def sentences(x, marks: str = "。！？\n") -> Column:
    """Trimmed sentences with the mark that ends them."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(tx._c(x), F.lit("")), F.lit(rf"[^{marks}]*[{marks}]|[^{marks}]+$"), F.lit(0)), lambda s: F.when(s.rlike(rf"[{marks}]$"), F.concat(F.trim(F.substring(s, F.lit(1), F.length(s) - 1)), F.right(s, F.lit(1)))).otherwise(F.trim(s))), lambda s: ~s.rlike(rf"^[{marks}]?$"))


def rule_compress(x, config: Config = CONFIG, key_words: list[str] = KEY_WORDS, marks: str = "。！？\n") -> Column:
    """The first distinct key sentences if they are short enough, else the beginning of a very long text, else null."""
    x = tx._c(x)
    key = F.array_distinct(F.filter(sentences(x, marks), lambda s: s.rlike("|".join(key_words))))
    short = F.array_join(F.slice(key, 1, config.compress_key_sentences), "")
    enough = (F.size(key) > 0) & (F.length(short) < F.length(x) * (config.compress_ratio + config.compress_buffer))
    return F.when(enough, short).when(F.length(x) > config.compress_max_segment, F.concat(F.substring(x, 1, config.compress_max_segment), F.lit("...")))


def chain(strategies: dict[str, Column]) -> Column:
    """struct(text, strategy) of the first strategy that gives a text."""
    return F.coalesce(*(F.when(c.isNotNull() & (c != ""), F.struct(c.alias("text"), F.lit(name).alias("strategy"))) for name, c in strategies.items()))


def compress(m: DataFrame, as_of: Column, config: Config = CONFIG, strategies: dict[str, Column] | None = None, hold=AS_IS) -> tuple[DataFrame, DataFrame]:
    """(snapshot, outcome by id): long unused records of little weight are compressed; dense ones are preserved, and
    those that don't get short enough wait for another try."""
    scan = records.unaccessed(m, as_of, config.compress_after_days, config.compress_batch)
    due = scan.where(~md.skip_compression(meta()) & (F.col("weight") < config.max_weight * config.compress_share) & (F.length("text") >= config.compress_min_length))
    short = chain(strategies or {"rule": rule_compress("text", config)})
    judged = due.select("id", F.when(tx.dense("text"), "preserved").when(F.length(short["text"]) < F.length("text") * config.compress_ratio, "compressed").otherwise("pending").alias("outcome"), short.alias("short"))
    judged = hold(judged)
    j = m.join(judged, "id", "left")
    done, kept, waits = (F.col("outcome") == x for x in ("compressed", "preserved", "pending"))
    marked = F.when(done, md.mark_compressed(meta(), F.col("short.strategy"), F.length("text"), as_of)).when(kept, md.mark_preserve(md.mark_dense(meta(), "dense content"), "dense content")).when(waits, md.mark_pending(meta(), as_of)).otherwise(meta())
    out = j.withColumn("metadata", marked).withColumn("compressed_text", F.when(done, F.col("short.text")).otherwise(F.col("compressed_text")))
    return out.drop("outcome", "short"), judged.select("id", "outcome")


def retry_compression(m: DataFrame, as_of: Column, n: int = 10, config: Config = CONFIG, hold=AS_IS) -> DataFrame:
    """The first n waiting records are tried again; what still isn't short enough counts a retry."""
    scan = hold(records.pending_compression(m, n).select("id"))
    short = rule_compress("text", config)
    good = F.length(short) < F.length("text") * config.compress_ratio
    done = md.clear_pending(md.mark_compressed(meta(), "rule", F.length("text"), as_of))
    return _changed(m, scan, compressed_text=F.when(good, short).otherwise(F.col("compressed_text")), metadata=F.when(good, done).otherwise(md.retry(meta(), "retry_count")))


def mark_forgotten(m: DataFrame, ids: DataFrame, reason: str, as_of: Column) -> DataFrame:
    return _changed(m, ids.distinct(), state=F.lit(TEXT_ONLY), vector_id=F.lit(None).cast("string"), metadata=md.mark_forgotten(meta(), reason, as_of))


def restore_forgotten(m: DataFrame, ids: DataFrame) -> DataFrame:
    return _changed(m, ids.distinct(), metadata=md.unmark_forgotten(meta()))


def archive_due(m: DataFrame, as_of: Column, config: Config = CONFIG) -> DataFrame:
    """All records that may be archived; a batch takes the first of them."""
    old = (F.col("created_time") < as_of - records.days(config.archive_days)) & (F.col("weight") < config.archive_weight)
    free = ~F.col("is_archived") & ~F.col("is_important") & ~F.col("is_protected") & ~md.is_protected(meta())
    return m.where(old & free)


def archive_candidates(m: DataFrame, as_of: Column, config: Config = CONFIG) -> DataFrame:
    return archive_due(m, as_of, config).orderBy("weight", "created_time", "id").limit(config.archive_max)


def archived(chosen: DataFrame, as_of: Column, reason: str = "age") -> DataFrame:
    """Records as rows of the archive."""
    return chosen.select(F.col("id").alias("original_id"), "text", "compressed_text", "source", "weight", "access_count", F.col("created_time").alias("original_created_time"), as_of.alias("archived_time"), F.lit(reason).alias("archive_reason"))


def archive(m: DataFrame, as_of: Column, reason: str = "age", config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(snapshot, archived rows)."""
    chosen = archive_candidates(m, as_of, config)
    return _changed(m, chosen, is_archived=F.lit(True), state=F.lit(TEXT_ONLY), vector_id=F.lit(None).cast("string")), archived(chosen, as_of, reason)


def purge_archive(archive: DataFrame, before: Column | None = None) -> DataFrame:
    """The next version of an archive: without the records made before ``before``, or without any if that is None. Records of
    unknown time stay until all go."""
    return archive.limit(0) if before is None else archive.where(~F.coalesce(F.col("original_created_time") < before, F.lit(False)))


def orphans(vectors: DataFrame, m: DataFrame) -> DataFrame:
    """Vectors (id, record_id) whose record isn't there."""
    return vectors.select("id", "record_id").join(m.select(F.col("id").alias("record_id")), "record_id", "left_anti")


def ghosts(m: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records that should have a vector but don't."""
    return m.where(F.col("state") == VECTORISED).join(vectors.select(F.col("record_id").alias("id")), "id", "left_anti")


def repair(m: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without a vector back in the text store, vectors without orphans)."""
    return _changed(m, ghosts(m, vectors), state=F.lit(TEXT_ONLY)), vectors.join(orphans(vectors, m).select("id"), "id", "left_anti")


def sync_times(vectors: DataFrame, m: DataFrame) -> DataFrame:
    """Vectors take the time of their record."""
    times = m.select(F.col("id").alias("record_id"), F.col("created_time").alias("__t"))
    return vectors.join(times, "record_id", "left").withColumn("timestamp", F.coalesce("__t", "timestamp")).drop("__t")


def retry_vectors(m: DataFrame, n: int, config: Config = CONFIG) -> DataFrame:
    """Failed embeddings that may be tried again, their retries counted."""
    return records.failed_vectors(m, n, config).withColumn("metadata", md.retry(meta()))


def recover(m: DataFrame) -> DataFrame:
    """Moves that were under way count as not begun."""
    return m.withColumn("state", F.when(F.col("state").isin(2, 3, 4), TEXT_ONLY).otherwise(F.col("state")))


def preload(m: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, id, bm25, rank, text): the best n phrase hits of each query that have no vector yet."""
    from .retrieval import best_hits

    found = best_hits(m, queries, n, F.col("state") == TEXT_ONLY, lambda score, _: [score]).drop("weight")
    return found.join(m.select("id", "text"), "id")


def _steps(m: DataFrame, as_of: Column, config: Config) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The snapshot after the steps on records, and the ids that each one took. What a step chose is made once and joined as a
    small change set, so snapshots are never written in between and the records are read once a step."""
    took = {}
    m, took["to_text_store"] = to_text_store(m, as_of, config, bounded)
    m, took["compress"] = compress(m, as_of, config, hold=bounded)
    m, took["to_vector_store"] = to_vector_store(m, as_of, config, bounded)
    m, took["upgrade"] = upgrade(m, as_of, config, bounded)
    m = retry_compression(m, as_of, config=config, hold=bounded)
    m, gone = forget(decay(m, as_of, config), config)
    took["forget"] = settled(gone)
    return m, took


def _report(took: dict[str, DataFrame]) -> DataFrame:
    """(step, n) of the steps that took something."""
    return reduce(DataFrame.union, (rows.select(F.lit(step).alias("step"), "id") for step, rows in took.items())).groupBy("step").agg(F.count("*").alias("n"))


def maintain(m: DataFrame, as_of: Column, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """The steps on records in their order: down, compress, up, upgrade, retry, decay, forget. (snapshot, report of (step, n))."""
    m, took = _steps(m, as_of, config)
    return m, _report(took)


def maintain_all(m: DataFrame, vectors: DataFrame, as_of: Column, config: Config = CONFIG, retries: int = 20, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, vectors (id, embedding, record_id, timestamp, ...), report): the whole run of the maintenance.

    After the steps on records, those that came back to the vector store are merged where they are alike; failed vectors are
    tried again; new vectors are made of what moved up, was upgraded or tried again, by the model in ``options`` (see
    ``embedding.embed``); vectors of records that moved down, were forgotten or merged go. Then orphans go and records
    that should have a vector but don't go back to the text store.
    """
    m, took = _steps(m, as_of, config)
    m, merged = merging.merge_moved(m, took["to_vector_store"].select("id"), as_of, config=config)
    took["merge"] = settled(merged.select(F.explode("deleted_ids").alias("id")))
    failed = bounded(retry_vectors(m, retries, config).select("id"))
    took["retry_vectors"] = failed
    m = settled(_changed(m, failed, state=F.lit(VECTORISED), metadata=md.retry(meta())))
    fresh = took["to_vector_store"].select("id").union(took["upgrade"].select("id")).union(failed.select("id")).distinct()
    made = embed(m.join(fresh, "id", "left_semi").select("id", "text"), **options)
    left = took["to_text_store"].select("id").union(took["forget"].select("id")).union(took["merge"]).union(fresh).distinct()
    new = made.where("embedding is not null").select("id", "embedding", F.col("id").alias("record_id"), as_of.alias("timestamp"))
    # a new vector takes the place of the record's old one
    held = vectors.join(left.withColumnRenamed("id", "record_id"), "record_id", "left_anti").select(*vectors.columns)
    whole = settled(held.unionByName(new.withColumn("embedding", F.col("embedding").cast(vectors.schema["embedding"].dataType)), allowMissingColumns=True))
    lost = settled(orphans(whole, m))
    took["orphans"], took["ghosts"] = lost.select("id"), settled(ghosts(m, whole).select("id"))
    out = _changed(m, took["ghosts"], state=F.lit(TEXT_ONLY))
    return out, whole.join(lost.select("record_id").distinct(), "record_id", "left_anti"), _report(took)


def low_value(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends rows that never get a vector."""
    return m.unionByName(rows.withColumns({"state": F.lit(LOW_VALUE), "vector_id": F.lit(None).cast("string")}), allowMissingColumns=True)
