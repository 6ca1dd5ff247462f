"""Turns as a stream: masked, judged, and written as records once; and windowed statistics of events.

The checkpoint takes the place of a write-ahead log and of commit phases: a batch is replayed after a failure and its
write is idempotent. Back-pressure is the number of files a trigger takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import filters, tagging
from ..functions import text as tx
from ..schema import TURNS


def judge(turns: DataFrame) -> DataFrame:
    """Masked turns with their noise verdict; works on batches and streams alike."""
    masked = turns.withColumns({c: filters.mask(c) for c in ("user_input", "assistant_response")})
    return masked.withColumn("noise", filters.noise(F.col("user_input"), F.col("assistant_response")))


def to_records(judged: DataFrame) -> DataFrame:
    """Records of the turns that are kept: text, hash, tag and state (1 for full storage, -1 for text only)."""
    text = F.concat(F.lit("用户: "), F.coalesce("user_input", F.lit("")), F.lit("\n助理: "), F.coalesce("assistant_response", F.lit("")))
    kept = judged.where(F.col("noise.storage") != "discard").withColumn("text", text)
    return kept.select(
        "id", "session_id", "ts", "text", tx.text_hash("text").alias("text_hash"), tx.vector_id("text").alias("vector_id"),
        F.when(F.col("noise.storage") == "full", 1).otherwise(-1).alias("state"), tagging.rule_tag("text").alias("tag"), tx.tokens("text").alias("token_count"),
    )


def once(records: DataFrame) -> DataFrame:
    """One record for each hash, that of the smallest id."""
    columns = [c for c in records.columns if c != "text_hash"]
    return records.groupBy("text_hash").agg(F.min_by(F.struct(*columns), "id").alias("r")).select("text_hash", "r.*").select(*records.columns)


def read_turns(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files).json(path)


def unseen(records: DataFrame, keep: str) -> DataFrame:
    """The records of a stream whose hash hasn't come within ``keep`` of arrival, such as ``7 days``. Hashes are kept in the state
    store for that long, so a trigger reads no table and the state follows what arrives in that time, not the target. Arrival is
    the trigger's time, which only grows, so no record is late, whatever its own time is."""
    arrived = records.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", keep)
    return arrived.dropDuplicatesWithinWatermark(["text_hash"]).drop("__arrived")


def ingest(turns: DataFrame, target: str, checkpoint: str, keep: str | None = "7 days", **trigger) -> StreamingQuery:
    """Appends new records to the Parquet table ``target``. A batch is a folder of its own that a replay overwrites, and
    records that came before within ``keep`` are left out (``unseen``). With ``keep`` None each batch is held against all hashes
    of the target instead: exact for ever, at the cost of reading them."""
    spark, fresh = turns.sparkSession, to_records(judge(turns))

    def write(batch: DataFrame, number: int) -> None:
        new = once(batch)
        if keep is None:
            try:
                held = spark.read.parquet(target).where(F.col("batch") != number).select("text_hash")
                new = new.join(held, "text_hash", "left_anti")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = fresh if keep is None else unseen(fresh, keep)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, minutes: int = 60, late_minutes: int = 30) -> DataFrame:
    """Count, mean and largest value by event type and tumbling window; works on batches and streams. Timestamps without
    a zone are taken as UTC by the session."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("time", f"{late_minutes} minutes")
    return timed.groupBy(F.window("time", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "most")


def sessions(events: DataFrame, gap_minutes: int = 30, late_minutes: int = 30) -> DataFrame:
    """Events of a user that are less than a gap apart."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("time", f"{late_minutes} minutes")
    return timed.groupBy(F.session_window("time", f"{gap_minutes} minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
