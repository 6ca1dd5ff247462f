"""Statistics of stores, latencies and health."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from . import records


def store_stats(m: DataFrame, as_of: Column) -> DataFrame:
    """One row, in one scan."""
    live = m.where(~F.col("is_archived"))
    return live.agg(F.count("*").alias("total"), F.round(F.avg("weight"), 3).alias("mean_weight"), F.count_if(F.col("weight") > 2).alias("heavy"), F.count_if(F.col("weight") < 0.6).alias("light"), F.count_if(F.col("last_access_time") >= as_of - records.days(1)).alias("recent"))


def tier_stats(m: DataFrame) -> DataFrame:
    tier = F.when(F.col("state") == 1, "L2").otherwise("L3")
    return m.where(~F.col("is_archived")).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def last_samples(samples: DataFrame, key: str, order: list[str], size: int = 1000) -> DataFrame:
    """The last samples of each key: a window with a rank filter keeps that many a task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return samples.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def percentiles(samples: DataFrame, key: str, value: str) -> DataFrame:
    """By index in sorted order, without interpolation: p50 at n/2, p95 and p99 at their share of n, or the largest value
    of fewer than 20 or 100 samples. ``samples`` is bounded for each key (``last_samples``)."""
    g = samples.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("s"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    n = F.size("s")
    at = lambda share, least: F.when(n >= least, F.element_at("s", F.floor(n * share).cast("int") + 1)).otherwise(F.col("most"))
    return g.select(key, n.cast("long").alias("n"), F.element_at("s", F.floor(n / 2).cast("int") + 1).alias("p50"), at(0.95, 20).alias("p95"), at(0.99, 100).alias("p99"), "mean", "most")


#: Size of a quantile sketch; a rank it gives is off by less than RANK_ERROR of all values with 99 % probability.
SKETCH, RANK_ERROR = 400, 0.0075


def sketched(samples: DataFrame, keys: list[str], value: str, k: int = SKETCH) -> DataFrame:
    """(keys, n, sketch, total): a KLL sketch of all values of each key, some kB whatever their number. Sketches of parts, such as
    days, are kept and merged by ``merged_sketches``; nothing is sampled away but by the sketch."""
    return samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.sum(value).alias("total"))


def merged_sketches(parts: DataFrame, keys: list[str], k: int = SKETCH) -> DataFrame:
    """Sketches of coarser ``keys`` from those of finer ones."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("total").alias("total"))


def sketch_percentiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p50, p95, p99, mean) of sketches, for any number of values; ``percentiles`` is the exact form for few."""
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    return parts.select(*keys, "n", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), (F.col("total") / F.col("n")).alias("mean"))


def rates(events: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """The share of rows of each key that satisfy each condition; of no rows 0."""
    return events.groupBy(key).agg(F.count("*").alias("n"), *((F.count_if(c) / F.greatest(F.count("*"), F.lit(1))).alias(name) for name, c in parts.items()))


def health(metrics: DataFrame, queue: str = "queue", unhealthy: Column | None = None, degraded: Column | None = None) -> DataFrame:
    """``metrics`` with status: unhealthy before degraded before healthy; a queue of over 100 is degraded."""
    bad = unhealthy if unhealthy is not None else F.lit(False)
    weak = (degraded if degraded is not None else F.lit(False)) | (F.col(queue) > 100)
    return metrics.withColumn("status", F.when(bad, "unhealthy").when(weak, "degraded").otherwise("healthy"))


def band(value: Column, passes: float, warns: float, higher_is_better: bool = False) -> Column:
    """PASS, WARN or FAIL by two limits; null is SKIP."""
    if higher_is_better:
        return F.when(value.isNull(), "SKIP").when(value >= passes, "PASS").when(value >= warns, "WARN").otherwise("FAIL")
    return F.when(value.isNull(), "SKIP").when(value < passes, "PASS").when(value < warns, "WARN").otherwise("FAIL")


def checklist(queue: Column, success: Column, p95: Column, disk_gb: Column) -> Column:
    return F.struct(band(queue, 100, 200).alias("queue"), band(success, 80, 40, True).alias("success"), band(p95, 200, 400).alias("p95"), band(disk_gb, 10, 5, True).alias("disk"))


def adaptive_timeout(samples: DataFrame, key: str, order: list[str], value: str, last: int = 20, low: float = 10, high: float = 300) -> DataFrame:
    """``samples`` with twice the p95 of a sample and the 19 before it, within limits."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    s = F.sort_array(F.collect_list(value).over(w))
    p95 = F.element_at(s, F.least(F.floor(F.size(s) * 0.95).cast("int") + 1, F.size(s)))
    return samples.withColumn("timeout", F.greatest(F.lit(low), F.least(F.lit(high), p95 * 2)))


def circuit(events: DataFrame, key: str, order: list[str], ok: Column, failures: int = 5) -> DataFrame:
    """``events`` with the failures in a row up to each and whether the circuit opens there. Runs are numbered by running
    sums, so no state is kept by hand."""
    w = Window.partitionBy(key).orderBy(*order)
    good = events.withColumn("__ok", ok).withColumn("__run", F.sum(F.col("__ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.sum((~F.col("__ok")).cast("int")).over(Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return good.withColumn("failures", row).withColumn("opens", ~F.col("__ok") & (F.col("failures") % failures == 0)).drop("__ok", "__run")


def folded(events: DataFrame, key: str, order: list[str], fields: list[str], schema: str, start, step) -> DataFrame:
    """A state machine over each key's events in order: ``step(state, *fields)`` gives the next state and the row's outcome,
    a tuple as ``schema`` says. Keys stream through their tasks, so that only one state is held at a time."""
    out = schema.split(",")
    names = [c.split()[0] for c in out]

    def run(batches):
        now, state = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = []
            for k, *values in zip(*columns[: 1 + len(fields)]):
                if state is None or k != now:
                    now, state = k, start()
                state, row = step(state, *values)
                rows.append(row)
            kept = batch.columns[1 + len(fields) :]
            found = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, *found], names=[key, *order, *names])

    shown = events.select(key, *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)), *order)
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in out]
    result = events.select(key, *order).schema.simpleString()[7:-1] + ", " + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in out)
    return shown.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, result.replace(":", " "))


LEVELS = ["none", "minimal", "partial", "severe", "critical"]


def degradation(events: DataFrame, key: str, order: list[str], degrades: str, attempts: int = 3) -> DataFrame:
    """(key, order columns, level): the level of each component after each event. ``degrades``, a boolean column, takes it one
    level down; else it is an attempt to recover, and every third one since the last change takes it one level up."""

    def step(state, down):
        level, tried = state
        if down:
            state = (min(level + 1, len(LEVELS) - 1), 0) if level < len(LEVELS) - 1 else state
        elif level:
            state = (level - 1, 0) if tried + 1 >= attempts else (level, tried + 1)
        return state, (LEVELS[state[0]],)

    return folded(events, key, order, [degrades], "level string", lambda: (0, 0), step)


def circuit_states(events: DataFrame, key: str, order: list[str], ok: str, seconds: str, failures: int = 5, pause: int = 300) -> DataFrame:
    """(key, order columns, allowed, state): what a circuit breaker does with each request. After ``failures`` failures in a row
    it is open and rejects; ``pause`` seconds after the last failure one request is let through, half open, and its success
    closes the circuit. A rejected request neither succeeds nor fails."""

    def step(state, good, at):
        name, count, last = state
        if name == "open" and at - last < pause:
            return state, (False, "open")
        if good:
            return ("closed", 0, last), (True, "closed")
        name = "open" if count + 1 >= failures else "half_open" if name == "open" else name
        return (name, count + 1, at), (True, name)

    return folded(events, key, order, [ok, seconds], "allowed boolean,state string", lambda: ("closed", 0, 0), step)


def event_counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n"))


def queue_stats(pending: DataFrame, enqueued: Column, dropped: Column, size: int = 1000) -> DataFrame:
    """One row: rows that wait, the queue's size, all that came, what was dropped and its share. ``enqueued`` and ``dropped``
    are conditions on rows."""
    sums = pending.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(enqueued).alias("enqueued"), F.count_if(dropped).alias("dropped"))
    return sums.withColumn("size", F.lit(size)).withColumn("drop_rate", F.col("dropped") / F.greatest("enqueued", F.lit(1)))


def processor_stats(pending: DataFrame, buffered: DataFrame, vectors: DataFrame, m: DataFrame) -> DataFrame:
    """One row: the counts of queue, buffer, vectors and live records."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(pending.where("status = 'pending'"), "pending")
    for df, name in ((buffered, "buffered"), (vectors, "vectors"), (m.where(~F.col("is_archived")), "records")):
        out = out.join(F.broadcast(one(df, name)))
    return out


def tiers(turns_tail: DataFrame, vectors: DataFrame, m: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(tier, n, hits): turns in memory, vectors, and live records; ``hits`` (source) are the results that were served."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tier"), "n")
    out = one(turns_tail, "L1").union(one(vectors, "L2")).union(one(m.where(~F.col("is_archived")), "L3"))
    if hits is None:
        return out
    served = hits.groupBy(F.substring("source", 1, 2).alias("tier")).agg(F.count("*").alias("hits"))
    return out.join(served, "tier", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def overall_health(components: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many components are healthy, degraded and unhealthy, and the worst of these."""
    counts = components.agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("healthy", "degraded", "unhealthy")))
    return counts.withColumn("overall", F.when(F.col("unhealthy") > 0, "unhealthy").when(F.col("degraded") > 0, "degraded").otherwise("healthy"))


def effective_priority(priority: Column, waited_seconds: Column, boost_every: int = 300) -> Column:
    """A task gains one step of priority (smaller is sooner) for each 300 seconds that it has waited."""
    return F.greatest(F.lit(0), priority - F.floor(waited_seconds / boost_every))


def starving(waited_seconds: Column, limit: int = 600) -> Column:
    return waited_seconds > limit


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def archive_stats(archive: DataFrame) -> DataFrame:
    return archive.groupBy("archive_reason").agg(F.count("*").alias("n"), F.min("original_created_time").alias("oldest"), F.max("archived_time").alias("latest"))


def filter_stats(judged: DataFrame, verdict: str = "noise") -> DataFrame:
    """Counts by reason and storage, with their share of all rows."""
    counts = judged.groupBy(F.col(f"{verdict}.reason").alias("reason"), F.col(f"{verdict}.storage").alias("storage")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("every"))  # one row
    return counts.join(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("every")).drop("every")


