"""Merging of similar records: how groups are found, which merge, their texts and metadata, and the next snapshot."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions.tagging import rule_tag
from ..schema import CONFIG, METADATA, Config
from ..sources.shared import scratch_folder, settled
from . import neighbours, records, similar

# Fixed values that results depend on.
#: The least length of an addition, and the room that each must leave.
LEAST, MARGIN = 3, 10
SEPARATOR = " | "
#: Marks of time of which the latest counts.
LATEST = ["timestamp", "merged_at", "compressed_time", "forgotten_time"]

#: A word is a Han character or a run of other characters without white space.
WORD = re.compile(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+")


# texts


def common_words(base: list[str], words: list[str]) -> list[bool]:
    """Which of ``words`` belong to a longest common subsequence with ``base``.

    The row of lengths for a prefix of ``words`` is one number with a bit for each word of ``base``: a bit is zero where the
    length grows. A word turns the row into the next one by an addition and a few bit operations, so the time is that of
    the longer text; the rows are kept for the way back.
    """
    at: dict[str, int] = {}
    for i, w in enumerate(base):
        at[w] = at.get(w, 0) | 1 << i
    every = (1 << len(base)) - 1
    rows, row = [], every
    for w in words:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
        rows.append(row)
    common, i = [False] * len(words), len(base)
    for j in range(len(words) - 1, -1, -1):
        while i and rows[j] >> (i - 1) & 1:
            i -= 1
        if i and (j == 0 or rows[j - 1] >> (i - 1) & 1):
            common[j] = True
            i -= 1
    return common


def additions(base: str | None, text: str | None) -> list[str]:
    """The stretches of ``text`` whose words aren't in its alignment with ``base``, each as it is written."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    known = common_words(WORD.findall(base or ""), [text[a:b] for a, b in spans])
    out, start = [], None
    for k, (a, b) in enumerate(spans):
        if known[k]:
            start = None
        elif start is None:
            start = a
            out.append(text[a:b])
        else:
            out[-1] = text[start:b]
    return out


def merged_texts(own: DataFrame, most: int = CONFIG.merge_max_length) -> DataFrame:
    """(group_id, merged) for groups of rows (group_id, place, text, and base, the text of place 1) where something is added:
    the base and behind it what other texts add, in the order of places, each addition once and only while ``MARGIN``
    is left of ``most`` characters.

    Room only shrinks, so of additions of one length only the first ``most / length`` can ever be taken. Only these are
    brought together, at most some thousand of a group, whatever its size; before that a group is spread over tasks.
    """

    @F.pandas_udf("array<string>")
    def added(base: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([additions(b, t) for b, t in zip(base, text)], dtype=object)

    start = F.coalesce("base", F.lit(""))
    room = F.lit(most - MARGIN) - F.length(start)
    new = own.where(~F.col("text").eqNullSafe(F.col("base")) & (room >= LEAST))
    others = new.groupBy("group_id", "base", "text").agg(F.min("place").alias("place"))
    found = others.select("group_id", "base", "place", F.posexplode(added("base", "text")).alias("pos", "addition"))
    fits = found.where(F.length("addition").between(LEAST, room))
    once = fits.groupBy("group_id", F.lower("addition").alias("same")).agg(F.min(F.struct("place", "pos", "addition")).alias("a"), F.first("base").alias("base"))
    once = once.withColumn("size", F.length("a.addition"))
    first = Window.partitionBy("group_id", "size").orderBy("a")
    kept = once.withColumn("r", F.row_number().over(first)).where(F.col("r") * (F.col("size") + len(SEPARATOR)) <= most)
    lists = kept.groupBy("group_id").agg(F.array_sort(F.collect_list("a")).alias("all"), F.first("base").alias("base"))

    def take(text: Column, a: Column) -> Column:
        more = F.concat(text, F.lit(SEPARATOR), a["addition"])
        return F.when(F.length(text) + F.length(a["addition"]) + MARGIN <= most, more).otherwise(text)

    return lists.select("group_id", F.aggregate("all", start, take).alias("merged"))


def merge_texts(texts: list[str], most: int = CONFIG.merge_max_length) -> str:
    """The same for a few texts at hand."""
    out, seen = (texts[0] or "") if texts else "", set()
    if len(out) > most:
        return f"{out[: most - 3]}..."
    for text in texts[1:]:
        for a in additions(texts[0], text) if text != texts[0] else []:
            if a.lower() not in seen and len(a) >= LEAST and len(out) + len(a) + MARGIN <= most:
                out += SEPARATOR + a
            seen.add(a.lower())
    return out


# groups


def needs_merge(groups: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Leaders of groups that are large enough to merge."""
    return groups.groupBy("leader").count().where(F.col("count") >= config.merge_min_group)


def neighbour_pairs(rows: DataFrame, k: int = 10, base: float = CONFIG.merge_threshold, **options) -> DataFrame:
    """(a, b, similarity), a < b: of each row (id, text, embedding) those of its ``k`` nearest neighbours that reach its own
    threshold. The row itself is left out. Neighbours are those of ``neighbours.neighbour_graph``."""
    near = neighbours.neighbour_graph(rows, scratch_folder(rows.sparkSession, "cells"), k, **options)
    limits = rows.select(F.col("id").alias("a"), similar.dynamic_threshold(F.col("text"), base).alias("limit"))
    return near.join(limits, "a").where("similarity >= limit and b > a").select("a", "b", "similarity")


def group_similar(rows: DataFrame, embedded: bool = True, config: Config = CONFIG, **options) -> DataFrame:
    """(id, leader) of (id, text, weight, created_time, embedding): without embeddings by MinHash, with more than
    ``merge_neighbours_from`` rows by nearest neighbours, else by all pairs of a day. ``merge_most`` of the settings, if
    set, is how many of the heaviest rows a run of the maintenance takes; the others wait for the next one."""
    taken = rows if config.merge_most is None else rows.orderBy(F.desc("weight"), "id").limit(config.merge_most)
    taken = settled(taken)
    if not embedded:
        pairs = similar.minhash_pairs(taken, config.merge_threshold - 0.1, band=4)
    elif taken.count() > config.merge_neighbours_from:
        pairs = neighbour_pairs(taken, base=config.merge_threshold, **options)
    else:
        pairs = similar.vector_pairs(taken, config.merge_threshold, config.merge_hours)
    return similar.greedy_leaders(taken, pairs)


# merging


def merged_metadata(own: DataFrame) -> DataFrame:
    """(group_id, metadata) of (group_id, place, metadata): of marks of time the latest, of lists all values, sorted, of
    others the first by place that is set."""
    value = lambda f: F.col(f"metadata.{f.name}")
    parts = []
    for f in METADATA.fields:
        if f.dataType.typeName() == "array":
            one = F.array_sort(F.array_distinct(F.flatten(F.collect_set(value(f)))))
            one = F.when(F.count(value(f)) > 0, one)
        elif f.name in LATEST:
            one = F.max(value(f))
        else:
            one = F.min_by(value(f), F.when(value(f).isNotNull(), F.col("place")))
        parts.append(one.cast(f.dataType).alias(f.name))
    return own.groupBy("group_id").agg(F.struct(*parts).alias("metadata"))


def conflict_log(members: DataFrame, found: DataFrame, last: int = 100, texts: int = 3) -> DataFrame:
    """(group_id, conflict, texts): the last ``last`` conflicts by group with the first texts by id, for a report."""
    first = Window.partitionBy("group_id").orderBy("id")
    shown = members.join(found.orderBy(F.desc("group_id")).limit(last), "group_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= texts)
    return shown.groupBy("group_id", "conflict").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"]).alias("texts"))


def merge_stats(merged: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(what, n): groups that merge, records that go, and groups by kind of conflict."""
    sums = merged.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.size("deleted_ids")), F.lit(0)).alias("deleted"))
    rows = sums.select(F.explode(F.array(F.struct(F.lit("groups").alias("what"), F.col("groups").cast("long").alias("n")), F.struct(F.lit("deleted").alias("what"), F.col("deleted").cast("long").alias("n")))).alias("s")).select("s.*")
    return rows.unionByName(conflicts.groupBy(F.concat(F.lit("conflict_"), "conflict").alias("what")).agg(F.count("*").alias("n")))


def merge_groups(members: DataFrame, as_of: Column, config: Config = CONFIG, groups: int | None = None) -> DataFrame:
    """One row for each group of records (group_id and a record's columns) that merges: the primary's id and time, the
    merged text, largest weight, sum of accesses, ids and vectors that go, and a metadata struct.

    A group merges if it has ``merge_min_group`` records at least, no conflict among its texts, and two records that are
    neither protected nor dense; the others take no part and stay. The primary has the highest merge priority, then the
    earliest time and id. Texts and metadata of all that take part are merged in that order. ``groups`` takes the first
    groups only, as a run of the maintenance does.
    """
    meta = F.col("metadata")
    large = members.groupBy("group_id").agg(F.count("*").alias("all")).where(F.col("all") >= config.merge_min_group).select("group_id")
    if groups is not None:
        large = large.orderBy("group_id").limit(groups)
    members = settled(members.join(large, "group_id", "left_semi"))
    at_odds = similar.conflicts(members.select("group_id", "text")).select("group_id")
    ranked = members.join(at_odds, "group_id", "left_anti").withColumn("priority", md.merge_priority(meta)).withColumn("joins", ~md.skip_merge(meta))
    whole = ranked.groupBy("group_id").agg(F.max("weight").alias("weight"), F.sum("access_count").alias("access_count"), F.count_if("joins").alias("n"))
    order = Window.partitionBy("group_id").orderBy(F.desc("priority"), "created_time", "id")
    own = settled(ranked.where("joins").withColumns({"place": F.row_number().over(order), "base": F.first("text").over(order)}))
    primary = own.where("place = 1").select("group_id", "id", "base", "created_time", F.col("priority").alias("primary_priority"), md.flag(meta, "important").alias("was_important"), md.flag(meta, "preserve").alias("was_preserved"))
    ids = own.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("ids"), F.bool_or(md.flag(meta, "forgotten")).alias("had_forgotten"), F.array_sort(F.collect_set(F.when(F.col("place") > 1, F.col("vector_id")))).alias("deleted_vectors"))
    texts = merged_texts(own.select("group_id", "place", "text", "base"), config.merge_max_length)
    alone, most = F.coalesce("base", F.lit("")), config.merge_max_length
    alone = F.when(F.length(alone) <= most, alone).otherwise(F.concat(F.substring(alone, 1, most - 3), F.lit("...")))

    out = whole.where("n > 1").join(primary, "group_id").join(ids, "group_id").join(merged_metadata(own), "group_id").join(texts, "group_id", "left").withColumn("text", F.coalesce("merged", alone))
    keep = lambda name, was: F.when((F.col("primary_priority") >= 60) & F.col(was), True).otherwise(F.col("metadata")[name])
    marked = md.put(md.mark_merged(F.col("metadata"), F.col("ids"), as_of), important=keep("important", "was_important"), preserve=keep("preserve", "was_preserved"))
    out = out.withColumn("metadata", marked).withColumn("metadata", md.set_tag(F.col("metadata"), rule_tag("text")))
    return out.select("group_id", "id", "text", "created_time", "weight", "access_count", F.lit("merged").alias("source"), F.array_remove("ids", F.col("id")).alias("deleted_ids"), "deleted_vectors", "had_forgotten", "primary_priority", "metadata")


def apply_merge(m: DataFrame, merged: DataFrame) -> DataFrame:
    """The next snapshot: primaries rewritten for a new vector and compression, the other members gone."""
    gone = merged.select(F.explode("deleted_ids").alias("id")).distinct()
    new = merged.select("id", F.col("text").alias("__text"), F.col("weight").alias("__weight"), F.col("access_count").alias("__access"), F.col("metadata").alias("__meta"))
    j = m.join(gone, "id", "left_anti").join(new, "id", "left")
    on = F.col("__text").isNotNull()
    return j.withColumns({
        "text": F.coalesce("__text", "text"), "weight": F.coalesce("__weight", "weight"), "access_count": F.coalesce("__access", "access_count"),
        "metadata": F.coalesce(md.put(F.col("__meta"), needs_revectorization=True), F.col("metadata")),
        "state": F.when(on, 0).otherwise(F.col("state")), "compressed_text": F.when(~on, F.col("compressed_text")),
    }).drop("__text", "__weight", "__access", "__meta")


def merge_records(m: DataFrame, rows: DataFrame, as_of: Column, embeddings: DataFrame | None = None, config: Config = CONFIG, **options) -> tuple[DataFrame, DataFrame]:
    """(snapshot, merged): similar ones among the records ``rows`` of ``m`` are merged, ``merge_batch`` groups at most.
    ``embeddings`` (id, embedding) are those of the records; without them texts are compared by MinHash."""
    text = F.coalesce("compressed_text", "text")
    chosen = rows.select("id", text.alias("text"), "weight", "created_time")
    if embeddings is not None:
        chosen = chosen.join(embeddings, "id")
    groups = group_similar(chosen, embeddings is not None, config, **options).withColumnRenamed("leader", "group_id")
    members = rows.withColumn("text", text).join(groups, "id")
    merged = merge_groups(members, as_of, config, config.merge_batch)
    return apply_merge(m, merged), merged


def merge_vectorised(m: DataFrame, as_of: Column, embeddings: DataFrame | None = None, config: Config = CONFIG, **options) -> tuple[DataFrame, DataFrame]:
    """The job of every few hours: the latest ``merge_most`` records of the vector store."""
    return merge_records(m, records.recent(m, config.merge_most, True), as_of, embeddings, config, **options)


def merge_moved(m: DataFrame, moved: DataFrame, as_of: Column, embeddings: DataFrame | None = None, config: Config = CONFIG, **options) -> tuple[DataFrame, DataFrame]:
    """After a move to the vector store: only the records (id) that were moved."""
    return merge_records(m, m.join(moved.select("id").distinct(), "id", "left_semi"), as_of, embeddings, config, **options)
