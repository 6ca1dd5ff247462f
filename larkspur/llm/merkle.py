"""A Merkle manifest of a table: a digest of each row, of each group, and of the whole, with the path that proves a row.

Levels are DataFrames. Rows are numbered in their group, each number divided by the fanout is the number of the parent, and
the sorted digests of its children are hashed into it; a level is a table in the shared folder. A group of one node is
done. Paths are made from the root down: each level is joined with the one above it, and the children beside a node
are put before the path of its parent. So a level's join moves as many rows as the level has, and only the last one moves
whole paths, one for ``fanout`` rows. Digests are bytes here, and text where they are hashed and in the result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered

#: Nodes of a level for one task.
NODES = 1 << 15
#: Levels of paths in one plan.
TOGETHER = 5
_STEP = "array<struct<before: binary, after: binary>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon, and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(parts: list[Column]) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _of_children(kids: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(kids, _text), ""), 256))


def tree(nodes: DataFrame, fanout: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], set[int]]:
    """The levels above ``nodes`` (grp, idx, n, hash), of which each grp has the n numbers from 0 on; ``nodes`` is the
    first. Others are (grp, idx, n, hash, kids): n nodes of that grp are on the level, kids are the children's digests. Then
    the numbers of the levels on which a group is done."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    height = sum(((F.col("n") > p).cast("int") for p in powers), F.lit(0))
    firsts = nodes.where("idx = 0").groupBy(height.alias("height")).agg(F.max("n"), F.sum("n"), F.count("*")).collect()  # a row for each height
    most, rows, groups = max((r[1] for r in firsts), default=0), sum(r[2] for r in firsts), sum(r[3] for r in firsts)
    levels = [nodes]
    while most > 1:
        most, rows = -(-most // fanout), rows // fanout + groups
        above = levels[-1].where("n > 1").groupBy("grp", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        # a parent's children are at most ``fanout``
        made = above.agg(kids.alias("kids")).withColumn("hash", _of_children(F.col("kids"))).select("grp", "idx", "n", "hash", "kids")
        levels.append(scratch.save(f"{name}{len(levels)}", made.coalesce(-(-rows // NODES)) if rows < 8 * NODES else made))
    return levels, {r[0] for r in firsts}


def roots(levels: list[DataFrame], done: set[int]) -> DataFrame:
    """(grp, hash) of the last node of each group."""
    ends = [levels[k].where("n = 1").select("grp", "hash") for k in sorted(done)] or [levels[0].select("grp", "hash")]
    return functools.reduce(DataFrame.union, ends)


def paths(levels: list[DataFrame], done: set[int], fanout: int, tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of the first of ``levels`` with ``path`` and ``subroot``: the digests before and after each node on the way
    up, then those of ``tops`` (grp, path, subroot), which continue the way of a group's last node."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        found = here.where("n = 1").join(tops, "grp") if k in done or above is None else None
        if above is not None:
            up = above.select(F.col("grp").alias("g"), F.col("idx").alias("parent"), F.col("kids").alias("around"), F.col("path").alias("way"), "subroot")
            joined = here.where("n > 1").join(up, (F.col("grp") == F.col("g")) & (F.expr(f"idx div {fanout}") == F.col("parent")))
            at = (F.col("idx") % fanout).cast("int")
            whole = lambda x: F.aggregate(x, F.lit("").cast("binary"), lambda s, d: F.concat(s, d))
            step = F.struct(whole(F.slice("around", F.lit(1), at)).alias("before"), whole(F.slice("around", at + 2, fanout)).alias("after"))
            joined = joined.withColumn("path", F.concat(F.array(step).cast(_STEP), "way")).select(*here.columns, "path", "subroot")
            found = joined if found is None else found.unionByName(joined)
        above = scratch.save(f"{name}{k}", found) if k and (len(levels) - k) % TOGETHER == 0 else found
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to, as text."""
    return F.aggregate(path, _text(leaf), lambda h, s: F.sha2(F.concat(_text(s["before"]), h, _text(s["after"])), 256))


def manifest(rows: DataFrame, leaf: Column, again: Column, group: str = "lang", key: str = "doc_id", fanout: int = 2) -> DataFrame:
    """(key, leaf, subroot, root, path, folded_root, verified), a row for each of ``rows``, digests as text.

    ``leaf`` is a row's digest, ``again`` that of the row as it is found when it is verified. In each value of ``group``
    the leaves ascend by ``key``, null first, of equal keys by their digests; ``fanout`` nodes that follow each other
    become one, the last one may have fewer children, until one is left, the group's subroot. Subroots ascend by group, null
    first, then by bytes, and become the root alike. ``folded_root`` is made of ``again`` and the path. Equal rows are
    leaves of their own, null groups are one group, other columns change nothing but through ``leaf``. No rows give no rows.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    grp = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    drawn = scratch.save("drawn", rows.select(F.col(key).alias("own"), grp.alias("grp"), leaf.alias("hash"), again.alias("again")))
    leaves = scratch.save("leaves", numbered(drawn, ["grp"], ["own", "hash", "again"], scratch, "sorted"))
    levels, done = tree(leaves, fanout, scratch, "level")
    subroots = scratch.save("subroots", roots(levels, done).withColumn("all", F.lit("")))
    subroots = numbered(subroots, ["all"], ["grp"], scratch, "ordered").select(F.col("all").alias("grp"), "idx", "n", "hash", F.col("grp").alias("of"))
    subroots = scratch.save("firsts", subroots)
    upper, last = tree(subroots, fanout, scratch, "upper")
    start = roots(upper, last).select("grp", F.array().cast(_STEP).alias("path"), F.col("hash").alias("subroot"))
    top = paths(upper, last, fanout, start, scratch, "down").select(F.col("of").alias("grp"), "path", F.col("hash").alias("subroot"))
    found = paths(levels, done, fanout, scratch.save("tops", top), scratch, "way")
    root = roots(upper, last).select(_text(F.col("hash")).alias("root"))  # one row
    whole = found.join(F.broadcast(root)).withColumn("folded_root", folded(F.col("again"), F.col("path")))
    text = F.flatten(F.transform("path", lambda s: F.array(_text(s["before"]), _text(s["after"]))))
    return whole.select(F.col("own").alias(key), _text(F.col("hash")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), "root", F.array_join(text, "").alias("path"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
