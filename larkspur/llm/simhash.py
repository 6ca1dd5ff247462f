"""SimHash near-duplicates.

``hamming_components``: multi-index hashing. A fingerprint is cut into two segments of 32 bits. Of two fingerprints
that differ in at most 2 bits, one segment differs in at most 1, so a table of each segment's values is asked for the
Hamming ball of radius 1 around a segment; only set bits are cleared, as of two values one bit apart one has that bit.
Equal segment values in a bucket of at most BUCKET rows are joined and the complete distance is checked in the join.
In a larger bucket no pairs are made: each fingerprint is filed under its other segment with two bits (for a ball's
row: one bit) masked. Fingerprints filed alike are links by construction, and no file holds more than 66 of them.

``near_duplicates``: groups of documents whose five-word shingles have a Jaccard similarity of 0.8 or more.
Candidates are what the same Hamming index finds on their 64-bit fingerprints. At 0.8 two fingerprints differ in 9 bits, far
beyond that ball, so tables of sampled shingles add the candidates that it can't reach; nothing that the index finds is left out
for them. Four independent fingerprints are a loose filter, and the shingles of the rest are compared: first each document
with its closest candidate, then only candidates that aren't in one group by that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected, join_groups, mix, slices

SEED = 42
#: Rows of a bucket up to which its pairs are joined. Any value gives the same links.
BUCKET = 512
#: Shingles are dealt to BANDS groups by hash; a table's key is made of the LEAST smallest of a group.
BANDS, LEAST = 16, 4
SMALL = 24
ALIKE = 0.8
#: Bits of 256 that may differ before shingles are compared. Expected: 37 at Jaccard 0.8, with a deviation of 5 to 6.
DISTANCE = 64
#: Distinct shingles below which the bits spread wider and aren't asked.
FEW = 32
#: Size of a chunk of a large bucket, in shingles and 128 for each document. Any value gives the same groups.
CHUNK = 1 << 19


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(k, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the 64 bits, as a signed number. Null texts and texts without words have fingerprint zero."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([simhash(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _entries(batches):
    """Rows of the two segment tables (ball = false) and of the balls around each segment with one bit cleared."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for segment in (0, 1):
            value = (fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
            row, bit = np.nonzero(value[:, None] & bits)
            keys = np.concatenate([value, value[row] ^ bits[bit]]) | np.uint64(segment << 32)
            who = np.concatenate([fp, fp[row]]).view(np.int64)
            ball = np.arange(len(keys)) >= len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who), pa.array(ball)], names=["key", "fp", "ball"])


def _masked(batches):
    """Files of a large bucket: the other segment with two bits masked for table rows, with one bit for all rows."""
    one = np.uint64(1) << np.arange(32, dtype=np.uint64)
    i, j = np.triu_indices(32, 1)
    for batch in batches:
        key, fp, ball = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(3))
        for masks, rows in ((one[i] | one[j], ~ball), (one, np.ones(len(fp), bool))):
            own, other = fp[rows].view(np.uint64), (1 - (key[rows] >> 32)).astype(np.uint64)
            rest = ((own >> (other * np.uint64(32))) & np.uint64(0xFFFFFFFF))[:, None] & ~masks
            n = len(masks)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key[rows], n)), pa.array(np.tile(masks.view(np.int64), len(own))), pa.array(rest.ravel().view(np.int64)), pa.array(np.repeat(fp[rows], n)), pa.array(np.repeat(ball[rows], n))], names=["key", "mask", "rest", "fp", "ball"])


def hamming_links(distinct: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of different ``fp`` of ``distinct``, a saved table, at 2 or fewer
    differing bits."""
    entries = distinct.select("fp").mapInArrow(_entries, "key long, fp long, ball boolean")
    sizes = entries.groupBy("key").agg(F.count_if(~F.col("ball")).alias("held"), F.count("*").alias("n")).where("held > 0 and n > 1").select("key", "n")
    live = scratch.save("buckets", join_groups(entries, scratch.save("buckets_n", sizes), ["key"], "n"))
    few, many = live.where(F.col("n") <= bucket), live.where(F.col("n") > bucket).select("key", "fp", "ball")
    held, asked = few.where("not ball").alias("h"), few.alias("q")
    near = (F.col("h.key") == F.col("q.key")) & (F.expr("q.ball or h.fp < q.fp")) & F.expr("bit_count(h.fp ^ q.fp) <= 2")
    links = held.join(asked, near).select(F.col("h.fp").alias("a"), F.col("q.fp").alias("b"))
    filed = many.mapInArrow(_masked, "key long, mask long, rest long, fp long, ball boolean").groupBy("key", "mask", "rest")
    files = filed.agg(F.min(F.expr("if(ball, null, fp)")).alias("a"), F.collect_list("fp").alias("members")).where("a is not null and size(members) > 1")
    return links.union(files.select("a", F.explode("members").alias("b")).where("a != b")).distinct()


def hamming_components(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): component_id is the smallest doc_id reachable by links of 2 or fewer
    differing bits, itself included. Equal fingerprints are one node, so copies make no pairs. Every row stays, those of a
    repeated doc_id too; a null doc_id is no smallest one unless all of the component are null. No rows give no rows."""
    scratch = Scratch(prints.sparkSession, "simhash")
    prints = scratch.save("prints", prints)
    distinct = scratch.save("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    links = scratch.save("links", hamming_links(distinct, scratch, bucket))
    scratch.drop("buckets")
    roots = connected(links, scratch).withColumnRenamed("node", "fp")
    rooted = scratch.save("rooted", distinct.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = scratch.save("least", rooted.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")))
    classes = scratch.save("classes", join_groups(rooted, least, ["component"], "prints").select("fp", "component_id", "rows"))
    return join_groups(prints, classes, ["fp"], "rows").select("doc_id", "fp", "component_id")


def _sketch(hashes: np.ndarray) -> tuple[int, bytes, list[int]]:
    """How many distinct shingles (1 of none), 256 bits of SimHash over them, and the keys of the tables."""
    distinct = np.unique(hashes)
    with np.errstate(over="ignore"):
        bits = b"".join(simhash(mix(distinct + np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF))).to_bytes(8, "big") for i in range(1, 5))
        dealt = mix(distinct ^ np.uint64(0xD6E8FEB86659FD93))
        dealt.sort()  # by band, then by hash
        band = (dealt >> np.uint64(60)).astype(np.int64)
        first = np.searchsorted(band, np.arange(BANDS))
        least = np.arange(len(dealt)) - first[band] < LEAST
        sums = np.zeros(BANDS, np.uint64)
        np.add.at(sums, band[least], mix(dealt[least]))
        keys = mix(sums ^ np.arange(BANDS, dtype=np.uint64))
    filled = np.unique(band) if len(dealt) else np.zeros(1, np.int64)
    return max(1, len(distinct)), bits, keys[filled].view(np.int64).tolist()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, known, text): rows are told apart by doc_id, 0 for null, and a hash of the text and of whether doc_id is null."""
    own = F.col(doc_id).cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("id"), row_hash(own, F.col(text)).alias("h"), own.isNotNull().alias("known"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_hash(own, body):
    return F.xxhash64(own.isNull(), F.coalesce(body, F.lit("")))


def sketches(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, h, known, n long, b0..b3 long, keys array<long>) of ``_keyed``. Texts without words share one key and are alike."""

    def run(batches):
        for batch in slices(batches):
            found = [_sketch(shingle_hashes(t.as_py(), shingle)) for t in batch.column(3)]
            words = np.frombuffer(b"".join(b for _, b, _ in found), ">i8").astype(np.int64).reshape(-1, 4)
            n, keys = pa.array([n for n, _, _ in found], pa.int64()), pa.array([k for _, _, k in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)), keys], names=["id", "h", "known", "n", "b0", "b1", "b2", "b3", "keys"])

    return rows.mapInArrow(run, "id long, h long, known boolean, n long, b0 long, b1 long, b2 long, b3 long, keys array<long>")


def shingle_sets(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """``rows``, which has a text, with the distinct shingles ``s`` in its place; a single zero for a text without words."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in slices(batches):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(batch.schema.get_field_index("text"))]
            sets = pa.array([x if len(x) else np.zeros(1, np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), sets], names=[*kept, "s"])

    return rows.mapInArrow(run, rows.select(*kept, F.array().cast("array<long>").alias("s")).schema)


def _alike(rows: pa.Table, alike: float) -> pa.Table:
    """(a, b) of the members of one part of a star whose shingles are alike with those of its head."""
    rows = rows.combine_chunks()
    node, head, sets = rows.column("node").to_numpy(), rows.column("head").to_numpy(), pa.concat_arrays(rows.column("s").chunks)
    size, flat = np.diff(sets.offsets.to_numpy()).astype(np.int64), sets.flatten().to_numpy()
    start, h = np.cumsum(size) - size, np.flatnonzero(head)[0]
    own = flat[start[h] : start[h] + size[h]]  # ascending as unsigned, so sorted anew
    common = np.add.reduceat(np.isin(flat, own), start, dtype=np.int64)
    close = np.flatnonzero((common / (size + size[h] - common) >= alike) & ~head)
    return pa.table({"a": pa.array(np.full(len(close), node[h])), "b": pa.array(node[close])})


def _verified(pairs: DataFrame, rows: DataFrame, drawn: DataFrame, scratch: Scratch, name: str, shingle: int, alike: float, chunk: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles have a Jaccard similarity of ``alike`` or more.

    Pairs are stars of a head a and its members b. A star is cut into parts of about ``chunk`` shingles; the head goes to
    each, so that a task holds a part and shingles are shuffled once a pair and once a part."""
    sized = pairs.join(drawn.select(F.col("node").alias("b"), "n"), "b")
    parts = scratch.save(f"parts_{name}", sized.groupBy("a").agg(F.ceil(F.sum(F.col("n") + 128) / chunk).alias("lots"), F.count("*").alias("members")))
    into = F.pmod(F.xxhash64("b"), F.col("lots"))
    members = join_groups(pairs, parts, ["a"], "members").select("a", into.alias("lot"), F.col("b").alias("node"), F.lit(False).alias("head"))
    # a part may have no member by chance: its head comes alone and finds nothing
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("a").alias("node"), F.lit(True).alias("head"))
    roles = members.unionByName(heads).join(drawn.select("node", "id", "h"), "node")
    sets = shingle_sets(rows.join(roles, ["id", "h"]).select("a", "lot", "node", "head", "text"), shingle)
    return sets.dropDuplicates(["a", "lot", "node"]).groupBy("a", "lot").applyInArrow(lambda t: _alike(t, alike), "a long, b long")


def _split_buckets(many: DataFrame, groups: DataFrame, drawn: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of large buckets that aren't one group: key, node, label (the group), minor (not of the bucket's largest
    group) and the sketch."""
    labelled = scratch.save("labelled", many.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")))
    kinds = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = kinds.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("size")).where("labels > 1").drop("labels")
    main = scratch.save("main", main)
    return join_groups(labelled, main, ["key"], "size").withColumn("minor", F.expr("label <> main")).drop("main", "size").join(drawn.drop("keys"), "node")


def _across(rows: pa.Table, distance: int, alike: float) -> pa.Table:
    """Links (a, b) of one part of a bucket from its heads to its other rows. Pairs of one group need no comparison,
    and groups that a link joins are one from then on."""
    rows = rows.combine_chunks()
    ids, root, head, minor = (rows.column(c).to_numpy().copy() for c in ("node", "label", "head", "minor"))
    bits = np.stack([rows.column(f"b{i}").to_numpy().view(np.uint64) for i in range(4)], 1)
    sets = pa.concat_arrays(rows.column("s").chunks)
    size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    start = np.cumsum(size) - size
    kinds, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    held, others = np.zeros(len(kinds), bool), np.flatnonzero(~head)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for h in np.flatnonzero(head):
        # two minor rows meet twice, once with each as the head
        may = others[(root[others] != root[h]) & (~minor[others] | (ids[others] > ids[h]))]
        low, high = np.minimum(size[may], size[h]), np.maximum(size[may], size[h])
        may = may[(low / high >= alike) & ((low < FEW) | (np.bitwise_count(bits[may] ^ bits[h]).sum(1) <= distance))]
        if not len(may):
            continue
        own, n = flat[start[h] : start[h] + size[h]], size[may]
        first = np.cumsum(n) - n
        held[own] = True
        common = np.add.reduceat(held[flat[np.arange(n.sum()) + np.repeat(start[may] - first, n)]], first, dtype=np.int64)
        held[own] = False
        close = may[common / (n + size[h] - common) >= alike]
        if len(close):
            joined, one = np.unique(root[close], return_index=True)
            found.append((np.full(len(one), ids[h]), ids[close[one]]))
            root[np.isin(root, joined)] = root[h]
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest_of_buckets(members: DataFrame, sets: DataFrame, scratch: Scratch, distance: int, alike: float, chunk: int) -> DataFrame:
    """(a, b): links between the groups of each bucket. Of two rows in different groups one is minor, so each minor row (a
    head) meets each row: both are dealt to chunks, and each pair of chunks is a part that one task compares."""
    volume = F.col("n") + 128
    sizes = members.groupBy("key").agg(F.ceil(F.sum(volume) / chunk).alias("rows_in"), F.ceil(F.sum(F.when(F.col("minor"), volume)) / chunk).alias("heads_in"), F.count("*").alias("size"))
    dealt = join_groups(members, scratch.save("chunks", sizes), ["key"], "size")
    into = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = dealt.withColumns({"head": F.lit(False), "i": into("rows_in")}).withColumn("j", every("heads_in"))
    heads = dealt.where("minor").withColumns({"head": F.lit(True), "j": into("heads_in")}).withColumn("i", every("rows_in"))
    parts = rows.unionByName(heads).drop("rows_in", "heads_in", "size", "n", "id", "h", "known").join(sets, "node")
    return parts.groupBy("key", "i", "j").applyInArrow(lambda t: _across(t, distance, alike), "a long, b long")


def _joined(groups: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``groups`` (node, component) after ``links`` (a, b) between them; the groups stand for the links that made them."""
    links = scratch.save(f"links_{name}", links)
    if links.isEmpty():
        return groups
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return scratch.save(name, connected(stars.union(links), scratch))


def hamming_candidates(drawn: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: pairs of nodes by their first 64-bit fingerprint. Nodes with equal ones meet the smallest of them, and
    these meet where fingerprints differ in 2 or fewer bits, as ``hamming_links`` finds."""
    prints = scratch.save("prints", drawn.groupBy(F.col("b0").alias("fp")).agg(F.min("node").alias("first"), F.count("*").alias("alike")))
    links = scratch.save("balls", hamming_links(prints, scratch, bucket))
    scratch.drop("buckets")
    of = lambda x: prints.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    same = join_groups(drawn.select("node", F.col("b0").alias("fp")), scratch.save("equal", prints.where("alike > 1")), ["fp"], "alike")
    return near.union(same.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = DISTANCE, small: int = SMALL, alike: float = ALIKE, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, component_id, stays) of the rows that are alike with another: ``id`` and ``h`` as in ``_keyed``,
    component_id the smallest doc_id of the group. One row of a group stays, that of the smallest doc_id, null after all
    others, and of the smallest ``h`` where rows share the doc_id. Rows equal in doc_id and text are one document.

    Documents whose fingerprints differ in 2 or fewer bits are candidates, and documents that share a table key: all pairs in a bucket of at most ``small`` documents; in a larger
    one first each document with the smallest node there, and with the smallest that also shares a second key, so rows
    stay in proportion to documents. Documents of a large bucket that aren't in one group by then are compared by
    ``_rest_of_buckets``, so no pair of it is left out and the groups don't depend on ``small``. Of the pairs of which at
    most ``distance`` of 256 bits differ, those are links whose shingles have a Jaccard similarity of ``alike`` or more.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = _keyed(docs, doc_id, text)
    drawn = scratch.save("drawn", sketches(rows, shingle).withColumn("node", F.monotonically_increasing_id()))
    keyed = drawn.select("node", F.posexplode("keys").alias("i", "key"), "keys")
    beside = [F.xxhash64("key", F.expr(f"keys[(i + {step}) % size(keys)]")).alias(f"k{step}") for step in (1, 5)]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("m")).where("n > 1")
    sizes = scratch.save("sizes", sizes)
    held = scratch.save("rows", join_groups(keyed.select("node", "key", *beside), sizes, ["key"], "n"))
    few, many = held.where(F.col("n") <= small).select("key", "node"), held.where(F.col("n") > small)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = pairs.union(many.select(F.col("m").alias("a"), F.col("node").alias("b")))
    for second in ("k1", "k5"):
        heads = many.groupBy(second).agg(F.min("node").alias("a"), F.count("*").alias("size"))
        pairs = pairs.union(join_groups(many.select(second, "node"), scratch.save(f"heads_{second}", heads), [second], "size").select("a", F.col("node").alias("b")))
    pairs = pairs.union(hamming_candidates(drawn, scratch)).where("a != b").distinct()
    side = lambda x: drawn.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}{c}") for c in ("n", "b0", "b1", "b2", "b3")))
    apart = F.expr(" + ".join(f"bit_count(ab{i} ^ bb{i})" for i in range(4)))
    maybe = (F.least("an", "bn") / F.greatest("an", "bn") >= alike) & ((F.least("an", "bn") < FEW) | (apart <= distance))
    near = scratch.save("near", pairs.join(side("a"), "a").join(side("b"), "b").where(maybe).select("a", "b", apart.alias("apart")))
    closest = scratch.save("closest", near.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"))
    links = scratch.save("links", _verified(closest, rows, drawn, scratch, "closest", shingle, alike, chunk))
    groups = scratch.save("first", connected(links, scratch))
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}c"))
    apart_yet = near.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.col("ac") == F.col("bc"), F.lit(False))).select("a", "b")
    apart_yet = scratch.save("open", apart_yet.join(closest, ["a", "b"], "left_anti"))
    if not apart_yet.isEmpty():
        groups = _joined(groups, _verified(apart_yet, rows, drawn, scratch, "open", shingle, alike, chunk), scratch, "second")
    members = scratch.save("members", _split_buckets(many.select("key", "node"), groups, drawn, scratch))
    if not members.isEmpty():
        wanted = members.select("id", "h", "node").distinct()
        sets = scratch.save("rest", shingle_sets(rows.join(wanted, ["id", "h"]).select("node", "text"), shingle).dropDuplicates(["node"]))
        groups = _joined(groups, _rest_of_buckets(members, sets, scratch, distance, alike, chunk), scratch, "third")
    named = scratch.save("named", groups.join(drawn.select("node", "id", "h", "known"), "node"))
    least = named.groupBy("component").agg(F.min(F.struct((~F.col("known")).alias("unknown"), "id", "h")).alias("first"), F.count("*").alias("size"))
    of_group = join_groups(named, scratch.save("representatives", least), ["component"], "size")
    stays = (F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))
    return of_group.select("id", "h", F.when(F.col("first.unknown"), None).otherwise(F.col("first.id")).alias("component_id"), stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one document of each group: see ``near_duplicates``. Rows without a group all stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    gone = found.where("not stays").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    own = docs[doc_id].cast("long")
    return docs.join(gone, (F.coalesce(own, F.lit(0)) == gone["__id"]) & (row_hash(own, docs[text]) == gone["__h"]), "left_anti")
