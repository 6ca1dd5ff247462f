"""The registered queries of this package, each over whole tables, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination, report
from .exact_dedup import exact_duplicates
from .hidden_markov import HiddenMarkov
from .hyperminhash import similar_sets
from .merkle import digest, framed, manifest
from .resample import resample
from . import language_id, pii, sentencepiece, token_counts
from .substring_dedup import remove_repeats
from .simhash import fingerprints, hamming_components
from .toxicity import fit_chain, score


#: Where the public vocabularies lie. A path, so that they needn't be copied.
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_token_counts(spark, sf_dir):
    vocabulary = token_counts.Vocabulary(PATTERN, token_counts.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    return token_counts.attribute(table(spark, sf_dir, "documents"), vocabulary)


def op2_hidden_markov(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = HiddenMarkov(table(spark, sf_dir, "documents"), held_out)
    model.prepare()
    return model.score(model.train())


def op3_simhash(spark, sf_dir):
    found = hamming_components(fingerprints(table(spark, sf_dir, "documents"), shingle=3))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op5_decontamination(spark, sf_dir):
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op6_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    pieces = sentencepiece.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    found = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, check="decodes")
    n, digest = F.coalesce(F.size("ids"), F.lit(0)).cast("long"), F.sha2(F.array_join("ids", ","), 256)
    return found.select("doc_id", n.alias("n_pieces"), digest.alias("ids_sha256"), "decodes")


def op8_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).withColumn("rejected", F.col("p_toxic") >= chain.thresholds[chain.names.index("toxic")])


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # a row without a doc_id is learned from
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = language_id.predict(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_hyperminhash(spark, sf_dir):
    return similar_sets(table(spark, sf_dir, "documents"), shingle=3, alike=0.85)


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = lambda n_chars: [framed(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]
    leaf, changed = digest(fields(F.col("n_chars"))), digest(fields(F.col("n_chars") + 1))
    found = manifest(docs, leaf, F.when(tampered, changed).otherwise(leaf), group="lang", fanout=2)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_target_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_target_resampling": op13_target_resampling,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: each byte's two halves, the lower one first, against a table of 16 entries."""
    table = []
    for half in range(16):
        for _ in range(4):
            half = (half >> 1) ^ (0xEDB88320 * (half & 1))
        table.append(half)
    entries = f"[{', '.join(map(str, table))}]"
    half = lambda c, h: f"xor({c} >> 4, {entries}[(xor({c}, {h}) & 15) + 1])"
    digit = "(instr('0123456789ABCDEF', {0}) - 1)"
    step = half(half("c", "(b & 15)"), "(b >> 4)")
    each = f"[{digit.format('x[2 * i - 1]')} * 16 + {digit.format('x[2 * i]')} FOR i IN range(1, length(x) // 2 + 1)]"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: {step}), 4294967295) FROM (SELECT hex({text}) AS x))"


_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

ORACLE_SQL = {
    "op11_hyperminhash": f"""
        WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingle AS MATERIALIZED (
            SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM doc, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
        ),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach AS (
            SELECT doc_id, doc_id AS other FROM doc
            UNION SELECT doc_id, e.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) AS e ON e.a = other
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN size USING (doc_id)
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE leaf AS MATERIALIZED (
            SELECT doc_id, {_LEAF} AS h, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE {_LEAF} END AS again,
                   CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
            FROM documents
        ),
        tree AS (
            SELECT grp, 0 AS lvl, idx, n, h FROM leaf
            UNION ALL SELECT grp, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY grp, lvl, idx // 2, n
        ),
        held AS MATERIALIZED (SELECT * FROM tree),
        sub AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM held WHERE n = 1),
        top AS (
            SELECT 0 AS lvl, idx, n, h FROM sub
            UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n
        ),
        above AS MATERIALIZED (SELECT * FROM top),
        up AS (
            SELECT doc_id, grp, 0 AS lvl, idx, '' AS proof, again AS f, 'in' AS part FROM leaf
            UNION ALL
            SELECT doc_id, up.grp, CASE WHEN done THEN 0 ELSE up.lvl + 1 END, CASE WHEN done THEN s.idx ELSE up.idx // 2 END,
                   proof || CASE WHEN done THEN '' ELSE coalesce(held.h, above.h, '') END,
                   CASE WHEN done THEN f WHEN up.idx % 2 = 0 THEN sha256(f || coalesce(held.h, above.h, '')) ELSE sha256(coalesce(held.h, above.h, '') || f) END,
                   CASE WHEN done THEN 'over' ELSE part END
            FROM (SELECT up.*, part = 'in' AND m.n = 1 AS done, CASE WHEN part = 'in' THEN m.n ELSE t.n END AS n FROM up
                  LEFT JOIN (SELECT DISTINCT grp, lvl, n FROM held) m ON part = 'in' AND m.grp = up.grp AND m.lvl = up.lvl
                  LEFT JOIN (SELECT DISTINCT lvl, n FROM above) t ON part = 'over' AND t.lvl = up.lvl) AS up
            LEFT JOIN sub s ON s.grp = up.grp
            LEFT JOIN held ON part = 'in' AND held.grp = up.grp AND held.lvl = up.lvl AND held.idx = up.idx + 1 - 2 * (up.idx % 2)
            LEFT JOIN above ON part = 'over' AND above.lvl = up.lvl AND above.idx = up.idx + 1 - 2 * (up.idx % 2)
            WHERE done OR up.n > 1
        )
        SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
        FROM leaf JOIN sub USING (grp) JOIN (SELECT doc_id, proof, f, row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) AS k FROM up WHERE part = 'over') AS u USING (doc_id),
             (SELECT h FROM above WHERE n = 1) AS r
        WHERE k = 1
    """,
    "op13_target_resampling": f"""
        WITH text AS (SELECT 'd' AS kind, doc_id AS id, {_ALNUM_WORDS} AS w FROM documents UNION ALL SELECT 'b', row_number() OVER (), {_ALNUM_WORDS} FROM benchmark),
        gram AS MATERIALIZED (SELECT kind, id, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS c FROM text, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
        bucket AS MATERIALIZED (SELECT g, {_crc32_sql("g")} % 10000 AS b FROM (SELECT DISTINCT g FROM gram)),
        held AS (SELECT b, coalesce(sum(c) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(c) FILTER (WHERE kind = 'b'), 0) AS t FROM gram JOIN bucket USING (g) GROUP BY b),
        gain AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)))) AS BIGINT) AS y FROM held),
        sums AS (SELECT id, sum(c) AS n, sum(c * y) AS y FROM gram JOIN bucket USING (g) JOIN gain USING (b) WHERE kind = 'd' GROUP BY id),
        scored AS (
            SELECT id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(y, 0) AS BIGINT) AS weight,
                   CAST(coalesce(y, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM text LEFT JOIN sums USING (id) WHERE kind = 'd'
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
        SELECT id AS doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed
    """,
    "op8_substring_dedup": f"""
        WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM doc, unnest(range(1, len(w) - 33)) AS t(i)),
        twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM win JOIN twice USING (h), unnest(range(i, i + 35)) AS t(p)),
        word AS (SELECT doc_id, p, w[p] AS word FROM doc, unnest(range(1, len(w) + 1)) AS t(p)),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
            FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)
    """,
    "op5_decontamination": f"""
        WITH item AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
        win AS (
            SELECT item_id, 10 AS n, array_to_string(w[i:i + 9], ' ') AS g FROM item, unnest(range(1, len(w) - 8)) AS t(i) WHERE len(w) >= 10
            UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM item WHERE len(w) BETWEEN 1 AND 9
        ),
        doc AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
        grams AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM doc, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
        ),
        hit AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
