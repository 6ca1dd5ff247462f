"""Marks of a record's metadata struct. Each takes the struct column and gives the changed one; times are ``as_of``.

Only a true flag counts: null and false are unset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONFIG, METADATA
from .text import tokens

_TYPES = {f.name: f.dataType for f in METADATA.fields}
COMPRESSION_KEYS = ["compressed", "compressed_time", "compression_strategy", "original_length", "pending_compression", "pending_since", "retry_count"]


def flag(md: Column, name: str) -> Column:
    return F.coalesce(md[name], F.lit(False))


def put(md: Column, **values) -> Column:
    for name, value in values.items():
        column = value if isinstance(value, Column) else F.lit(value)
        md = md.withField(name, column.cast(_TYPES[name]) if name in _TYPES else column)
    return md


def clear(md: Column, *names: str) -> Column:
    return put(md, **dict.fromkeys(names))


def is_protected(md: Column) -> Column:
    return flag(md, "protected") | flag(md, "important") | flag(md, "preserve")


def skip_merge(md: Column) -> Column:
    return flag(md, "protected") | flag(md, "high_density")


def merge_priority(md: Column) -> Column:
    ranks = [("protected", 100), ("forgotten", 0), ("important", 80), ("high_density", 70), ("preserve", 60), ("compressed", 40)]
    out = F.when(flag(md, ranks[0][0]), ranks[0][1])
    for name, rank in ranks[1:]:
        out = out.when(flag(md, name), rank)
    return out.otherwise(20)


def cooling_from_l2(md: Column, as_of: Column, hours: int = CONFIG.cooldown_hours) -> Column:
    """Promoted to the vector store less than ``hours`` ago."""
    return flag(md, "promoted_to_l2") & F.coalesce(as_of < md["promoted_time"] + F.make_interval(hours=F.lit(hours)), F.lit(False))


def cooling_from_l3(md: Column, as_of: Column, hours: int = CONFIG.cooldown_hours) -> Column:
    """Moved up from the text store less than twice ``hours`` ago."""
    return flag(md, "moved_from_l3") & F.coalesce(as_of < md["moved_from_l3_time"] + F.make_interval(hours=F.lit(2 * hours)), F.lit(False))


def cooling_back(md: Column, as_of: Column, hours: int = CONFIG.cooldown_hours) -> Column:
    """Moved down from the vector store less than ``hours`` ago."""
    return flag(md, "moved_from_l2") & F.coalesce(as_of < md["moved_from_l2_time"] + F.make_interval(hours=F.lit(hours)), F.lit(False))


def skip_compression(md: Column) -> Column:
    return (flag(md, "compressed") & ~flag(md, "needs_recompression")) | is_protected(md)


def mark_compressed(md: Column, strategy, original_length, as_of: Column) -> Column:
    return put(md, compressed=True, compressed_time=as_of, compression_strategy=strategy, original_length=original_length)


def mark_preserve(md: Column, reason) -> Column:
    return put(md, preserve=True, preserve_reason=reason)


def mark_protected(md: Column, reason) -> Column:
    return put(md, protected=True, protected_reason=reason)


def mark_moved_to_l3(md: Column, as_of: Column) -> Column:
    return clear(put(md, moved_from_l2=True, moved_from_l2_time=as_of), "moved_from_l3", "moved_from_l3_time")


def mark_moved_to_l2(md: Column, as_of: Column) -> Column:
    return put(clear(md, "moved_from_l2", "moved_from_l2_time"), moved_from_l3=True, moved_from_l3_time=as_of, promoted_to_l2=True, promoted_time=as_of)


def mark_pending(md: Column, as_of: Column) -> Column:
    return put(md, pending_compression=True, pending_since=as_of, retry_count=F.coalesce(md["retry_count"], F.lit(0)))


def clear_pending(md: Column) -> Column:
    """The number of retries stays."""
    return clear(md, "pending_compression", "pending_since")


def mark_forgotten(md: Column, reason, as_of: Column) -> Column:
    return put(md, forgotten=True, forgotten_time=as_of, forgotten_reason=reason)


def unmark_forgotten(md: Column) -> Column:
    return put(clear(md, "forgotten_time", "forgotten_reason"), forgotten=False, needs_revectorization=True)


def mark_dense(md: Column, reason) -> Column:
    return put(md, high_density=True, high_density_reason=reason)


def mark_merged(md: Column, ids: Column, as_of: Column) -> Column:
    return put(clear(md, *COMPRESSION_KEYS), merged=True, merged_at=as_of, merged_count=F.size(ids), merged_ids=ids, needs_recompression=True)


def mark_upgraded(md: Column, as_of: Column) -> Column:
    return put(md, upgraded=True, upgraded_time=as_of, sqlite_only=False)


def clear_compression(md: Column) -> Column:
    return clear(md, *COMPRESSION_KEYS)


def retry(md: Column, name: str = "vectorization_retries") -> Column:
    return put(md, **{name: F.coalesce(md[name], F.lit(0)) + 1})


def token_count(md: Column, text: Column) -> Column:
    """The stored count, else the estimate."""
    return F.coalesce(md["token_count"], tokens(text))


def set_token_count(md: Column, text: Column, as_of: Column) -> Column:
    return put(md, token_count=tokens(text), token_count_updated=as_of)


def set_tag(md: Column, tag: Column) -> Column:
    return put(md, semantic_tag=F.to_json(tag))


def get_tag(md: Column, schema: str) -> Column:
    """The stored tag, null if it isn't valid JSON."""
    return F.from_json(md["semantic_tag"], schema)


def mark_tag_corrected(md: Column, as_of: Column) -> Column:
    return put(md, tag_corrected_time=as_of)


def set_filter_result(md: Column, result) -> Column:
    return put(md, filter_result=result)


def set_sqlite_id(md: Column, record_id) -> Column:
    return put(md, sqlite_id=record_id)


def sqlite_id(md: Column) -> Column:
    return md["sqlite_id"]


def is_sqlite_only(md: Column) -> Column:
    return flag(md, "sqlite_only")


def is_compressed(md: Column) -> Column:
    return flag(md, "compressed")


def is_forgotten(md: Column) -> Column:
    return flag(md, "forgotten")


def is_pending(md: Column) -> Column:
    return flag(md, "pending_compression")


def flatten(md: Column) -> Column:
    """The set marks as one JSON object, as a store of flat fields keeps them."""
    return F.to_json(md)


def filter_result(md: Column) -> Column:
    return F.coalesce(md["filter_result"], F.lit("normal"))


def mark_important(md: Column, on: bool = True) -> Column:
    """Both the flag and the tag list."""
    tags = F.coalesce(md["tags"], F.array().cast("array<string>"))
    return put(md, important=on, tags=F.array_union(tags, F.array(F.lit("important"))) if on else F.array_remove(tags, "important"))
