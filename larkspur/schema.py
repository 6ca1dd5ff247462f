"""Schemas, settings and the fixed clock of the test views."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T

#: Operators never read the wall clock: they take ``as_of``. The derived test views use this one.
AS_OF = datetime(2024, 7, 1)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I, _D, _B, _TS, _A = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(), T.ArrayType(T.StringType())

#: Flags and marks of a record, typed: only a true boolean counts as set.
METADATA = _struct(
    compressed=_B, compressed_time=_TS, compression_strategy=_S, original_length=_L,
    pending_compression=_B, pending_since=_TS, retry_count=_L,
    protected=_B, protected_reason=_S, important=_B, preserve=_B, preserve_reason=_S,
    moved_from_l2=_B, moved_from_l2_time=_TS, moved_from_l3=_B, moved_from_l3_time=_TS, promoted_to_l2=_B, promoted_time=_TS,
    high_density=_B, high_density_reason=_S, forgotten=_B, forgotten_time=_TS, forgotten_reason=_S,
    merged=_B, merged_at=_TS, merged_count=_L, merged_ids=T.ArrayType(_L), needs_recompression=_B, needs_revectorization=_B,
    upgraded=_B, upgraded_time=_TS, vectorization_retries=_L, token_count=_L, token_count_updated=_TS,
    filter_result=_S, sqlite_only=_B, semantic_tag=_S, tag_corrected_time=_TS, sqlite_id=_L, tags=_A, timestamp=_TS,
)

MEMORIES = _struct(
    id=_L, text=_S, compressed_text=_S, source=_S, weight=_D, access_count=_L, last_access_time=_TS, created_time=_TS,
    metadata=METADATA, is_archived=_B, vector_id=_S, state=_I, text_hash=_S, is_important=_B, is_protected=_B,
    session_id=_S, content_hash=_S,
)
TURNS = _struct(id=_L, session_id=_S, user_input=_S, assistant_response=_S, source=_S, ts=_TS)
SESSIONS = _struct(session_id=_S, status=_S, created_time=_TS, updated_time=_TS, message_count=_L, ui_state=_S, context=_S, metadata=_S)
VECTORS = _struct(id=_S, document=_S, embedding=T.ArrayType(T.FloatType()), timestamp=_TS, record_id=_L)
ARCHIVED = _struct(
    original_id=_L, text=_S, compressed_text=_S, source=_S, weight=_D, access_count=_L, original_created_time=_TS,
    archived_time=_TS, archive_reason=_S,
)

#: Where a record lives: in the text store only, low value or failed, in the vector store; the rest are moves in flight.
TEXT_ONLY, LOW_VALUE, VECTORISED, INTERRUPTED, TO_TEXT, TO_VECTOR = 0, -1, 1, 2, 3, 4


@dataclass(frozen=True)
class Config:
    """Effective settings; the fixed values that results depend on."""

    decay_rate: float = 0.95
    min_weight: float = 0.3
    max_weight: float = 5.0
    boost: float = 1.2
    forget_age_days: int = 30
    recall_multiplier: int = 3
    high_quality: float = 0.95
    results: int = 5
    source_weights: dict[str, float] = field(default_factory=lambda: {"L1": 1.2, "L2": 1.0, "L3": 0.8})
    rrf_k: int = 60
    threshold: float = 0.3
    cooldown_hours: int = 24
    low_weight_multiplier: float = 2.0
    promote_share: float = 0.6
    upgrade_share: float = 0.5
    compress_share: float = 0.8
    compress_after_days: int = 15
    move_batch: int = 20
    promote_batch: int = 10
    compress_batch: int = 50
    compress_min_length: int = 100
    compress_ratio: float = 0.6
    compress_buffer: float = 0.1
    compress_max_segment: int = 2000
    compress_key_sentences: int = 5
    merge_threshold: float = 0.92
    merge_min_group: int = 3
    merge_max_length: int = 500
    merge_batch: int = 20
    merge_most: int | None = 100
    merge_neighbours_from: int = 20
    merge_hours: int = 24
    noise_length: int = 10
    noise_density: float = 0.15
    noise_similarity: float = 0.85
    max_context: int = 8192
    max_output: int = 3000
    system_reserve: int = 200
    l1_size: int = 25
    archive_days: int = 180
    archive_weight: float = 0.3
    archive_max: int = 10_000
    vector_retries: int = 3


CONFIG = Config()
