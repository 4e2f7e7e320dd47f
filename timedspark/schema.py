"""Table schemas as DDL, usable in readers and `from_json`. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "STRUCT<start_ms: BIGINT, end_ms: BIGINT, text: STRING, confidence: DOUBLE>"

MEDIA = (
    "media_id STRING, path STRING, duration_ms BIGINT, width INT, height INT, fps DOUBLE, "
    "has_audio BOOLEAN, codec STRING")
WORDS = (
    "media_id STRING, pass STRING, seq BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING, confidence DOUBLE")
SEGMENTS = (
    f"media_id STRING, seg INT, start_ms BIGINT, end_ms BIGINT, text STRING, words ARRAY<{WORD}>")
TURNS = "media_id STRING, start_ms BIGINT, end_ms BIGINT, speaker_id STRING"
CLIPS = (
    "media_id STRING, seq BIGINT, start_ms BIGINT, end_ms BIGINT, title STRING, reason STRING, hook_score DOUBLE")
DETECTIONS = (
    "media_id STRING, frame INT, det INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE, cls INT")
TIMELINE = "media_id STRING, start_ms BIGINT, end_ms BIGINT, label STRING, cluster INT"
CHUNKS = "media_id STRING, idx INT, start_ms BIGINT, end_ms BIGINT"
CAPTIONS = (
    f"media_id STRING, line BIGINT, start_ms BIGINT, end_ms BIGINT, words ARRAY<{WORD}>")
PANELS = "media_id STRING, frame INT, left INT, right INT"
SHOTS = (
    "media_id STRING, shot INT, start_frame INT, end_frame INT, mode STRING, confidence DOUBLE, "
    "reason STRING, review_error BOOLEAN")
AUDIO_EVENTS = (
    "media_id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, confidence DOUBLE")
EXCLUDED = "media_id STRING, start_ms BIGINT, end_ms BIGINT"
REPLIES = "task STRING, key STRING, attempt INT, raw STRING"
USAGE = (
    "model STRING, seconds DOUBLE, cost_usd DECIMAL(18,8), usage MAP<STRING,STRING>, "
    "generation_id STRING, elapsed_seconds DOUBLE, received_at TIMESTAMP")

# On-disk transcript in seconds, as written by a transcriber.
TRANSCRIPT_JSON = (
    "language STRING, segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, "
    "words: ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, confidence: DOUBLE>>>>")


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def to_ms(seconds: Column) -> Column:
    """Seconds to milliseconds; null when the value is not finite."""
    return F.when(finite(seconds), F.round(seconds * 1000).cast("bigint"))
