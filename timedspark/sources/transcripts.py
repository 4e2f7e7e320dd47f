"""Transcript readers and writers.

Readers take raw JSON or text rows with a path or key, so the same parser
serves files, tables and streams. Schemas are declared, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.functions.text import segment_line
from timedspark.operators.scan import Axis, scan, upcoming, word_number
from timedspark.schema import TRANSCRIPT_JSON, finite, to_ms


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (media_id, raw); media_id is the file name without its suffix."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("media_id"), F.col("value").alias("raw"))


def transcript_segments(documents: DataFrame) -> DataFrame:
    """Segments of nested transcripts, with their words (empty when missing)."""
    parsed = documents.select("media_id", F.from_json("raw", TRANSCRIPT_JSON).alias("t"))
    return (parsed.select("media_id", "t.language", F.posexplode("t.segments").alias("seg", "s"))
            .select("media_id", "language", "seg", to_ms(F.col("s.start")).alias("start_ms"), to_ms(F.col("s.end")).alias("end_ms"),
                    F.col("s.text").alias("text"), F.coalesce("s.words", F.from_json(
                        F.lit("[]"), "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, confidence: DOUBLE>>")).alias("words")))


def segment_words(segments: DataFrame) -> DataFrame:
    """Word rows of segments; confidence 1 when missing. `seq` orders words of one recording."""
    return (segments.select("media_id", "seg", F.posexplode("words").alias("pos", "w"))
            .select("media_id", word_number(F.col("seg"), F.col("pos")).alias("seq"),
                    to_ms(F.col("w.start")).alias("start_ms"), to_ms(F.col("w.end")).alias("end_ms"),
                    F.col("w.text").alias("text"), F.coalesce("w.confidence", F.lit(1.0)).alias("confidence")))


def flat_words(documents: DataFrame) -> DataFrame:
    """Words of flat arrays `[{start, end, text, confidence}]`."""
    kind = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, confidence: DOUBLE>>"
    return (documents.select("media_id", F.posexplode(F.from_json("raw", kind)).alias("pos", "w"))
            .select("media_id", F.col("pos").cast("bigint").alias("seq"), to_ms(F.col("w.start")).alias("start_ms"),
                    to_ms(F.col("w.end")).alias("end_ms"), F.col("w.text").alias("text"),
                    F.coalesce("w.confidence", F.lit(1.0)).alias("confidence")))


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments as JSON lines, one directory per recording; a recording is never one row."""
    segments.write.mode("append").partitionBy("media_id").json(path)


def nested_documents(segments: DataFrame) -> DataFrame:
    """One nested JSON document per recording, for tools that need whole files.

    A recording lasts hours at most; use `write_segments` to keep rows.
    """
    seconds = lambda c: c / 1_000
    word = lambda w: F.struct(seconds(w["start_ms"]).alias("start"), seconds(w["end_ms"]).alias("end"), w["text"].alias("text"),
                              w["confidence"].alias("confidence"))
    item = F.struct("seg", seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"), "text",
                    F.transform("words", word).alias("words"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["start"], s["end"], s["text"], s["words"]))
    return segments.groupBy("media_id", "language").agg(ordered.alias("segments")).select(
        "media_id", F.to_json(F.struct("language", "segments")).alias("raw"))


def timestamped_text(segments: DataFrame, seconds: bool = True) -> DataFrame:
    """`[mm:ss-mm:ss] text` lines; blank segments are skipped."""
    return segments.filter(F.trim("text") != "").select(
        "media_id", "seg", segment_line(F.col("start_ms"), F.col("end_ms"), F.col("text"), seconds).alias("line"))


def timestamped_lines(lines: DataFrame) -> DataFrame:
    """Segments from `[mm:ss.ss] text` lines (media_id, line_no, value); a segment ends where the next begins."""
    pattern = r"^\[(\d+):(\d+(?:\.\d+)?)\]\s*(.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern)).select(
        "media_id", "line_no", (part(1).cast("bigint") * 60_000 + F.round(part(2).cast("double") * 1_000).cast("bigint")).alias("start_ms"),
        F.trim(part(3)).alias("text"))
    return scan(rows, Axis(("media_id",), ("line_no",), 4_096), end_ms=upcoming(F.col("start_ms")))


# Fixed pattern of reactions kept as audio events.
REACTIONS = r"(?i)laugh|applau|clap|cheer|हँस|हंस|हँसी|हंसी|ताल"
RESPONSE = ("words ARRAY<STRUCT<type: STRING, word: STRING, text: STRING, start: DOUBLE, end: DOUBLE, confidence: DOUBLE>>, "
            "text STRING, language STRING")


def speech_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, words, events) of raw speech responses (response_id, raw, duration_ms).

    A response is rejected whole when any item is invalid, words run
    backwards, or it has text but neither words nor events.
    """
    parsed = responses.select("response_id", "duration_ms", F.from_json("raw", RESPONSE).alias("r"))
    limit = F.col("duration_ms")
    item = (parsed.select("response_id", "duration_ms", F.posexplode("r.words").alias("pos", "i"))
            .filter("i.type IS DISTINCT FROM 'spacing'")
            .select("response_id", "duration_ms", "pos", F.coalesce("i.word", "i.text").alias("text"), F.col("i.type").alias("type"),
                    to_ms(F.col("i.start")).alias("s"), to_ms(F.col("i.end")).alias("e"),
                    F.when(finite(F.col("i.confidence")), F.col("i.confidence")).otherwise(F.lit(1.0)).alias("confidence")))
    good = F.coalesce((F.trim("text") != "") & (F.col("s") >= 0) & (F.col("s") <= F.col("e")) & (F.col("e") <= limit + 100), F.lit(False))
    rows = (item.withColumn("good", good).withColumn("start_ms", F.least("s", limit)).withColumn("end_ms", F.least("e", limit))
            .withColumn("event", F.coalesce(F.col("type") == "audio_event", F.lit(False))))
    # Words of one response are a bounded chunk of audio; order needs its own words only.
    ordered = scan(rows.filter("NOT event"), Axis(("response_id",), ("pos",), 4_096), __prev=_latest_end())
    in_order = ordered.groupBy("response_id").agg(
        F.bool_and(F.coalesce(F.col("start_ms") >= F.coalesce("__prev", F.lit(0)) - 20, F.lit(False))).alias("in_order"),
        F.count("*").alias("n_words"))
    items = rows.groupBy("response_id").agg(F.bool_and("good").alias("items_good"))
    verdicts = (parsed.join(items, "response_id", "left").join(in_order, "response_id", "left").select(
        "response_id", (F.col("r.words").isNotNull() & F.coalesce("items_good", F.lit(True)) & F.coalesce("in_order", F.lit(True))
                        & ((F.coalesce("n_words", F.lit(0)) > 0) | (F.size("r.words") > 0)
                           | (F.trim(F.coalesce("r.text", F.lit(""))) == ""))).alias("accepted"),
        F.coalesce(F.nullif("r.language", F.lit("")), F.lit("auto")).alias("language")))
    kept = rows.join(verdicts.filter("accepted"), "response_id", "left_semi")
    words = kept.filter("NOT event").select("response_id", "pos", "start_ms", "end_ms", F.trim("text").alias("text"), "confidence")
    length = F.col("end_ms") - F.col("start_ms")
    events = kept.filter(F.col("event") & (F.col("confidence") >= 0.5) & (length > 0) & (length <= 10_000)
                         & F.col("text").rlike(REACTIONS)).select("response_id", "pos", "start_ms", "end_ms", "text", "confidence")
    return verdicts, words, events


def _latest_end():
    from timedspark.operators.scan import latest
    return latest(F.col("end_ms"))


def trailer_words(words: DataFrame, length: Column) -> DataFrame:
    """Clip-local words that start inside the clip, ends cut to it."""
    return words.filter((F.col("start_ms") >= 0) & (F.col("start_ms") <= length)).withColumn("end_ms", F.least(F.col("end_ms"), length))


def within_source_limit(rows: DataFrame, limit_ms: int) -> DataFrame:
    """Only what starts in the first part of the source; the filter reaches the scan."""
    return rows.filter(F.col("start_ms") < limit_ms)


def extraction_bounds(clips: DataFrame, pad_ms: int = 150) -> DataFrame:
    """Padded source range of each clip, kept inside the recording."""
    return (clips.withColumn("source_start", F.greatest(F.col("clip_start") - pad_ms, F.lit(0)))
            .withColumn("source_end", F.least(F.col("clip_end") + pad_ms, F.col("duration_ms"))))
