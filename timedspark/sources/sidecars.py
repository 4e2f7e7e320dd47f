"""Result files: `key: value` sidecars, logs, quality verdicts and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line formats of result files.
VERDICT = r"(?m)^Overall:.*→\s*(PUBLISH|REVIEW|SKIP)\s*$"
FEEDBACK = r'(?m)^Feedback:.*"\s*$'
LOG_LINE = r"^\[\d+/\d+\] Done \((?:publish|review|skip)\): (.+)$"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, fields (map of trimmed `key: value` lines), verdict or null."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", sidecar_fields(F.col("value")).alias("fields"), verdict(F.col("value")).alias("verdict"))


def sidecar_fields(text: Column) -> Column:
    """Lines split at the first colon; the last line of a repeated key wins."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(lines, lambda line: F.struct(
        F.trim(F.substring_index(line, ":", 1)).alias("key"),
        F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def verdict(text: Column) -> Column:
    """publish, review or skip of a finished scorecard; null when the file is not complete."""
    found = F.lower(F.regexp_extract(text, VERDICT, 1))
    whole = F.endswith(text, F.lit("\n")) & text.rlike(FEEDBACK)
    return F.when(whole & (found != ""), found)


def finished_paths(messages: DataFrame, directory: str, column: str = "message") -> DataFrame:
    """Videos named by log lines, inside the allowed directory."""
    path = F.regexp_extract(column, LOG_LINE, 1)
    inside = path.startswith(directory.rstrip("/") + "/") & ~F.contains(path, F.lit("/../"))
    return messages.filter(path.endswith(".mp4") & inside).select(path.alias("path"))


def complete_results(files: DataFrame) -> DataFrame:
    """Stems with a video, captions and a complete scorecard, from a listing (path, complete).

    One aggregate over the listing instead of three lookups.
    """
    stem = F.regexp_extract("path", r"^(.*?)(\.captions\.json|\.mp4|\.txt)$", 1)
    kind = F.regexp_extract("path", r"^(.*?)(\.captions\.json|\.mp4|\.txt)$", 2)
    has = lambda k: F.bool_or(kind == k)
    return (files.filter(stem != "").groupBy(stem.alias("stem")).agg(
        has(".mp4").alias("v"), has(".captions.json").alias("c"),
        F.bool_or((kind == ".txt") & F.col("complete")).alias("t")).filter("v AND c AND t").select("stem"))


def write_sidecars(clips: DataFrame, path: str) -> None:
    """`key: value` text per clip, partitioned by recording."""
    fixed = lambda c: F.format_string("%.2f", F.col(c) / 1_000)
    lines = [F.concat(F.lit("title: "), "title"), F.concat(F.lit("reason: "), "reason"),
             F.concat(F.lit("source_start: "), fixed("start_ms")), F.concat(F.lit("source_end: "), fixed("end_ms")),
             F.concat(F.lit("hook_score: "), F.format_string("%.2f", "hook_score"))]
    clips.select("media_id", F.concat_ws("\n", *lines).alias("value")).write.mode("append").partitionBy("media_id").text(path)
