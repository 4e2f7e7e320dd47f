"""Song libraries, saved selections, probe results, receipts and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.functions.text import clock_hundredths
from timedspark.schema import USAGE, finite, to_ms

SECTION = ("STRUCT<id: STRING, start: DOUBLE, end: DOUBLE, lyrics: STRING, vocals: STRING, context: STRING, "
           "description: STRING, disabled: BOOLEAN>")
LIBRARY = ("songs ARRAY<STRUCT<id: STRING, title: STRING, file: STRING, language: STRING, has_vocals: BOOLEAN, method: STRING, "
           f"description: STRING, disabled: BOOLEAN, sections: ARRAY<{SECTION}>>>")


def enabled_sections(manifests: DataFrame) -> DataFrame:
    """(song, section) rows of a library (column raw), without disabled songs and sections; numbered per manifest."""
    enabled = lambda x: ~F.coalesce(x["disabled"], F.lit(False))
    songs = F.filter(F.from_json("raw", LIBRARY)["songs"], enabled)
    pairs = F.flatten(F.transform(songs, lambda s: F.transform(
        F.filter(s["sections"], enabled), lambda c: F.struct(s["id"].alias("song_id"), s["title"].alias("title"), s["file"].alias("file"),
                                                             s["description"].alias("song_description"), c.alias("section")))))
    keys = [c for c in manifests.columns if c != "raw"]
    return (manifests.select(*keys, F.posexplode(F.filter(pairs, lambda p: p.isNotNull())).alias("position", "p"))
            .select(*keys, "position", "p.song_id", "p.title", "p.file", "p.song_description", F.col("p.section.id").alias("section_id"),
                    to_ms(F.col("p.section.start")).alias("start_ms"), to_ms(F.col("p.section.end")).alias("end_ms"),
                    F.coalesce(F.nullif("p.section.vocals", F.lit("")), F.col("p.section.lyrics"), F.lit("")).alias("vocals"),
                    "p.section.context", "p.section.description"))


SELECTION = "source STRING, clips ARRAY<STRUCT<start: VARIANT, end: VARIANT, title: VARIANT, reason: VARIANT, hook_score: VARIANT>>"


def json_number(value: Column) -> Column:
    """A JSON number as a double; null for text, truth values, null and absence."""
    return F.when(F.schema_of_variant(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def json_text(value: Column) -> Column:
    """A JSON string; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def saved_selections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file verdicts, clips of accepted files) from (path, raw, source, duration_ms).

    One bad clip rejects its file: times and the score must be numbers and the
    title text. Only a score that is not there counts as 0.
    """
    plain = lambda c: F.struct(json_number(c["start"]).alias("start"), json_number(c["end"]).alias("end"), json_text(c["title"]).alias("title"),
                               F.try_variant_get(c["reason"], "$", "string").alias("reason"),
                               F.when(c["hook_score"].isNull(), F.lit(0.0)).otherwise(json_number(c["hook_score"])).alias("hook_score"))
    rows = files.withColumn("s", F.from_json("raw", SELECTION))
    rows = rows.withColumn("s", F.struct(F.col("s.source").alias("source"), F.transform("s.clips", plain).alias("clips")))
    fine = lambda c: F.coalesce(finite(c["start"]) & finite(c["end"]) & (c["start"] >= 0) & (c["start"] < c["end"])
                                & (to_ms(c["end"]) <= F.col("duration_ms")) & (F.trim(c["title"]) != "") & finite(c["hook_score"])
                                & c["hook_score"].between(0, 1), F.lit(False))
    verdict = F.coalesce((F.col("s.source") == F.col("source")) & (F.size("s.clips") > 0) & F.forall("s.clips", fine), F.lit(False))
    judged = rows.withColumn("accepted", verdict)
    clips = judged.filter("accepted").select("path", F.posexplode("s.clips").alias("seq", "c")).select(
        "path", "seq", to_ms(F.col("c.start")).alias("start_ms"), to_ms(F.col("c.end")).alias("end_ms"), "c.title",
        F.coalesce("c.reason", F.lit("")).alias("reason"), "c.hook_score")
    return judged.select("path", "accepted"), clips


PROBE = ("streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, duration: STRING, "
         "avg_frame_rate: STRING, r_frame_rate: STRING>>, format STRUCT<duration: STRING, format_name: STRING>")


def frame_rate(text: Column) -> Column:
    """`num/den` or one number; 0 when the denominator is 0 or a part is no number."""
    parts = F.split(text, "/", 2)
    number = lambda i: F.element_at(parts, i).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 1, number(1)).otherwise(F.try_divide(number(1), number(2))), F.lit(0.0))


def probed_media(probes: DataFrame) -> DataFrame:
    """Media facts of probe results (path, raw), with `problem` for unusable ones."""
    p = probes.select("path", F.from_json("raw", PROBE).alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    rows = p.select("path", "p", first("video").alias("v"), first("audio").isNotNull().alias("has_audio"))
    length = F.coalesce(F.nullif("v.duration", F.lit("")), F.nullif("p.format.duration", F.lit("")))
    rate = F.when(F.coalesce(F.col("v.avg_frame_rate"), F.lit("")) != "", F.col("v.avg_frame_rate")).otherwise(F.coalesce("v.r_frame_rate", F.lit("0/0")))
    facts = rows.select("path", "has_audio", "v", to_ms(length.try_cast("double")).alias("duration_ms"),
                        F.coalesce("v.width", F.lit(0)).alias("width"), F.coalesce("v.height", F.lit(0)).alias("height"),
                        frame_rate(rate).alias("fps"), F.coalesce("v.codec_name", F.lit("unknown")).alias("codec"))
    problem = (F.when(F.col("v").isNull(), "no video stream").when(F.col("duration_ms").isNull(), "no duration")
               .when((F.col("width") <= 0) | (F.col("height") <= 0), "bad size").when(F.col("fps") <= 0, "bad frame rate"))
    return facts.withColumn("problem", problem).drop("v")


def append_receipts(receipts: DataFrame, path: str) -> None:
    """One JSON line per receipt, appended."""
    receipts.write.mode("append").json(path)


def read_receipts(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(USAGE).json(path)


def selection_report(clips: DataFrame, texts: DataFrame) -> DataFrame:
    """Clip rows with text, first five and last seven seconds (see `clip_texts`)."""
    return clips.join(texts, ["media_id", "clip"]).select(
        "media_id", "clip", "clip_start", "clip_end", F.col("opening").alias("opening_5_seconds"),
        F.col("ending").alias("ending_7_seconds"), F.col("excerpt").alias("transcript"))


def report_markdown(report: DataFrame) -> DataFrame:
    """The report of one clip as Markdown."""
    return report.select("media_id", "clip", F.concat(
        F.lit("## "), F.col("clip").cast("string"), F.lit("\n\n"), clock_hundredths(F.col("clip_start")), F.lit("–"),
        clock_hundredths(F.col("clip_end")), F.lit("\n\nOpening: "), "opening_5_seconds", F.lit("\n\nEnding: "), "ending_7_seconds",
        F.lit("\n\nTranscript: "), "transcript").alias("markdown"))


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines and Markdown, one directory per recording."""
    report.write.mode("append").partitionBy("media_id").json(path + "/json")
    report_markdown(report).select("media_id", F.col("markdown").alias("value")).write.mode("append").partitionBy("media_id").text(path + "/markdown")


def caption_sidecars(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Caption record per clip: bounds and its ordered words (clips are at most 90 s long)."""
    word = F.struct("seq", "start_ms", "end_ms", "text")
    lists = words.groupBy("media_id", "clip").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return clips.join(lists, ["media_id", "clip"]).select("media_id", "clip", "clip_start", "clip_end", "words")


def write_captions(sidecars: DataFrame, path: str) -> None:
    sidecars.write.mode("append").partitionBy("media_id").json(path)


STORE_TABLES = ("users", "sessions", "challenges", "jobs", "reels", "tasks", "rate_limits", "uploads", "upload_chunks")


def read_store(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A store table exported as Parquet."""
    if table not in STORE_TABLES:
        raise ValueError(f"unknown store table {table}")
    return spark.read.parquet(f"{folder}/{table}")


def read_store_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int,
                    **options: str) -> DataFrame:
    """A store table over JDBC, read in parallel ranges of a numeric column."""
    if table not in STORE_TABLES:
        raise ValueError(f"unknown store table {table}")
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower),
                                              upperBound=str(upper), numPartitions=str(partitions), **options).load())
