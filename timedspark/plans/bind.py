"""Views that turn the driver tables into interval tables.

Every rule is integer arithmetic on the driver columns, so the same rule can
be written in another SQL engine for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.operators.scan import WORDS, scan, total, word_number
from timedspark.operators.stage import stage

TURN_GAP = 900
HALF_DAY = 43_200_000
# Words of a turn whose times are added up inside one row.
PIECE = 128


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a wall-clock timestamp, whatever the session zone."""
    return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")),
                            ts.cast("timestamp_ntz")).cast("bigint")


def turns_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    tokens = F.filter(F.split("text", r"[ \t\r\n]+"), lambda t: t != "")
    return c.select(F.col("conv_id").alias("media_id"), "turn", "role", tokens.alias("tokens"))


# Bound tables of words and durations of the running query; every query starts with none.
SHARED: dict[tuple, DataFrame] = {}


def words(spark: SparkSession, sf: str) -> DataFrame:
    """media_id, turn, pos, seq, role, start_ms, end_ms, text; written once per query."""
    if (spark, sf) not in SHARED:
        SHARED[spark, sf] = stage(_timed_words(spark, sf))
    return SHARED[spark, sf]


def _timed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Times are added up inside pieces of a turn and over the pieces of a recording; only then does each word become a row."""
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(tokens) - 1) div {PIECE})")), lambda k: F.slice("tokens", k * PIECE + 1, PIECE))
    pieces = (turns_tokens(spark, sf).filter(F.size("tokens") > 0)
              .select("media_id", "turn", "role", F.posexplode(cut).alias("piece", "tokens"))
              .withColumn("first", F.col("piece") * PIECE).withColumn("seq", word_number(F.col("turn"), F.col("first"))))

    def item(text: Column, at: Column) -> Column:
        pos = F.col("first") + at
        gap = F.when(pos == 0, F.lit(TURN_GAP)).otherwise(40 + 170 * (pos % 7))
        return F.struct(text.alias("text"), (F.char_length(text) * 80 + 60).cast("bigint").alias("len_ms"), gap.cast("bigint").alias("gap_ms"))

    def add(sums: Column, word: Column) -> Column:
        reached = F.element_at(sums, -1) + word["gap_ms"] + word["len_ms"]
        return F.concat(sums, F.array(reached))

    start = F.array(F.lit(0).cast("bigint"))
    timed = stage(pieces.withColumn("words", F.transform("tokens", item)).withColumn("sums", F.aggregate("words", start, add)).drop("tokens"))
    placed = scan(timed, WORDS, before=total(F.element_at("sums", -1)))
    word, pos = F.col("word"), F.col("first") + F.col("at")
    return (placed.select("media_id", "turn", "role", "first", "before", "sums", F.posexplode("words").alias("at", "word"))
            .select("media_id", "turn", pos.cast("bigint").alias("pos"), word_number(F.col("turn"), pos).alias("seq"), "role",
                    (F.col("before") + F.get("sums", F.col("at")) + word["gap_ms"]).alias("start_ms"),
                    (F.col("before") + F.get("sums", F.col("at") + 1)).alias("end_ms"), word["text"].alias("text")))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """One row per turn."""
    return (words(spark, sf).groupBy("media_id", "turn")
            .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                          lambda x: x["text"]), " ").alias("text"),
                 F.count("*").alias("n_words")))


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per recording; written once per query, so that its many readers do not read all words."""
    if (spark, sf, "durations") not in SHARED:
        SHARED[spark, sf, "durations"] = stage(words(spark, sf).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms")))
    return SHARED[spark, sf, "durations"]


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """media_id, clip, clip_start, clip_end, score, duration_ms."""
    m, k = F.col("media_id"), F.col("k")
    start = 12_000 * k + (m * 137 + k * 911) % 5_000
    return (durations(spark, sf)
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("duration_ms") / 12_000))))
            .select(m, k.alias("clip"), start.alias("clip_start"),
                    (start + 15_000 + 1_000 * ((m * 31 + k * 17) % 40)).alias("clip_end"),
                    ((m * 7_919 + k * 104_729) % 1_000).alias("score"), "duration_ms")
            .filter("clip_end <= duration_ms"))


def events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Event intervals: media_id = user, seq = event."""
    e = table(spark, sf, "events")
    if kinds:
        e = e.filter(F.col("event_type").isin(*kinds))
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"),
                    F.col("event_type").alias("kind"), epoch_ms(F.col("ts")).alias("start_ms"),
                    (epoch_ms(F.col("ts")) + F.round(F.col("value") * 300_000).cast("bigint")).alias("end_ms"),
                    F.round(F.col("value") * 100).cast("bigint").alias("score"))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes: media_id = supplier, frame, x, y, w, h."""
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    return li.select(F.col("l_suppkey").alias("media_id"), (F.col("l_orderkey") % 300).alias("frame"),
                     (F.col("l_partkey") % 1_600).alias("x"),
                     (F.col("l_linenumber") * 40).cast("bigint").alias("y"),
                     (100 + q * 4).alias("w"), (150 + q * 12).alias("h"),
                     (F.col("l_discount") * 10).alias("confidence"),
                     F.col("l_orderkey").alias("det"))


def media_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame of every recording, with or without a box.

    Spark takes an exploded table to be about as small as what it came from and would broadcast all frames through the
    driver; the hint has joins shuffle them. They are dealt out by the keys of most joins before panels multiply them.
    """
    media = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("media_id"))
    frames = media.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(299).cast("bigint"))))
    return frames.repartition("media_id", "frame").hint("merge")


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Frame signatures: 250 consecutive vectors make one recording."""
    e = table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 250).cast("bigint").alias("media_id"),
                    (F.col("vec_id") % 250).alias("frame"), F.col("embedding").alias("signature"))
