"""Windowed streams: rate limits, inactivity and speech density; batch results that add up.

Rows later than the watermark are dropped; the result of a window is kept up
to date until the watermark passes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.operators.scan import TIMES, islands, peak
from timedspark.operators.stage import stage

CHUNK_KNOWN = "outcome IN ('stored', 'complete')"
OPEN_SESSION = "media_id BIGINT, start_ms BIGINT, end_ms BIGINT, n_words BIGINT"


def rate_limits(requests: DataFrame, limit: int, keep: str = "60 minutes") -> DataFrame:
    """Requests per key and minute, flagged when over the limit."""
    return (requests.withWatermark("ts", keep).groupBy("key", F.window("ts", "1 minute").alias("w"))
            .agg(F.count("*").alias("used"))
            .select("key", F.col("w.start").alias("minute"), "used", (F.col("used") > limit).alias("over")))


def inactivity_sessions(touches: DataFrame, ttl: str = "24 hours", keep: str = "24 hours") -> DataFrame:
    """Activity sessions per job; a session ends, and its allowance returns, `ttl` after the last touch."""
    return (touches.withWatermark("ts", keep).groupBy("job_id", F.session_window("ts", ttl).alias("w"))
            .agg(F.count("*").alias("touches"))
            .select("job_id", F.col("w.start").alias("opened"), F.col("w.end").alias("expires"), "touches"))


def speech_density(words: DataFrame, keep: str = "1 day") -> DataFrame:
    """Words per 6-second window every 3 seconds of media time, in parts: one per window of `keep` in which words arrived.

    `words`: (media_id, start_ms, arrived). Media time starts at 0 in every
    recording, so the watermark is on the arrival time: a recording that comes
    after another is finished is not late. Parts of one window add up.
    """
    first = F.floor(F.col("start_ms") / 3_000)
    starts = F.explode(F.array(first, first - 1)).alias("k")
    return (words.withWatermark("arrived", "10 minutes").select("media_id", "arrived", starts)
            .groupBy("media_id", "k", F.window("arrived", keep).alias("w")).agg(F.count("*").alias("n_words"))
            .select("media_id", (F.col("k") * 3_000).alias("start_ms"), F.col("w.start").alias("arrived"), "n_words"))


def last_beats(beats: DataFrame) -> DataFrame:
    """Latest heartbeat per owner, of a batch or of the batches' results; compare it with the clock of the report."""
    return beats.groupBy("owner").agg(F.max("at").alias("at"))


def alive(beats: DataFrame, now: Column, limit: Column) -> DataFrame:
    """Owners whose last beat is younger than `limit` at `now`; nothing has to arrive for an owner to fall silent."""
    return beats.select("owner", (F.col("at") > now - limit).alias("alive"))


def job_progress(events: DataFrame) -> DataFrame:
    """Furthest stage per job (it never goes back) and its latest counts, of a batch or of the batches' results.

    `events`: (job_id, place, selected, with); `with` orders the events of a job that give `selected` and is null for others.
    """
    return events.groupBy("job_id").agg(F.max("place").alias("place"), F.max_by("selected", "with").alias("selected"), F.max("with").alias("with"))


def word_sessions(batch: DataFrame, carried: DataFrame, gap_ms: int = 700) -> tuple[DataFrame, DataFrame]:
    """Sessions of words split by pauses of media time longer than `gap_ms`: (those that ended, those still open).

    `batch`: (media_id, start_ms, end_ms, ended), words of a recording in order over the batches; a row with `ended`
    closes the recording. `carried`: at most one open session a recording, which counts as one long word. The scan
    cuts a recording into blocks of media time, so its words never meet in one task.
    """
    columns = ["media_id", "start_ms", "end_ms", "n_words"]
    words = batch.filter("NOT ended").withColumn("n_words", F.lit(1).cast("bigint")).select(columns).unionByName(carried.select(columns))
    marked = islands(words, TIMES, {"__end": peak(F.col("end_ms"))}, F.col("start_ms") - F.col("__end") > gap_ms, name="session")
    sessions = marked.groupBy("media_id", "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_words").alias("n_words"))
    newest = marked.groupBy("media_id").agg(F.max("session").alias("newest"))
    ended = batch.filter("ended").select("media_id").distinct().withColumn("over", F.lit(True))
    found = stage(sessions.join(newest, "media_id").join(ended, "media_id", "left").withColumn("open", F.col("over").isNull() & (F.col("session") == F.col("newest"))))
    return found.filter("NOT open").select(columns), found.filter("open").select(columns)


def chunk_outcomes(batch: DataFrame, found: DataFrame | None) -> DataFrame:
    """What `keyed.chunk_intake` says of upload chunks, for many uploads at once: (job_id, chunk_index, sha256, outcome, came_ms).

    `batch`: (job_id, chunk_index, sha256, total, arrival, came_ms); `found`: the stored and complete rows of earlier
    batches that are still known (`CHUNK_KNOWN`). One shuffle by upload and sorted windows, so no upload is held in memory.
    """
    columns = ["job_id", "chunk_index", "sha256", "total", "arrival", "came_ms"]
    rows = batch.select(*columns, F.lit(True).alias("fresh"))
    if found is not None:
        rows = rows.unionByName(found.select("job_id", "chunk_index", "sha256", "came_ms", F.lit(False).alias("fresh")), allowMissingColumns=True)
    order = [F.col("fresh"), F.col("arrival"), F.col("chunk_index")]
    chunk = Window.partitionBy("job_id", "chunk_index").orderBy(*order)
    upload = Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.repartition("job_id").withColumn("n", F.row_number().over(chunk)).withColumn("held", F.first("sha256").over(chunk))
    counted = placed.withColumn("have", F.count_if(F.col("n") == 1).over(upload)).filter("fresh")
    outcome = (F.when((F.col("n") > 1) & F.col("sha256").eqNullSafe(F.col("held")), "repeat").when(F.col("n") > 1, "conflict")
               .when(F.col("have") == F.col("total"), "complete").otherwise("stored"))
    return counted.select("job_id", "chunk_index", "sha256", outcome.alias("outcome"), "came_ms")
