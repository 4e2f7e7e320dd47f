"""Reports and set operations on the job store: quotas, uploads, retention, idempotency, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.functions.text import fingerprint

ACTIVE_STATES = ("queued", "running", "completed", "partial")
CHUNK_BYTES = 32_000_000
MAX_UPLOAD_BYTES = 1_000_000_000
UPLOAD_SUFFIXES = ("mp4", "mov", "m4v", "mkv", "webm")
CONTAINERS = ("mov", "mp4", "matroska", "webm")


def first_rows(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row per key by `order`, as a map-side aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
            .select(*keys, "__r.*").select(*rows.columns))


def last_rows(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
            .select(*keys, "__r.*").select(*rows.columns))


def idempotent_submits(requests: DataFrame, keys: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """Every request with its outcome: created, repeated (same payload) or conflict.

    The first request of a key decides; it joins back, so that a key repeated
    very often is not gathered in one window.
    """
    first = first_rows(requests.select(*keys, *payload, *order), keys, *order)
    firsts = first.select(*keys, F.struct(*payload).alias("__payload"), F.struct(*order).alias("__first"))
    outcome = (F.when(F.struct(*order) == F.col("__first"), "created")
               .when(F.struct(*payload).eqNullSafe(F.col("__payload")), "repeated").otherwise("conflict"))
    return requests.join(firsts, keys).withColumn("outcome", outcome).drop("__payload", "__first")


def existing_jobs(jobs: DataFrame, *order: str) -> DataFrame:
    """Newest live job per user and video."""
    return last_rows(jobs.filter(F.col("state").isin(*ACTIVE_STATES)), ["user_id", "video_id"], *order)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key of both tables; changes win a tie."""
    both = current.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return last_rows(both, keys, order, "__side").drop("__side")


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `new` with unseen keys, the first of each."""
    return first_rows(new.join(current.select(*keys), keys, "left_anti"), keys, order)


def access_groups(users: DataFrame, members: DataFrame, groups: DataFrame, default: str) -> DataFrame:
    """Limits of each user: the group it is a member of, else the default group."""
    placed = users.join(members, "user_id", "left").withColumn("group", F.coalesce("group", F.lit(default)))
    return placed.join(groups, "group")


def policy_problems(groups: DataFrame, members: DataFrame, default: str) -> DataFrame:
    """Rows that make an access policy invalid; an empty result means valid."""
    limit = lambda c: F.col(c).isNotNull() & (F.col(c) < 1)
    bad_limits = groups.filter(limit("monthly_videos") | limit("retention_days") | F.col("admin").isNull()
                               | (F.trim("group") == "")).select(F.col("group").alias("subject"), F.lit("bad limits").alias("problem"))
    strangers = members.join(groups, "group", "left_anti").select(F.col("user_id").alias("subject"), F.lit("unknown group").alias("problem"))
    blank = members.filter(F.trim("user_id") == "").select(F.col("user_id").alias("subject"), F.lit("blank user").alias("problem"))
    chosen = groups.filter(F.col("group") == default).agg(F.count("*").alias("n"), F.bool_or("admin").alias("admin"))
    no_default = chosen.filter("n = 0 OR admin").select(F.lit(default).alias("subject"), F.lit("bad default group").alias("problem"))
    return bad_limits.unionByName(strangers).unionByName(blank).unionByName(no_default)


def quota_use(jobs: DataFrame, users: DataFrame, month: str) -> DataFrame:
    """Reserved jobs of each user in one month against the limit; a null limit never fills."""
    first = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
    inside = (F.col("created_at") >= first) & (F.col("created_at") < first + F.make_ym_interval(months=F.lit(1)))
    used = (jobs.filter(inside & F.col("reserved"))
            .groupBy("user_id").agg(F.count("*").alias("used")))
    return users.join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("bigint")).withColumn(
        "full", F.coalesce(F.col("used") >= F.col("monthly_videos"), F.lit(False)))


def state_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per state and in total (state null)."""
    return jobs.rollup("state").agg(F.count("*").alias("n"))


def upload_admission(uploads: DataFrame, max_seconds: int = 10_800) -> DataFrame:
    """Add `refused`, the first reason to refuse an upload, or null."""
    suffix = F.lower(F.regexp_extract("filename", r"\.([^./\\]+)$", 1))
    formats = F.split("format_name", ",")
    reason = (F.when(F.col("filename").rlike(r"[\x00-\x1f]"), "filename")
              .when(~suffix.isin(*UPLOAD_SUFFIXES), "suffix")
              .when(~((F.col("size") > 0) & (F.col("size") < MAX_UPLOAD_BYTES)), "size")
              .when(~F.arrays_overlap(formats, F.array(*[F.lit(c) for c in CONTAINERS])), "container")
              .when(F.size(F.array_except(F.array(F.lit("video"), F.lit("audio")), F.col("stream_kinds"))) > 0, "streams")
              .when(~F.coalesce((F.col("duration") > 0) & (F.col("duration") <= max_seconds), F.lit(False)), "duration"))
    return uploads.withColumn("refused", reason)


def upload_status(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Received bytes and whether all chunk numbers 0..n-1 are there, without listing them.

    n distinct numbers between 0 and n-1 are all of them.
    """
    n = F.ceil(F.col("size") / CHUNK_BYTES)
    got = chunks.groupBy("job_id").agg(
        F.sum("chunk_bytes").alias("received_bytes"), F.count_distinct("chunk_index").alias("chunks"),
        F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"))
    return (uploads.join(got, "job_id", "left").withColumn("total_chunks", n.cast("bigint"))
            .withColumn("complete", F.coalesce((F.col("chunks") == n) & (F.col("lo") == 0) & (F.col("hi") == n - 1), F.lit(False)))
            .withColumn("received_bytes", F.coalesce("received_bytes", F.lit(0)).cast("bigint"))
            .withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("bigint")).drop("lo", "hi"))


def corrupt_chunks(recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """Recorded chunks whose stored bytes are missing or differ in size or digest."""
    found = stored.select("job_id", "chunk_index", F.col("chunk_bytes").alias("__size"), F.col("sha256").alias("__sha"))
    same = (F.col("__size") == F.col("chunk_bytes")) & (F.col("__sha") == F.col("sha256"))
    return (recorded.join(found, ["job_id", "chunk_index"], "left").filter(~F.coalesce(same, F.lit(False)))
            .drop("__size", "__sha"))


def expired_jobs(jobs: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Jobs past the retention of their owner's group, and expired ones still to be purged."""
    owned = jobs.join(users.select("user_id", "retention_days"), "user_id").filter("retention_days IS NOT NULL")
    cutoff = now - F.make_dt_interval(F.col("retention_days"))
    over = F.col("state").isin("completed", "partial", "failed") & (F.col("finished_at") < cutoff)
    return owned.filter(over | ((F.col("state") == "expired") & F.col("purged_at").isNull()))


def kept_reels(reels: DataFrame, expired: DataFrame) -> DataFrame:
    return reels.join(expired.select("job_id"), "job_id", "left_anti")


def with_defaults(old: DataFrame, current: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Union of rows written before and after columns were added."""
    both = current.unionByName(old, allowMissingColumns=True)
    return both.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in both.columns])


def reusable(work: DataFrame, done: DataFrame, inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(to do, reuse): rows are reused when key, input digest and artifact identity agree."""
    marked = work.withColumn("fingerprint", fingerprint(F.struct(*sorted(inputs))))
    on = ["key", "fingerprint", "artifact"]
    return marked.join(done.select(*on), on, "left_anti"), marked.join(done.select(*on), on, "left_semi")


def resumable(saved: DataFrame, excluded: DataFrame, caps: DataFrame, width: int = 600_000) -> DataFrame:
    """Recordings whose saved picks can be taken up again: same context, all valid, no overlaps, within the cap.

    `saved`: (media_id, seq, start_ms, end_ms, context, valid); `caps`:
    (media_id, context, target).
    """
    from timedspark.operators.intervals import flag_overlaps
    from timedspark.operators.scan import Axis, peak, scan
    from timedspark.operators.stage import stage
    hit = flag_overlaps(saved, excluded, width=width, name="__excluded")
    seen = scan(stage(hit), Axis(("media_id",), ("start_ms", "seq"), width), __reach=peak(F.col("end_ms")))
    facts = seen.join(caps.withColumnRenamed("context", "__context"), "media_id").groupBy("media_id").agg(
        F.bool_and((F.col("context") == F.col("__context")) & F.col("valid") & ~F.col("__excluded")
                   & ~F.coalesce(F.col("start_ms") < F.col("__reach"), F.lit(False))).alias("sound"),
        F.count("*").alias("n"), F.max("target").alias("target"))
    return facts.select("media_id", (F.col("sound") & (F.col("n") <= F.col("target"))).alias("resumable"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a sorted listing; offset and limit are the feature."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def ready_tasks(tasks: DataFrame, jobs: DataFrame, kind: str, now: Column, limit: int = 20) -> DataFrame:
    """Oldest tasks that are pending or whose lease ran out."""
    live = jobs.filter(F.col("state").isin("queued", "running")).select("job_id", "created_at")
    ready = tasks.filter((F.col("kind") == kind) & (
        (F.col("task_state") == "pending") | ((F.col("task_state") == "running") & (F.col("lease_until") < now))))
    return ready.join(live, "job_id").orderBy("created_at", "job_id").limit(limit)


def job_cards(jobs: DataFrame, reels: DataFrame, users: DataFrame) -> DataFrame:
    """Jobs with owner and number of finished reels; the reels of a job are counted before the join."""
    ready = reels.groupBy("job_id").agg(F.count("*").alias("ready_count"), F.min_by("title", F.struct("path", "title")).alias("first_title"))
    return (jobs.join(users, "user_id").join(ready, "job_id", "left")
            .withColumn("ready_count", F.coalesce("ready_count", F.lit(0)).cast("bigint")))


def visible_jobs(jobs: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewer, job) pairs for owners; administrators are served from the unfiltered table."""
    return viewers.filter(~F.col("admin")).select(F.col("user_id")).join(jobs, "user_id")


def newest_artifact(files: DataFrame) -> DataFrame:
    """Most recent path per key, the last name on a tie."""
    return files.groupBy("key").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def alive_owners(beats: DataFrame, now: Column, within_seconds: int = 90) -> DataFrame:
    """Latest heartbeat per owner and whether it is recent."""
    return beats.groupBy("owner").agg(F.max("at").alias("at")).withColumn(
        "alive", F.col("at") > now - F.make_dt_interval(secs=F.lit(within_seconds)))
