"""Job store reports over orders (jobs), lineitem (reels, chunks), customer (users) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from timedspark.functions import text as T
from timedspark.operators import store as D
from timedspark.plans import bind
from timedspark.plans.registry import query

BIG = "bigint"
NOW = "1999-01-01 00:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


def users(spark, sf):
    """Customers with the limits of the group of their market segment; two segments fall to the default."""
    c = bind.table(spark, sf, "customer")
    members = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("group"))
    groups = c.select("c_mktsegment").distinct().unionByName(spark.range(1).select(F.lit("free").alias("c_mktsegment"))).select(
        F.col("c_mktsegment").alias("group"),
        F.when(F.col("c_mktsegment") == "BUILDING", None).when(F.col("c_mktsegment") == "free", 1).otherwise(2).cast("int").alias("monthly_videos"),
        F.when(F.col("c_mktsegment") == "MACHINERY", None).when(F.col("c_mktsegment") == "free", 30).otherwise(400).cast("int").alias("retention_days"),
        (F.col("c_mktsegment") == "AUTOMOBILE").alias("admin"))
    people = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return D.access_groups(people, members, groups, "free")


def jobs(spark, sf):
    o = bind.table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "queued").when(
        F.col("o_orderkey") % 3 == 0, "expired").otherwise("failed")
    done = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 4).alias("video_id"),
                    state.alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
                    F.when(state != "queued", done).alias("finished_at"),
                    F.when(F.col("o_orderkey") % 6 == 0, done).alias("purged_at"), (F.col("o_orderstatus") != "P").alias("reserved"))


def reels(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                     F.concat(F.lit("reel-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("path"),
                     F.col("l_returnflag").alias("title"))


@query("access_limits")
def access_limits(spark, sf):
    return users(spark, sf).select("user_id", "group", "monthly_videos", "retention_days", "admin")


@query("quota_use")
def quota_use(spark, sf):
    return D.quota_use(jobs(spark, sf), users(spark, sf), "1997-05").select("user_id", "used", "full")


@query("job_states")
def job_states(spark, sf):
    return D.state_counts(jobs(spark, sf))


@query("retention")
def retention(spark, sf):
    return D.expired_jobs(jobs(spark, sf), users(spark, sf), now()).select("job_id", "user_id", "state", "retention_days")


@query("kept_reels")
def kept_reels(spark, sf):
    kept = D.kept_reels(reels(spark, sf), D.expired_jobs(jobs(spark, sf), users(spark, sf), now()))
    return kept.groupBy("job_id").agg(F.count("*").alias("reels"))


@query("idempotent_submits")
def idempotent_submits(spark, sf):
    e = bind.table(spark, sf, "events")
    r = e.select("event_id", "user_id", (F.col("event_id") % 25).alias("request_key"), F.col("event_type").alias("video_id"))
    return D.idempotent_submits(r, ["user_id", "request_key"], ["video_id"], ["event_id"]).select("event_id", "user_id", "request_key", "outcome")


@query("existing_jobs")
def existing_jobs(spark, sf):
    return D.existing_jobs(jobs(spark, sf), "created_at", "job_id").select("user_id", "video_id", "job_id")


@query("upsert_users")
def upsert_users(spark, sf):
    c = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(0).cast(BIG).alias("at"))
    e = bind.table(spark, sf, "events").select((F.col("user_id") * 3).alias("user_id"), F.col("event_type").alias("name"), F.col("event_id").alias("at"))
    return D.upsert(c, e, ["user_id"], "at")


@query("merge_users")
def merge_users(spark, sf):
    """Events of three thirds of the time merged one after the other into a stored table of customers."""
    from timedspark.operators import merge as G
    from timedspark.streaming.run import new_folder
    c = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(0).cast(BIG).alias("at"))
    e = bind.table(spark, sf, "events")
    third = F.floor(F.col("event_id") * 3 / (e.agg(F.max("event_id").alias("n")).first()["n"] + 1))
    changes = e.select((F.col("user_id") * 3).alias("user_id"), F.col("event_type").alias("name"), F.col("event_id").alias("at"), third.alias("third"))
    path = new_folder(spark, "users")
    for batch, rows in enumerate([c, *[changes.filter(F.col("third") == k).drop("third") for k in range(3)]]):
        G.merge_stored(path, rows, ["user_id"], "at", 32, batch)
    return G.read_stored(spark, path, c.schema).drop(G.BUCKET)


@query("insert_ignore")
def insert_ignore(spark, sf):
    held = reels(spark, sf).filter("line <= 2").select("job_id").distinct()
    new = reels(spark, sf).filter("line > 2").withColumn("at", F.col("line") * 1_000_000 + F.col("part"))
    return D.insert_ignore(held, new, ["job_id"], "at").select("job_id", F.col("at").cast(BIG).alias("at"))


@query("upload_status")
def upload_status(spark, sf):
    o = bind.table(spark, sf, "orders")
    uploads = o.select(F.col("o_orderkey").alias("job_id"), (F.round(F.col("o_totalprice")).cast(BIG) * 400 + 1).alias("size"))
    chunks = bind.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).cast(BIG).alias("chunk_index"),
        F.round(F.col("l_extendedprice")).cast(BIG).alias("chunk_bytes"))
    return D.upload_status(uploads, chunks)


@query("corrupt_chunks")
def corrupt_chunks(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    base = li.groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk_index")).agg(
        F.max("l_partkey").alias("part"), F.min(F.col("l_quantity").cast(BIG)).alias("chunk_bytes"))
    sha = lambda c: T.token_digest(c.cast("string"))
    recorded = base.select("job_id", "chunk_index", "chunk_bytes", sha(F.col("part")).alias("sha256"))
    stored = base.filter("part % 11 <> 0").select(
        "job_id", "chunk_index", (F.col("chunk_bytes") + F.when(F.col("part") % 13 == 0, 1).otherwise(0)).alias("chunk_bytes"),
        sha(F.col("part") + F.when(F.col("part") % 17 == 0, 1).otherwise(0)).alias("sha256"))
    return D.corrupt_chunks(recorded, stored)


@query("upload_admission")
def upload_admission(spark, sf):
    p = bind.table(spark, sf, "pages")
    k = F.col("page_id")
    up = p.select(k.alias("page_id"), F.concat(F.lit("clip"), k.cast("string"), F.when(k % 7 == 1, ".avi").when(k % 7 == 2, "\t.mp4").otherwise(".MKV")).alias("filename"),
                  F.when(k % 11 == 3, 2_000_000_000).otherwise(k * 1_000 + 1).cast(BIG).alias("size"),
                  F.when(k % 13 == 4, "avi").otherwise("matroska,webm").alias("format_name"),
                  F.when(k % 5 == 0, F.array(F.lit("video"))).otherwise(F.array(F.lit("audio"), F.lit("video"))).alias("stream_kinds"),
                  (k * 150).cast("double").alias("duration"))
    return D.upload_admission(up).select("page_id", "refused")


@query("added_columns")
def added_columns(spark, sf):
    """Jobs written before and after a column was added."""
    j = jobs(spark, sf).select("job_id", "user_id")
    old, new = j.filter("job_id % 2 = 0"), j.filter("job_id % 2 = 1").withColumn(
        "source_type", F.when(F.col("job_id") % 3 == 0, "upload"))
    return D.with_defaults(old, new, {"source_type": F.lit("link")})


def reuse_tables(spark, sf):
    li = bind.table(spark, sf, "orders")
    work = li.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("settings"), F.col("o_custkey").alias("words"),
                     (F.col("o_orderkey") % 5).alias("artifact"))
    past = work.filter("key % 3 <> 1").withColumn("words", F.when(F.col("key") % 7 == 0, F.col("words") + 1).otherwise(F.col("words"))
                                                  ).withColumn("artifact", F.when(F.col("key") % 11 == 0, F.lit(9).cast(BIG)).otherwise(F.col("artifact")))
    done = past.withColumn("fingerprint", T.fingerprint(F.struct("settings", "words"))).select("key", "fingerprint", "artifact")
    return D.reusable(work, done, ["words", "settings"])


@query("fingerprint_todo")
def fingerprint_todo(spark, sf):
    return reuse_tables(spark, sf)[0].select("key")


@query("fingerprint_reuse")
def fingerprint_reuse(spark, sf):
    return reuse_tables(spark, sf)[1].select("key", "fingerprint")


@query("resume_selection")
def resume_selection(spark, sf):
    b = bind.events(spark, sf, "purchase")
    saved = b.select("media_id", "seq", "start_ms", (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 4)).alias("end_ms"),
                                           (F.col("media_id") % 7).alias("context"), (F.col("seq") % 61 != 0).alias("valid"))
    excluded = bind.events(spark, sf, "signup")
    caps = b.select("media_id").distinct().select("media_id", F.when(F.col("media_id") % 9 == 0, 99).otherwise(F.col("media_id") % 7).alias("context"),
                                                  F.lit(12).alias("target"))
    return D.resumable(saved, excluded, caps, bind.HALF_DAY)


@query("newest_jobs_page")
def newest_jobs_page(spark, sf):
    return D.page(jobs(spark, sf), [F.col("created_at").desc(), F.col("job_id")], 50, 50).select("job_id", "created_at")


@query("ready_tasks")
def ready_tasks(spark, sf):
    j = jobs(spark, sf)
    o = bind.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    tasks = o.select(k.alias("job_id"), F.when(k % 2 == 0, "prepare").otherwise("render").alias("kind"),
                     F.when(k % 3 == 0, "pending").when(k % 3 == 1, "running").otherwise("done").alias("task_state"),
                     (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(200))).alias("lease_until"))
    return D.ready_tasks(tasks, j, "prepare", now()).select("job_id", "created_at")


@query("job_cards")
def job_cards(spark, sf):
    people = users(spark, sf).select("user_id", "name")
    return D.job_cards(jobs(spark, sf), reels(spark, sf), people).select("job_id", "name", "ready_count", "first_title")


@query("visible_jobs")
def visible_jobs(spark, sf):
    return D.visible_jobs(jobs(spark, sf), users(spark, sf)).select("user_id", "job_id")


@query("newest_artifact")
def newest_artifact(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    return D.newest_artifact(li.select(F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("modified"),
                                       F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path")))


@query("alive_owners")
def alive_owners(spark, sf):
    e = bind.table(spark, sf, "events")
    limit = F.to_timestamp_ntz(F.lit("2024-01-29 12:00:00"))
    beats = e.select(F.col("user_id").alias("owner"), F.col("ts").cast("timestamp_ntz").alias("at")).filter(F.col("at") <= limit)
    return D.alive_owners(beats, limit, 3_600).select("owner", "alive")


@query("distinct_results")
def distinct_results(spark, sf):
    """Union of two lists of finished results without repeats."""
    r = reels(spark, sf).select("job_id", "path")
    return r.filter("job_id % 2 = 0").union(r.filter("job_id % 3 = 0")).dropDuplicates()


@query("file_trio_results")
def file_trio_results(spark, sf):
    """Results whose video, captions and complete scorecard all exist in a file listing."""
    from timedspark.sources.sidecars import complete_results
    li = bind.table(spark, sf, "lineitem")
    stem = F.concat(F.lit("reels/"), F.col("l_orderkey").cast("string"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".mp4", ".captions.json", ".txt", ".jpg")]), (F.col("l_linenumber") - 1) % 4 + 1)
    files = li.select(F.concat(stem, suffix).alias("path"), (F.col("l_orderkey") % 5 != 0).alias("complete"))
    return complete_results(files)
