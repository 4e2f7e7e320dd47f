"""Interval joins, interval algebra and the coverage audit over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.operators import clips as C
from timedspark.operators import coverage as V
from timedspark.operators import intervals as I
from timedspark.operators.scan import Axis, scan, total
from timedspark.operators.selection import clip_cap, section_budget
from timedspark.operators.stage import stage
from timedspark.plans import bind
from timedspark.plans.bind import HALF_DAY
from timedspark.plans.registry import query


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text")


def _clips(spark: SparkSession, sf: str) -> DataFrame:
    return bind.clips(spark, sf)


@query("clip_words")
def clip_words(spark, sf):
    spans = _clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")
    return C.clip_words(_words(spark, sf), spans).select("media_id", "clip", "seq", "start_ms", "end_ms")


@query("clip_excerpts")
def clip_excerpts(spark, sf):
    return C.clip_texts(_words(spark, sf), _clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end"))


@query("refine_context")
def refine_context(spark, sf):
    rows = C.context_words(_words(spark, sf), _clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end"))
    return C.current_indices(rows)


@query("nearest_snap")
def nearest_snap(spark, sf):
    snapped = C.snap_to_segments(_clips(spark, sf), bind.segments(spark, sf))
    return snapped.select("media_id", "clip", "snap_start", "snap_end")


@query("reaction_tail")
def reaction_tail(spark, sf):
    return C.reaction_tails(_clips(spark, sf), bind.words(spark, sf)).select("media_id", "clip", "tail_end")


@query("exclude_overlaps")
def exclude_overlaps(spark, sf):
    kept = I.exclude_overlapping(bind.events(spark, sf, "purchase"), bind.events(spark, sf, "error"), width=HALF_DAY)
    return kept.select("media_id", "seq", "start_ms", "end_ms", "score")


@query("active_word")
def active_word(spark, sf):
    """First word whose closed span holds the clip start."""
    points = _clips(spark, sf).select("media_id", "clip", F.col("clip_start").alias("at"))
    return I.first_containing(points, "at", _words(spark, sf), ("start_ms", "end_ms"), "seq", 60_000, ["clip"])


@query("segment_at")
def segment_at(spark, sf):
    """Turn that is current at each clip start; turns have no holes when only their starts count."""
    points = _clips(spark, sf).select("media_id", "clip", "clip_start")
    tiles = bind.words(spark, sf).groupBy("media_id", "turn").agg(F.min("start_ms").alias("start_ms"))
    return I.containing_contiguous(points, "clip_start", tiles, "start_ms", ["turn"])


@query("finished_skip")
def finished_skip(spark, sf):
    c = _clips(spark, sf)
    shift = (F.col("clip") % 4) * 20
    done = c.filter("clip % 2 = 0").select("media_id", (F.col("clip_start") + shift).alias("clip_start"),
                                           (F.col("clip_end") - shift).alias("clip_end"))
    return C.skip_finished(c, done).select("media_id", "clip")


@query("containing_reuse")
def containing_reuse(spark, sf):
    c = _clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")
    stored = (c.filter("clip % 3 = 0")
              .select("media_id", (F.col("media_id") * 10_000 + F.col("clip")).alias("manifest"),
                      F.greatest(F.col("clip_start") - 20_000, F.lit(0)).alias("held_start"),
                      (F.col("clip_end") + 20_000).alias("held_end")))
    held = stored.withColumnRenamed("manifest", "clip").withColumnRenamed(
        "held_start", "clip_start").withColumnRenamed("held_end", "clip_end")
    words = (C.clip_words(_words(spark, sf), held)
             .select(F.col("clip").alias("manifest"), "seq", "start_ms", "end_ms", "text"))
    rows = C.reuse_containing(c, stored, words, ("media_id",))
    return rows.groupBy("media_id", "clip", "manifest").agg(
        F.count("*").alias("n_words"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


@query("cut_bounds")
def cut_bounds(spark, sf):
    c = _clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")
    return C.cut_bounds(c, _words(spark, sf)).select("media_id", "clip", "cut_start", "cut_end")


@query("interval_union")
def interval_union(spark, sf):
    return I.union_ranges(bind.events(spark, sf), width=HALF_DAY)


@query("overlap_measure")
def overlap_measure(spark, sf):
    return I.measure_within(bind.events(spark, sf, "purchase"), ["seq"], bind.events(spark, sf, "view", "click"),
                            width=HALF_DAY)


@query("midpoint_count")
def midpoint_count(spark, sf):
    c = _clips(spark, sf).select("media_id", "clip", F.col("clip_start").alias("start_ms"), F.col("clip_end").alias("end_ms"))
    w = _words(spark, sf)
    return I.measure_within(c, ["clip"], None, {"n_words": w, "n_short": w.filter("end_ms - start_ms <= 500")})


@query("interval_subtract")
def interval_subtract(spark, sf):
    speech, removed = bind.events(spark, sf, "view", "click"), bind.events(spark, sf, "error")
    return I.subtract(speech, removed, ["seq"], HALF_DAY)


@query("coverage_gaps")
def coverage_gaps(spark, sf):
    padded = _words(spark, sf).select("media_id", F.greatest(F.col("start_ms") - 150, F.lit(0)).alias("start_ms"),
                                      (F.col("end_ms") + 150).alias("end_ms"))
    return I.gaps(padded, bind.durations(spark, sf))


def heard_words(spark, sf):
    """Words with holes and overlong words."""
    overlong = (F.col("turn") * 31 + F.col("pos")) % 97 == 0
    return (bind.words(spark, sf).filter("NOT (turn % 3 = 1 AND pos % 5 < 4)")
            .withColumn("end_ms", F.when(overlong, F.col("start_ms") + 3_000).otherwise(F.col("end_ms")))
            .select("media_id", "seq", "start_ms", "end_ms", "text"))


def audit_tables(spark, sf):
    """Words with holes and overlong words, speech regions, reference words, durations."""
    w, heard = bind.words(spark, sf), heard_words(spark, sf)
    span = w.groupBy("media_id", "turn").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    middle = F.floor((F.col("s") + F.col("e")) / 2).cast("bigint")
    speech = (span.select("media_id", F.explode(F.array(
        F.struct(F.col("s").alias("start_ms"), (middle - 150).alias("end_ms")),
        F.struct((middle + 150).alias("start_ms"), F.col("e").alias("end_ms")))).alias("r"))
        .select("media_id", "r.start_ms", "r.end_ms").filter("start_ms < end_ms"))
    reference = w.filter("pos % 2 = 0").select("media_id", "seq", "start_ms", "end_ms", "text")
    # Two rows per turn, which the audit reads five times.
    return heard, stage(speech), reference, bind.durations(spark, sf)


@query("coverage_findings")
def coverage_findings(spark, sf):
    return V.coverage_findings(*audit_tables(spark, sf))


@query("coverage_audit")
def coverage_audit(spark, sf):
    found = stage(V.coverage_findings(*audit_tables(spark, sf)))
    merged = V.coverage_issues(found).groupBy("media_id").agg(
        F.count("*").alias("n_issues"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("issue_ms"))
    scores = V.coverage_scores(found)
    return merged.join(scores, "media_id").select("media_id", "n_issues", "issue_ms", F.round("score", 5).alias("score"))


@query("valid_words")
def valid_words(spark, sf):
    return V.valid_words(heard_words(spark, sf), bind.durations(spark, sf))


@query("chunk_plan")
def chunk_plan(spark, sf):
    return I.overlapping_chunks(bind.durations(spark, sf), 300_000, 10_000).select(
        "media_id", F.col("idx").cast("bigint").alias("idx"), "start_ms", "end_ms")


@query("section_plan")
def section_plan(spark, sf):
    """Search sections, with the reply budget of each section."""
    sections = I.overlapping_chunks(bind.durations(spark, sf), 200_000, 90_000)
    cap = clip_cap(F.col("duration_ms"))
    budget = section_budget(cap, F.col("end_ms") - F.col("start_ms"), F.col("duration_ms"))
    return sections.select("media_id", F.col("idx").cast("bigint").alias("section"), "start_ms", "end_ms",
                           cap.cast("bigint").alias("cap"), budget.cast("bigint").alias("budget"))


@query("owned_chunks")
def owned_chunks(spark, sf):
    owned = I.owned_ranges(I.overlapping_chunks(bind.durations(spark, sf), 100_000, 10_001))
    return owned.select("media_id", F.col("idx").cast("bigint").alias("idx"), "left_x2", "right_x2")


@query("owned_words")
def owned_words(spark, sf):
    """Each word belongs to the chunk that owns its midpoint."""
    owned = I.owned_ranges(I.overlapping_chunks(bind.durations(spark, sf), 100_000, 10_001))
    mids = _words(spark, sf).withColumn("mid_x2", F.col("start_ms") + F.col("end_ms"))
    return (I.containing_contiguous(mids, "mid_x2", owned, "left_x2", ["idx"], width=1_200_000)
            .groupBy("media_id", F.col("idx").cast("bigint").alias("idx"))
            .agg(F.count("*").alias("n_words"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")))


@query("retry_windows")
def retry_windows(spark, sf):
    issues = stage(V.coverage_issues(V.coverage_findings(*audit_tables(spark, sf))))
    return I.retry_windows(issues, bind.durations(spark, sf), 24_000, 4_000, 8)


@query("unreliable_chunks")
def unreliable_chunks(spark, sf):
    owned = stage(I.owned_ranges(I.overlapping_chunks(bind.durations(spark, sf), 100_000, 10_000)))
    issues = V.coverage_issues(V.coverage_findings(*audit_tables(spark, sf)))
    local = (I.overlap_join(issues, owned.select("media_id", "idx", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce")),
                            60_000, right_span=("cs", "ce"))
             .select("media_id", "idx", (F.greatest("start_ms", "cs") - F.col("cs")).alias("start_ms"),
                     (F.least("end_ms", "ce") - F.col("cs")).alias("end_ms")))
    judged, excluded = V.unreliable_ranges(local, owned, 4_000)
    per_chunk = excluded.groupBy("media_id", "idx").agg(F.count("*").alias("n_excluded"), F.sum(
        F.col("end_ms") - F.col("start_ms")).alias("excluded_ms"))
    return judged.join(per_chunk, ["media_id", "idx"], "left").select(
        "media_id", F.col("idx").cast("bigint").alias("idx"), "issue_ms", "rejected",
        F.coalesce("n_excluded", F.lit(0)).cast("bigint").alias("n_excluded"),
        F.coalesce("excluded_ms", F.lit(0.0)).alias("excluded_ms"))


@query("contiguous_turns")
def contiguous_turns(spark, sf):
    """Do the chunks of each recording tile it without holes? They overlap unless there is only one."""
    durs = bind.durations(spark, sf)
    chunks = I.overlapping_chunks(durs, 300_000, 10_000).withColumn(
        "start_ms", F.when(F.col("media_id") % 2 == 0, F.col("start_ms") + F.least(F.col("idx"), F.lit(1)) * 10_000
                           + F.greatest(F.col("idx") - 1, F.lit(0)) * 0).otherwise(F.col("start_ms")))
    return I.tiles_whole(chunks.select("media_id", "start_ms", "end_ms"), durs, "start_ms", "end_ms", "duration_ms",
                         width=600_000)


@query("even_samples")
def even_samples(spark, sf):
    """At most 40 evenly spread words per recording: indices floor(i * n / 40)."""
    w = _words(spark, sf)
    counts = w.groupBy("media_id").agg(F.count("*").alias("n"))
    numbered = scan(w, Axis(("media_id",), ("seq",), 8_192), rank=total(F.lit(1).cast("bigint"))).join(counts, "media_id")
    # Row r is taken iff some i in 0..39 has floor(i * n / 40) = r.
    i = F.ceil(F.col("rank") * 40 / F.col("n"))
    taken = (F.col("n") <= 40) | ((i < 40) & (F.floor(i * F.col("n") / 40) == F.col("rank")))
    return numbered.filter(taken).select("media_id", "seq", F.col("rank").cast("bigint").alias("rank"))


def splice_tables(spark, sf):
    w = bind.words(spark, sf)
    old = w.filter("pos % 7 <> 3").select("media_id", "seq", "start_ms", "end_ms", "text")
    windows = (w.select("media_id").distinct()
               .select("media_id", F.lit(0).cast("bigint").alias("win"), F.lit(20_000).cast("bigint").alias("start_ms"),
                       F.lit(36_000).cast("bigint").alias("end_ms")))
    heard = w.filter("start_ms >= 12000 AND end_ms <= 44000 AND (media_id % 4 <> 0 OR (start_ms >= 20000 AND end_ms <= 36000))")
    replacement = heard.select("media_id", F.lit(0).cast("bigint").alias("win"), F.col("seq").alias("j"),
                               (F.col("start_ms") + 40).alias("start_ms"), (F.col("end_ms") + 40).alias("end_ms"), "text")
    return old, replacement, windows


@query("anchor_splice")
def anchor_splice(spark, sf):
    rows = C.splice_words(*splice_tables(spark, sf))
    return rows.groupBy("media_id").agg(
        F.count("*").alias("n_words"), F.count("j").alias("n_inserted"), F.min("j").alias("first_j"),
        F.max("j").alias("last_j"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"))


@query("accept_repair")
def accept_repair(spark, sf):
    """Coverage before and after the splice, and whether the retry is taken."""
    old, replacement, windows = splice_tables(spark, sf)
    _, speech, reference, durs = audit_tables(spark, sf)
    new = stage(C.splice_words(old, replacement, windows).withColumn(
        "seq", F.col("start_ms") * 1_000 + F.least(F.col("end_ms") - F.col("start_ms"), F.lit(999))))
    before = V.coverage_scores(V.coverage_findings(old, speech, reference, durs)).select("media_id", F.col("score").alias("old_score"))
    after = V.coverage_scores(V.coverage_findings(new, speech, reference, durs)).select("media_id", F.col("score").alias("new_score"))
    heard = replacement.join(windows.select("media_id", "win", F.greatest(F.col("start_ms") - 4_000, F.lit(0)).alias("lo"),
                                            (F.col("end_ms") + 4_000).alias("hi")), ["media_id", "win"])
    facts = heard.groupBy("media_id").agg(
        F.count("*").alias("n_new"),
        F.bool_and((F.col("start_ms") >= F.col("lo") - V.RETRY_SLACK_MS) & (F.col("end_ms") <= F.col("hi") + V.RETRY_SLACK_MS)).alias("in_window"))
    padded = windows.select("media_id", "win", F.greatest(F.col("start_ms") - 4_000, F.lit(0)).alias("start_ms"),
                            (F.col("end_ms") + 4_000).alias("end_ms"))
    spoken = I.measure_within(padded, ["win"], speech).select("media_id", "overlap_ms")
    # Both the retry and the spliced candidate must be valid as they are; nothing is mended.
    retry = V.valid_words(replacement.withColumnRenamed("j", "seq"), durs).withColumnRenamed("valid", "retry_valid")
    valid = (V.valid_words(new, durs).join(retry, "media_id").select("media_id", (F.col("valid") & F.col("retry_valid")).alias("valid")))
    return (facts.join(spoken, "media_id").join(valid, "media_id").join(before, "media_id", "left").join(after, "media_id", "left")
            .select("media_id", "n_new", F.round(F.coalesce("old_score", F.lit(0.0)), 5).alias("old_score"),
                    F.round(F.coalesce("new_score", F.lit(0.0)), 5).alias("new_score"),
                    V.accept_repair(F.col("n_new"), F.col("overlap_ms"), F.col("in_window"), F.col("valid"),
                                    F.coalesce("old_score", F.lit(0.0)), F.coalesce("new_score", F.lit(0.0))).alias("accepted")))
