"""Sessions, captions, frame runs and selection over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timedspark.operators import intervals as I
from timedspark.operators import selection as K
from timedspark.operators import sequence as S
from timedspark.operators.scan import FRAMES, WORDS, Axis
from timedspark.operators.stage import stage
from timedspark.plans import bind
from timedspark.plans.bind import HALF_DAY
from timedspark.plans.registry import query

BIG = "bigint"


def _words(spark, sf):
    return bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text")


@query("word_sessions")
def word_sessions(spark, sf):
    return S.grouped_spans(S.speech_sessions(_words(spark, sf)), "session")


@query("popups")
def popups(spark, sf):
    return S.grouped_spans(S.popups(_words(spark, sf), 3, 1_000), "popup")


@query("single_popups")
def single_popups(spark, sf):
    return S.popups(_words(spark, sf)).select("media_id", "seq", "popup")


@query("caption_lines")
def caption_lines(spark, sf):
    return S.grouped_spans(S.caption_lines(_words(spark, sf)), "line")


def frame_counts(spark, sf):
    """Every frame with its number of boxes."""
    n = bind.detections(spark, sf).groupBy("media_id", "frame").agg(F.count("*").alias("n"))
    return bind.media_frames(spark, sf).join(n, ["media_id", "frame"], "left").select(
        "media_id", "frame", F.coalesce("n", F.lit(0)).alias("n"))


def frame_flags(spark, sf):
    return frame_counts(spark, sf).withColumn("flag", F.col("n") >= 2).drop("n")


def frame_labels(spark, sf):
    return frame_counts(spark, sf).withColumn("label", F.when(F.col("n") > 0, (F.col("n") % 3).cast("int"))).drop("n")


@query("majority_smooth")
def majority_smooth(spark, sf):
    return S.majority_smooth(frame_flags(spark, sf), "flag")


@query("debounce")
def debounce(spark, sf):
    return S.debounce(stage(frame_flags(spark, sf)), "flag", 4)


@query("fill_nearest")
def fill_nearest(spark, sf):
    return S.fill_nearest(frame_labels(spark, sf), "label").select("media_id", "frame", "filled")


def label_runs(spark, sf):
    filled = stage(S.fill_nearest(frame_labels(spark, sf), "label").select("media_id", "frame", "filled"))
    return S.run_lengths(filled, "filled")


@query("label_runs")
def label_runs_query(spark, sf):
    return label_runs(spark, sf)


@query("min_dwell")
def min_dwell(spark, sf):
    spans = stage(label_runs(spark, sf).select("media_id", "filled", (F.col("start") * 40).alias("start_ms"),
                                               (F.col("end") * 40).alias("end_ms")))
    return S.min_dwell(spans, 120, "filled", Axis(("media_id",), ("start_ms",), 600_000))


def _labelled_words(spark, sf):
    w = bind.words(spark, sf)
    return w.select("media_id", "seq", "start_ms", "end_ms", (F.floor(F.col("pos") / 6) % 2).cast(BIG).alias("label"))


@query("collapse_turns")
def collapse_turns(spark, sf):
    return S.collapse_labels(_labelled_words(spark, sf), "label", WORDS, 150, inclusive=False)


@query("collapse_windows")
def collapse_windows(spark, sf):
    return S.collapse_labels(_labelled_words(spark, sf), "label", WORDS, 500, inclusive=True)


@query("rolling_variance")
def rolling_variance(spark, sf):
    d = bind.detections(spark, sf)
    samples = (d.withColumn("track", (F.col("y") / 40 % 3).cast("int"))
               .groupBy("media_id", "frame", "track").agg(F.max("x").alias("x")))
    rated = S.rolling_variance(samples, bind.media_frames(spark, sf), "x", 7, 7)
    return rated.select("media_id", "frame", "winner", F.round("variance", 4).alias("variance"))


@query("concat_offsets")
def concat_offsets(spark, sf):
    """Turns as picks in order, each on its own clock, laid out with 600 ms between them."""
    w = bind.words(spark, sf)
    span = w.groupBy("media_id", F.col("turn").alias("pick")).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    picks = span.select("media_id", "pick", F.floor((F.col("e") - F.col("s")) * 9 / 10).cast(BIG).alias("length_ms"))
    local = w.join(span.select("media_id", F.col("pick").alias("turn"), "s"), ["media_id", "turn"]).select(
        "media_id", F.col("turn").alias("pick"), "seq", (F.col("start_ms") - F.col("s")).alias("start_ms"),
        (F.col("end_ms") - F.col("s")).alias("end_ms"))
    return S.concat_offsets(picks, local)


@query("split_spans")
def split_spans(spark, sf):
    """Each turn's span shared by its tokens in proportion to their length."""
    tokens = bind.turns_tokens(spark, sf).select("media_id", "turn", F.posexplode("tokens").alias("pos", "text"))
    start = (F.col("turn") * 100_000).cast(BIG)
    parts = S.split_spans(tokens.withColumn("from_ms", start).withColumn("to_ms", start + 7_001), ("media_id", "turn"), "pos")
    return parts.select("media_id", "turn", "text", "start_ms", "end_ms")


def frame_energy(spark, sf):
    e = bind.detections(spark, sf).groupBy("media_id", "frame").agg(F.sum("h").cast("double").alias("level"))
    return bind.media_frames(spark, sf).join(e, ["media_id", "frame"], "left").select(
        "media_id", "frame", F.coalesce("level", F.lit(0.0)).alias("level"))


@query("normalised_levels")
def normalised_levels(spark, sf):
    n = S.normalised(stage(frame_energy(spark, sf)), "level", 1)
    smooth = S.moving_average(stage(n), "level", 5)
    return smooth.select("media_id", "frame", F.round("level", 6).alias("level"))


@query("miss_counter")
def miss_counter(spark, sf):
    return S.misses(frame_counts(spark, sf).withColumn("hit", F.col("n") > 0), "hit").select("media_id", "frame", "misses")


def _overlapping_pieces(spark, sf):
    """Segments of overlapping chunks: clips stand for re-read segments."""
    return bind.clips(spark, sf).select("media_id", F.col("clip").alias("seq"), F.col("clip_start").alias("start_ms"),
                                        F.col("clip_end").alias("end_ms"))


@query("merge_chunks")
def merge_chunks(spark, sf):
    rows = S.merge_chunk_segments(_overlapping_pieces(spark, sf), axis=Axis(("media_id",), ("seq",), 256))
    return rows.select("media_id", "seq", "start_ms", "end_ms", "words_from")


@query("boundary_words")
def boundary_words(spark, sf):
    """Words heard twice around chunk edges every 20 s."""
    w = _words(spark, sf)
    edge = F.floor((F.col("start_ms") + F.col("end_ms")) / 40_000) * 40_000
    near = (F.col("start_ms") + F.col("end_ms") - edge) < 6_000
    first = w.select("media_id", (F.col("seq") * 2).alias("seq"), "start_ms",
                     (F.col("end_ms") + F.when(F.col("seq") % 3 == 0, 400).otherwise(0)).alias("end_ms"), "text",
                     edge.cast(BIG).alias("left_x2"))
    again = w.filter(near).select("media_id", (F.col("seq") * 2 + 1).alias("seq"), (F.col("start_ms") + 60).alias("start_ms"),
                                  (F.col("end_ms") + 60).alias("end_ms"), "text", (F.col("start_ms") * 2 + 200).alias("left_x2"))
    rows = S.dedupe_boundary_words(first.unionByName(again), WORDS.__class__(("media_id",), ("seq",), 2_000_000))
    return rows.select("media_id", "seq", "start_ms", "end_ms")


def candidates(spark, sf):
    return bind.events(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "score")


@query("score_order")
def score_order(spark, sf):
    from pyspark.sql import Window
    best = Window.partitionBy("media_id").orderBy(F.col("score").desc(), "seq")
    return candidates(spark, sf).select("media_id", "seq", "score", F.row_number().over(best).alias("place"))


@query("greedy_clips")
def greedy_clips(spark, sf):
    return K.greedy_by_score(candidates(spark, sf), 5, width=HALF_DAY).select(
        "media_id", "seq", "start_ms", "end_ms", "score", "pick")


@query("greedy_by_start")
def greedy_by_start(spark, sf):
    return K.greedy_by_start(candidates(spark, sf), width=HALF_DAY).select("media_id", "seq", "start_ms", "end_ms")


@query("clip_caps")
def clip_caps(spark, sf):
    d = bind.durations(spark, sf)
    override = F.when(F.col("media_id") % 5 == 0, F.col("media_id") % 40 + 1)
    return d.select("media_id", K.clip_cap(F.col("duration_ms"), override, interval_ms=60_000).alias("cap"))


def section_candidates(spark, sf):
    """Candidates of each search section, without those over excluded ranges."""
    sections = I.overlapping_chunks(bind.durations(spark, sf), 200_000, 90_000).select(
        "media_id", F.col("idx").alias("section"), F.col("start_ms").alias("section_start"), F.col("end_ms").alias("section_end"))
    clips = bind.clips(spark, sf)
    inside = (I.overlap_join(clips, sections, 120_000, left_span=("clip_start", "clip_end"),
                             right_span=("section_start", "section_end"))
              .filter("clip_start >= section_start AND clip_end <= section_end"))
    excluded = (bind.durations(spark, sf).filter("media_id % 3 = 0")
                .withColumn("start_ms", F.explode(F.sequence(F.lit(30_000).cast(BIG), F.col("duration_ms") + 30_000,
                                                             F.lit(100_000).cast(BIG))))
                .select("media_id", "start_ms", (F.col("start_ms") + 4_000).alias("end_ms")))
    rows = inside.select("media_id", F.col("section").cast(BIG).alias("section"), "section_end", "duration_ms",
                         K.clip_cap(F.col("duration_ms"), interval_ms=60_000).alias("target"),
                         F.col("clip_start").alias("start_ms"), F.col("clip_end").alias("end_ms"),
                         (F.col("clip_start") + F.col("clip") % 5 * 200).alias("final_start"),
                         (F.col("clip_end") - F.col("clip") % 3 * 300).alias("final_end"),
                         "score", F.col("clip").alias("seq"))
    fresh = I.exclude_overlapping(rows, excluded)
    return I.exclude_overlapping(stage(fresh), excluded, span=("final_start", "final_end"))


@query("select_clips")
def select_clips(spark, sf):
    chosen = K.admit_by_section(section_candidates(spark, sf))
    return chosen.select("media_id", "section", "seq", "final_start", "final_end", "score", "in_order")


@query("beat_snap")
def beat_snap(spark, sf):
    """Clip starts moved to the nearest word onset, as a beat grid; a tenth of the recordings have no grid, which leaves the time."""
    c = bind.clips(spark, sf).select("media_id", "clip", "clip_start")
    beats = bind.words(spark, sf).filter("media_id % 10 <> 9")
    near = I.nearest_value(c, "clip_start", beats, "start_ms", "beat")
    return near.select("media_id", "clip", F.coalesce("beat", F.floor((F.col("clip_start") + 5) / 10) * 10).cast(BIG).alias("snapped"))


@query("peak_sections")
def peak_sections(spark, sf):
    """Loudest frames of each recording; each blanks its surroundings."""
    frames = (frame_energy(spark, sf)
              .withColumn("level", F.col("level") * 1_000 + F.col("frame") % 7)
              .withColumn("blank_from", F.col("frame") - 3).withColumn("blank_to", F.col("frame") + 53))
    return K.peaks_with_suppression(frames, 4).select("media_id", "frame", F.col("level").cast(BIG).alias("level"), "pick")


@query("spaced_sections")
def spaced_sections(spark, sf):
    frames = frame_energy(spark, sf).select("media_id", F.col("frame").alias("seq"), (F.col("frame") * 40).alias("start_ms"),
                                            F.col("level").cast(BIG).alias("score"))
    return K.spaced_top(frames, 2, 25 * 40).select("media_id", "seq", "start_ms", "score", "pick")


@query("longest_run")
def longest_run(spark, sf):
    """Longest span of frames with boxes, where holes of up to two frames do not end it, and the share of such frames."""
    from timedspark.operators.scan import islands, latest
    hits = stage(frame_counts(spark, sf).filter("n > 0"))
    runs = islands(hits, FRAMES, {"__prev": latest(F.col("frame"))}, F.col("frame") - F.col("__prev") > 2, "run")
    spans = runs.groupBy("media_id", "run").agg((F.max("frame") - F.min("frame") + 1).alias("span"), F.count("*").alias("n"))
    return spans.groupBy("media_id").agg(F.max("span").alias("longest"), F.round(F.sum("n") / 300, 6).alias("persistence"))
