"""Joins of words and segments with candidate clips.

Clips carry (media_id, clip, clip_start, clip_end). Their length is limited by
the clip rules, so the words of one clip are a small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timedspark.operators.intervals import nearest_value, next_at_or_after, overlap_join, point_join

BUCKET = 60_000


def clip_words(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Words overlapping a clip, cut to it and moved to clip time."""
    return (overlap_join(words, clips, BUCKET, right_span=("clip_start", "clip_end"), long_spans=True)
            .withColumn("start_ms", F.greatest("start_ms", "clip_start") - F.col("clip_start"))
            .withColumn("end_ms", F.least("end_ms", "clip_end") - F.col("clip_start")))


def ordered_text(order: Column, text: Column, when: Column | None = None) -> Column:
    """Aggregate: space-joined trimmed texts in order, blanks removed."""
    item = F.struct(order.alias("o"), F.trim(text).alias("t"))
    rows = F.collect_list(item if when is None else F.when(when, item))
    return F.array_join(F.filter(F.transform(F.array_sort(rows), lambda r: r["t"]), lambda t: t != ""), " ")


def clip_texts(pieces: DataFrame, clips: DataFrame, opening_ms: int = 5_000, ending_ms: int = 7_000) -> DataFrame:
    """Excerpt, opening and ending text of each clip from the pieces fully inside it.

    Pieces are words, plus whole segments where a segment has no words.
    """
    start, end = F.col("clip_start"), F.col("clip_end")
    inside = (overlap_join(pieces, clips, BUCKET, right_span=("clip_start", "clip_end"), long_spans=True)
              .filter((F.col("start_ms") >= start) & (F.col("end_ms") <= end)))
    seq, text = F.col("seq"), F.col("text")
    texts = inside.groupBy("media_id", "clip").agg(
        F.count("*").alias("n_words"),
        ordered_text(seq, text, F.col("start_ms") < start + opening_ms).alias("opening"),
        ordered_text(seq, text, F.col("end_ms") > end - ending_ms).alias("ending"),
        ordered_text(seq, text).alias("excerpt"))
    return (clips.select("media_id", "clip").join(texts, ["media_id", "clip"], "left")
            .select("media_id", "clip", F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"),
                    *[F.coalesce(c, F.lit("")).alias(c) for c in ("opening", "ending", "excerpt")]))


def context_words(words: DataFrame, clips: DataFrame, reach_ms: int = 10_000) -> DataFrame:
    """Words starting within `reach_ms` of a clip, numbered from 0 per clip."""
    spans = (clips.withColumn("__lo", F.greatest(F.col("clip_start") - reach_ms, F.lit(0)))
             .withColumn("__hi", F.col("clip_end") + reach_ms))
    rows = point_join(words, spans, BUCKET, "start_ms", ("__lo", "__hi")).drop("__lo", "__hi")
    numbering = Window.partitionBy("media_id", "clip").orderBy("seq")
    return rows.withColumn("idx", (F.row_number().over(numbering) - 1).cast("bigint"))


def current_indices(context: DataFrame, min_words: int = 8) -> DataFrame:
    """First and last context word nearest to the clip bounds; `sparse` when there are too few words."""
    near_start = F.struct(F.abs(F.col("start_ms") - F.col("clip_start")).alias("d"), F.col("idx"))
    near_end = F.struct(F.abs(F.col("end_ms") - F.col("clip_end")).alias("d"), F.col("idx"))
    return (context.groupBy("media_id", "clip")
            .agg(F.count("*").alias("n_words"), F.min(near_start)["idx"].alias("first_idx"),
                 F.min(near_end)["idx"].alias("last_idx"))
            .withColumn("sparse", F.col("n_words") < min_words))


def snap_to_segments(clips: DataFrame, segments: DataFrame, tolerance_ms: int = 3_000,
                     min_ms: int = 15_000, max_ms: int = 90_000) -> DataFrame:
    """Move clip bounds to the nearest segment bounds within the tolerance.

    Both moves are undone when the result leaves [0, duration_ms] or the
    allowed length.
    """
    starts = nearest_value(clips, "clip_start", segments, "start_ms", "__s")
    both = nearest_value(starts, "clip_end", segments, "end_ms", "__e")
    start = F.when(F.abs(F.col("__s") - F.col("clip_start")) <= tolerance_ms, F.col("__s")).otherwise(F.col("clip_start"))
    end = F.when(F.abs(F.col("__e") - F.col("clip_end")) <= tolerance_ms, F.col("__e")).otherwise(F.col("clip_end"))
    moved = both.withColumn("new_start", start).withColumn("new_end", end)
    fits = ((F.col("new_start") >= 0) & (F.col("new_start") < F.col("new_end"))
            & (F.col("new_end") <= F.col("duration_ms"))
            & (F.col("new_end") - F.col("new_start")).between(min_ms, max_ms))
    return (moved.withColumn("snap_start", F.when(fits, F.col("new_start")).otherwise(F.col("clip_start")))
            .withColumn("snap_end", F.when(fits, F.col("new_end")).otherwise(F.col("clip_end")))
            .select(*clips.columns, "snap_start", "snap_end"))


def reaction_tails(clips: DataFrame, words: DataFrame, reaction_ms: int = 2_000, guard_ms: int = 100,
                   max_ms: int = 90_000) -> DataFrame:
    """Lengthen clips into the silence before the next word."""
    seen = next_at_or_after(clips, "clip_end", words, "start_ms", "__next")
    room = F.least(F.col("clip_end") + reaction_ms,
                   F.coalesce(F.col("__next"), F.col("duration_ms")) - guard_ms,
                   F.col("clip_start") + max_ms, F.col("duration_ms"))
    return seen.withColumn("tail_end", F.greatest(F.col("clip_end"), room)).drop("__next")


def cut_bounds(quotes: DataFrame, words: DataFrame, slack_ms: int = 100, head_ms: int = 100,
               tail_ms: int = 100) -> DataFrame:
    """First and last word starting in the quote, padded; the padded quote when there is none."""
    spans = (quotes.withColumn("__lo", F.col("clip_start") - slack_ms)
             .withColumn("__hi", F.col("clip_end") + slack_ms))
    found = (point_join(words, spans, BUCKET, "start_ms", ("__lo", "__hi")).groupBy("media_id", "clip")
             .agg(F.min_by("start_ms", "seq").alias("__first"), F.max_by("end_ms", "seq").alias("__last")))
    return (quotes.join(found, ["media_id", "clip"], "left")
            .withColumn("cut_start", F.greatest(F.coalesce("__first", "clip_start") - head_ms, F.lit(0)))
            .withColumn("cut_end", F.coalesce("__last", "clip_end") + tail_ms)
            .drop("__first", "__last"))


def skip_finished(clips: DataFrame, finished: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Drop clips whose two bounds are both within the tolerance of a finished clip."""
    bucket = F.floor(F.col("clip_start") / tolerance_ms)
    done = finished.select(
        "media_id", F.col("clip_start").alias("__ds"), F.col("clip_end").alias("__de"),
        F.explode(F.sequence(bucket - 1, bucket + 1)).alias("__bucket")).alias("d")
    rows = clips.withColumn("__bucket", bucket).alias("c")
    same = ((F.col("c.media_id") == F.col("d.media_id")) & (F.col("c.__bucket") == F.col("d.__bucket"))
            & (F.abs(F.col("c.clip_start") - F.col("d.__ds")) < tolerance_ms)
            & (F.abs(F.col("c.clip_end") - F.col("d.__de")) < tolerance_ms))
    return rows.join(done, same, "left_anti").select(*clips.columns)


def reuse_containing(requests: DataFrame, stored: DataFrame, stored_words: DataFrame,
                     identity: tuple[str, ...], width: int = BUCKET) -> DataFrame:
    """Words for requested clips taken from a stored interval that contains them.

    Identity columns (source, settings, artifact) must agree. The lowest
    `manifest` with at least one word wins. `stored_words` are relative to
    their manifest's `held_start`.
    """
    pairs = (overlap_join(requests, stored, width, identity, ("clip_start", "clip_end"), ("held_start", "held_end"))
             .filter("held_start <= clip_start AND clip_end <= held_end"))
    local = stored_words.select("manifest", F.col("seq"), F.col("start_ms").alias("w_start"),
                                F.col("end_ms").alias("w_end"), "text")
    a, b = F.col("w_start") + F.col("held_start"), F.col("w_end") + F.col("held_start")
    rows = pairs.join(local, "manifest").filter((a < F.col("clip_end")) & (b > F.col("clip_start")))
    usable = rows.groupBy(*identity, "clip").agg(F.min("manifest").alias("manifest"))
    return rows.join(usable, [*identity, "clip", "manifest"], "left_semi").select(
        *identity, "clip", "manifest", "seq", F.greatest(a - F.col("clip_start"), F.lit(0)).alias("start_ms"),
        (F.least(b, F.col("clip_end")) - F.col("clip_start")).alias("end_ms"), "text")


def _token(text: Column) -> Column:
    """Lower case without anything but word characters; the slow rule for all scripts is for texts that need it."""
    low = F.lower(text)
    latin = F.when(low.rlike("^[a-z0-9_]*$"), low).otherwise(F.regexp_replace(low, "[^a-z0-9_]", ""))
    return F.when(low.rlike(r"^[\x00-\x7F]*$"), latin).otherwise(F.regexp_replace(low, r"(?U)[^\w]", ""))


def splice_words(words: DataFrame, replacement: DataFrame, windows: DataFrame) -> DataFrame:
    """Replace the words of repair windows by a second transcription.

    `windows`: (media_id, win, start_ms, end_ms), disjoint per recording.
    `replacement`: (media_id, win, j, start_ms, end_ms, text). Equal tokens
    less than a second apart outside the window are anchors: the last pair
    before and the first after bound the replaced part when they agree in
    order. Otherwise the window grows over crossing words and replacement
    words are taken by midpoint. Result: (media_id, seq, j, start_ms, end_ms,
    text) to be read in start order; `j` is null for kept words, and `seq` of
    an inserted word is the first word it replaces, if any.
    """
    key = _token
    win = windows.select("media_id", "win", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    # Anchors lie within a second of a replacement word: bucket both by second.
    new = (replacement.join(win, ["media_id", "win"])
           .select("media_id", "win", "ws", "we", "j", key(F.col("text")).alias("token"),
                   (F.col("start_ms") + F.col("end_ms")).alias("new_x2"))
           .withColumn("second", F.explode(F.array(*[F.floor(F.col("new_x2") / 2_000) + d for d in (-1, 0, 1)]))))
    old = words.select("media_id", F.col("seq").alias("i"), key(F.col("text")).alias("token"),
                       F.col("start_ms").alias("os"), F.col("end_ms").alias("oe"),
                       F.floor((F.col("start_ms") + F.col("end_ms")) / 2_000).alias("second"))
    pairs = (old.join(new, ["media_id", "token", "second"])
             .filter((F.col("token") != "") & (F.abs(F.col("os") + F.col("oe") - F.col("new_x2")) < 2_000)))
    left_pair, right_pair = F.struct("i", "j", F.col("oe").alias("at")), F.struct("i", "j", F.col("os").alias("at"))
    anchors = pairs.groupBy("media_id", "win").agg(
        F.max(F.when(F.col("oe") <= F.col("ws"), left_pair)).alias("l"),
        F.min(F.when(F.col("os") >= F.col("we"), right_pair)).alias("r")).filter("l.j < r.j")

    crossing = (overlap_join(words.select("media_id", "seq", "start_ms", "end_ms"), win, BUCKET, right_span=("ws", "we"))
                .groupBy("media_id", "win").agg(F.min_by("start_ms", "seq").alias("cs"), F.max_by("end_ms", "seq").alias("ce")))
    plan = (win.join(anchors, ["media_id", "win"], "left").join(crossing, ["media_id", "win"], "left")
            .withColumn("anchored", F.col("l").isNotNull())
            .withColumn("ps", F.least("ws", "cs")).withColumn("pe", F.greatest("we", "ce"))
            .withColumn("cut_start", F.when(F.col("anchored"), F.col("l.at")).otherwise(F.col("ps")))
            .withColumn("cut_end", F.when(F.col("anchored"), F.col("r.at")).otherwise(F.col("pe"))))
    # Removed words: between the anchors by sequence, or overlapping the grown window by time.
    doomed = overlap_join(words.select("media_id", "seq", "start_ms", "end_ms"),
                          plan.select("media_id", "win", "anchored", "l", "r",
                                      F.least("ps", "cut_start").alias("ps"), F.greatest("pe", "cut_end").alias("pe")),
                          BUCKET, right_span=("ps", "pe")).filter(
        F.when(F.col("anchored"), (F.col("seq") > F.col("l.i")) & (F.col("seq") < F.col("r.i"))).otherwise(F.lit(True)))
    kept = words.join(doomed, ["media_id", "seq"], "left_anti").select(
        "media_id", "seq", F.lit(None).cast("bigint").alias("j"), "start_ms", "end_ms", "text")
    mid_x2 = F.col("start_ms") + F.col("end_ms")
    before = doomed.groupBy("media_id", "win").agg(F.min("seq").alias("at"))
    inserted = (replacement.join(plan, ["media_id", "win"]).join(before, ["media_id", "win"], "left")
                .filter(F.when(F.col("anchored"), (F.col("j") > F.col("l.j")) & (F.col("j") < F.col("r.j")))
                        .otherwise((mid_x2 >= F.col("ps") * 2) & (mid_x2 < F.col("pe") * 2)))
                .select("media_id", F.coalesce("at", F.col("l.i")).alias("seq"), F.col("j").cast("bigint").alias("j"),
                        F.greatest("cut_start", "start_ms").alias("start_ms"),
                        F.least("cut_end", "end_ms").alias("end_ms"), "text"))
    return kept.unionByName(inserted)
