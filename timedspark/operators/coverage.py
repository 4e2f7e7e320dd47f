"""Coverage audit of a transcript against detected speech and a reference pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.operators.intervals import gaps, measure_within, overlap_join, union_ranges
from timedspark.operators.scan import Axis, latest, scan
from timedspark.operators.stage import stage

# Scores add milliseconds and word deficits; this many units make one second or one word.
SCORE_UNITS = 100_000


@dataclass(frozen=True)
class CoverageRules:
    """Fixed values of the audit, in milliseconds and percent."""

    max_word_ms: int = 2_500
    min_speech_ms: int = 1_500
    pad_ms: int = 150
    window_ms: int = 6_000
    words_per_second_pct: int = 65
    reference_min_words: int = 4
    reference_pct: int = 35


def coverage_findings(words: DataFrame, speech: DataFrame, reference: DataFrame, durations: DataFrame,
                      rules: CoverageRules = CoverageRules()) -> DataFrame:
    """Ranges (media_id, kind, start_ms, end_ms, score_units) before merging.

    kind `long`: an overlong word over speech or several reference words.
    kind `gap`: uncovered time that holds speech, cut to the speech in it.
    kind `sparse`: a sliding window with too few words for its speech.
    `words` needs (media_id, seq, start_ms, end_ms); `speech` must be disjoint.
    """
    length = F.col("end_ms") - F.col("start_ms")
    short = words.filter(length <= rules.max_word_ms)
    kind = lambda k: F.lit(k).alias("kind")
    long_words = words.filter(length > rules.max_word_ms).select(
        "media_id", kind("long"), F.col("seq").alias("qid"), "start_ms", "end_ms")
    covered = (short.join(durations, "media_id")
               .select("media_id", F.greatest(F.col("start_ms") - rules.pad_ms, F.lit(0)).alias("start_ms"),
                       F.least(F.col("end_ms") + rules.pad_ms, F.col("duration_ms")).alias("end_ms")))
    # Speech is disjoint, so only gaps of this length can hold enough of it.
    holes = gaps(covered, durations).filter(length >= rules.min_speech_ms).select(
        "media_id", kind("gap"), F.col("start_ms").alias("qid"), "start_ms", "end_ms")
    step = rules.window_ms // 2
    windows = (durations.filter("duration_ms > 0")
               .withColumn("start_ms", F.explode(F.sequence(
                   F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(step).cast("bigint"))))
               .select("media_id", kind("sparse"), F.col("start_ms").alias("qid"), "start_ms",
                       F.least(F.col("start_ms") + rules.window_ms, F.col("duration_ms")).alias("end_ms")))
    queries = stage(long_words.unionByName(holes).unionByName(windows))
    measured = measure_within(queries, ["kind", "qid", "start_ms", "end_ms"], speech,
                              {"n_words": short, "n_reference": reference})

    spoken, expected = F.col("overlap_ms"), F.col("n_reference")
    enough_reference = expected >= rules.reference_min_words
    reference_need = F.when(enough_reference, expected * (rules.reference_pct * 1_000)).otherwise(0)
    deficit = (F.greatest(spoken * rules.words_per_second_pct, reference_need)
               - F.col("n_words") * SCORE_UNITS)
    units = (F.when(F.col("kind") == "long", F.when(
                 (spoken >= rules.min_speech_ms) | enough_reference, (F.col("end_ms") - F.col("start_ms")) * 100))
             .when(F.col("kind") == "gap", F.when(spoken >= rules.min_speech_ms, spoken * 100))
             .otherwise(F.when((deficit > 0) & ((spoken >= rules.min_speech_ms) | enough_reference), deficit)))
    found = stage(measured.withColumn("score_units", units.cast("bigint")).filter("score_units IS NOT NULL").select(
        "media_id", "kind", "start_ms", "end_ms", "score_units"))

    spans = speech.select("media_id", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    cut = (overlap_join(found.filter("kind = 'gap'"), spans, 60_000)
           .groupBy("media_id", "kind", "start_ms", "end_ms", "score_units")
           .agg(F.min("r_start_ms").alias("first"), F.max("r_end_ms").alias("last"))
           .select("media_id", "kind", F.greatest("start_ms", "first").alias("start_ms"),
                   F.least("end_ms", "last").alias("end_ms"), "score_units"))
    return found.filter("kind <> 'gap'").unionByName(cut)


def coverage_issues(findings: DataFrame) -> DataFrame:
    """Merged issue ranges."""
    return union_ranges(findings)


def coverage_scores(findings: DataFrame) -> DataFrame:
    """Badness per recording; recordings without findings are absent."""
    return findings.groupBy("media_id").agg((F.sum("score_units") / SCORE_UNITS).alias("score"),
                                            F.count("*").alias("n_findings"))


def valid_words(words: DataFrame, durations: DataFrame) -> DataFrame:
    """media_id, valid: all words non-blank, ordered and inside the audio (20 ms and 100 ms slack)."""
    seen = scan(words, Axis(("media_id",), ("seq",), 8_192), __prev=latest(F.col("end_ms")))
    good = ((F.trim("text") != "") & (F.col("start_ms") >= F.coalesce("__prev", F.lit(0)) - 20)
            & (F.col("start_ms") >= 0) & (F.col("end_ms") >= F.col("start_ms"))
            & (F.col("end_ms") <= F.col("duration_ms") + 100))
    return (seen.join(durations, "media_id").groupBy("media_id")
            .agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("valid")))


#: A retry's words may lie this far outside its audio window.
RETRY_SLACK_MS = 100


def accept_repair(replacement_words: Column, spoken_ms: Column, in_window: Column, valid: Column,
                  old_score: Column, new_score: Column) -> Column:
    """A retry is taken if it is plausible and lowers the score by more than 0.01."""
    return (valid & in_window
            & (replacement_words <= F.greatest(F.lit(10.0), spoken_ms / 1_000 * 8))
            & (new_score < old_score - 0.01))


def unreliable_ranges(issues: DataFrame, chunks: DataFrame, context_ms: int,
                      max_fraction: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Chunks whose remaining issues are too long, and padded ranges to exclude for the others.

    `issues` and `chunks` share (media_id, idx); issue times are chunk-local,
    the excluded ranges are source times clamped to what the chunk owns.
    """
    measured = issues.groupBy("media_id", "idx").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("issue_ms"))
    judged = chunks.join(measured, ["media_id", "idx"], "left").withColumn(
        "rejected", F.coalesce("issue_ms", F.lit(0)) > (F.col("end_ms") - F.col("start_ms")) * max_fraction)
    kept = judged.filter("NOT rejected").select(
        "media_id", "idx", F.col("start_ms").alias("chunk_start"), F.col("end_ms").alias("chunk_end"),
        "left_x2", "right_x2")
    padded = issues.join(kept, ["media_id", "idx"]).select(
        "media_id", "idx",
        F.greatest((F.greatest(F.col("start_ms") - context_ms, F.lit(0)) + F.col("chunk_start")) * 2,
                   F.col("left_x2")).alias("s2"),
        F.least((F.least(F.col("end_ms") + context_ms, F.col("chunk_end") - F.col("chunk_start"))
                 + F.col("chunk_start")) * 2, F.col("right_x2")).alias("e2"))
    excluded = padded.filter("s2 < e2").select("media_id", "idx", (F.col("s2") / 2).alias("start_ms"),
                                               (F.col("e2") / 2).alias("end_ms"))
    return judged.select("media_id", "idx", F.coalesce("issue_ms", F.lit(0)).alias("issue_ms"), "rejected"), excluded
