"""Clip metrics, scorecards and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.functions.extract import outer_object
from timedspark.functions.numeric import round_exact

DIMENSIONS = ("hook", "arc", "ending", "standalone", "shareability", "title_match")
TRAILER_AXES = ("opener_hook", "thematic_coherence", "pacing", "closer_punch", "standalone_quality")


def frame_metrics(frames: DataFrame, keys: tuple[str, ...], source_width: int) -> DataFrame:
    """Face rate, person rate and crop stability from per-frame rows (face, person, x_center)."""
    share = lambda flag: F.sum(F.col(flag).cast("int")) / F.greatest(F.lit(1), F.count("*"))
    spread = F.stddev_pop("x_center") / F.lit(max(1.0, source_width * 0.15))
    stable = F.when(F.count("x_center") >= 2, F.greatest(F.lit(0.0), 1 - spread)).otherwise(F.lit(1.0))
    return frames.groupBy(*keys).agg(share("face").alias("face_visibility"), share("person").alias("speaker_coverage"),
                                     stable.alias("crop_stability"))


def word_metrics(words: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Words per second and subtitle coverage; `clips` carries `length_ms`."""
    spoken = words.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("__ms"))
    seconds = F.greatest(F.lit(0.1), F.col("length_ms") / 1_000)
    return (clips.join(spoken, keys, "left")
            .withColumn("words_per_second", F.coalesce("__n", F.lit(0)) / seconds)
            .withColumn("subtitle_coverage", F.least(F.lit(1.0), F.coalesce("__ms", F.lit(0)) / 1_000 / seconds))
            .drop("__n", "__ms"))


def tech_score(face: Column, stability: Column, speaker: Column, seconds: Column, words_per_second: Column,
               coverage: Column) -> Column:
    """Weighted technical score; length and speech rate give 1 inside their range, else 0.5."""
    inside = lambda v, lo, hi: F.when(v.between(lo, hi), 1.0).otherwise(0.5)
    return (face * 0.25 + stability * 0.20 + speaker * 0.15 + inside(seconds, 25, 60) * 0.15
            + inside(words_per_second, 1.5, 3.5) * 0.15 + coverage * 0.10)


def verdict_of(overall: Column) -> Column:
    return F.when(overall >= 4, "publish").when(overall >= 3, "review").otherwise("skip")


def final_score(tech: Column, content_mean: Column) -> Column:
    """30 percent technical, 70 percent content; halves round to even."""
    return round_exact(tech * 0.3 + content_mean / 5 * 0.7, 2)


def parse_scorecard(replies: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Scores from replies (raw, transcript): one column per dimension, overall, verdict, feedback.

    A dimension is an object with a score, or a number; anything else counts
    3. An empty transcript skips the clip, an unreadable reply means review.
    """
    document = F.try_parse_json(outer_object(F.col("raw")))
    get = lambda path, kind: F.try_variant_get(F.col("__doc"), path, kind)

    def score(name: str) -> Column:
        plain = get(f"$.{name}", "double")
        is_object = F.startswith(F.schema_of_variant(F.try_variant_get(F.col("__doc"), f"$.{name}", "variant")), F.lit("OBJECT"))
        return F.coalesce(F.when(is_object, get(f"$.{name}.score", "double")).otherwise(plain), F.lit(3)).cast("int")

    readable = F.col("__doc").isNotNull()
    rows = replies.withColumn("__doc", document)
    for name in dimensions:
        rows = rows.withColumn(name, F.when(readable, score(name)))
    total = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0]))
    said = F.coalesce(get("$.overall", "double"), F.lit(0.0))
    overall = F.when(said != 0, said).otherwise(round_exact(total / len(dimensions), 1))
    claimed = F.coalesce(get("$.verdict", "string"), F.lit("review"))
    rows = rows.withColumn("overall", F.when(readable, overall))
    empty = F.coalesce(F.trim("transcript"), F.lit("")) == ""
    verdict = (F.when(empty, "skip").when(~readable, "review")
               .when(claimed.isin("publish", "review", "skip"), claimed).otherwise(verdict_of(F.col("overall"))))
    feedback = (F.when(empty, "empty transcript").when(~readable, "parse error")
                .otherwise(F.coalesce(get("$.one_line_feedback", "string"), F.lit(""))))
    return (rows.withColumn("content_mean", total / len(dimensions))
            .withColumn("verdict", verdict).withColumn("feedback", feedback).drop("__doc"))


def densest_pass(passes: DataFrame, min_rate: float = 1.5, min_ms: int = 3_000) -> DataFrame:
    """Transcription pass to keep per recording.

    `passes`: (media_id, pass, n_words, duration_ms, forced). Pass 0 is the
    automatic one; when it is sparse, not forced and long enough, the fullest
    other pass wins if it has more words, the earliest on a tie. A recording
    without an automatic pass keeps its fullest pass.
    """
    rate = F.try_divide(F.col("n_words"), F.col("duration_ms") / 1_000)
    auto = F.col("pass") == 0
    best = F.max(F.when(~auto, F.struct("n_words", (-F.col("pass")).alias("p"))))
    seen = passes.groupBy("media_id").agg(
        F.max(F.when(auto, F.col("n_words"))).alias("n_auto"),
        F.bool_or(auto & (rate < min_rate) & (F.col("duration_ms") >= min_ms) & ~F.col("forced")).alias("retry"),
        best.alias("b"))
    swap = F.col("n_auto").isNull() | (F.col("retry") & (F.col("b.n_words") > F.col("n_auto")))
    return seen.select("media_id", F.when(swap, -F.col("b.p")).otherwise(F.lit(0)).cast("int").alias("pass"),
                       F.when(swap, F.col("b.n_words")).otherwise(F.col("n_auto")).alias("n_words"))


def speaker_share(turns: DataFrame) -> DataFrame:
    return turns.groupBy("media_id", "speaker_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"))


def longest_turn(turns: DataFrame) -> DataFrame:
    """Longest turn per speaker, the earliest on a tie."""
    best = F.max_by(F.struct("start_ms", "end_ms"), F.struct(F.col("end_ms") - F.col("start_ms"), -F.col("start_ms")))
    return turns.groupBy("media_id", "speaker_id").agg(best.alias("t")).select("media_id", "speaker_id", "t.*")


def main_language(chunks: DataFrame) -> DataFrame:
    """Language with most words over the chunks (media_id, idx, language, n_words); first seen on a tie."""
    sums = chunks.groupBy("media_id", "language").agg(F.sum("n_words").alias("n"), F.min("idx").alias("first"))
    return sums.groupBy("media_id").agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))


def usage_report(receipts: DataFrame) -> DataFrame:
    """Cost and latency by model and day (level 0), by model (1) and over all receipts (3); a null model is a model of its own."""
    cost, seconds = F.sum("cost_usd"), F.sum("seconds")
    return receipts.rollup("model", "day").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("requests"), cost.alias("cost_usd"), seconds.alias("seconds"),
        (F.try_divide(cost, seconds) * 3_600).alias("cost_per_hour"),
        F.min("elapsed_seconds").alias("fastest"), F.max("elapsed_seconds").alias("slowest"))


def judge_agreement(scores: DataFrame, dimensions: tuple[str, ...], target: float = 0.7) -> DataFrame:
    """Correlation of human and model scores per dimension (columns human_<d>, model_<d>)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"human_{d}").cast("double").alias("human"),
                                         F.col(f"model_{d}").cast("double").alias("model")) for d in dimensions]))
    return (scores.select(pairs.alias("p")).groupBy("p.dimension").agg(F.corr("p.human", "p.model").alias("correlation"))
            .withColumn("agrees", F.col("correlation") > target))


def timing_problems(words: DataFrame, duration: Column, slack_ms: int = 250) -> DataFrame:
    """Words with missing or impossible times, and words starting before the last valid start."""
    from timedspark.operators.scan import Axis, latest, scan
    valid = (F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("start_ms") >= 0)
             & (F.col("end_ms") >= F.col("start_ms")) & (F.col("end_ms") <= duration + slack_ms))
    seen = scan(words.withColumn("__ok", F.coalesce(valid, F.lit(False))), Axis(("media_id",), ("seq",), 8_192),
                __prev=latest(F.when(F.col("__ok"), F.col("start_ms"))))
    problem = F.when(~F.col("__ok"), "invalid").when(F.col("start_ms") < F.col("__prev"), "unordered")
    return seen.withColumn("problem", problem).filter("problem IS NOT NULL").select("media_id", "seq", "problem")
