"""Score-ordered selection without overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.operators.fold import streaming_fold
from timedspark.operators.scan import Axis, islands, peak
from timedspark.operators.stage import stage

MEDIA = ("media_id",)


def clip_cap(duration_ms: Column, override: Column | None = None, minimum: int = 3, maximum: int = 30,
             interval_ms: int = 300_000) -> Column:
    """Clips allowed per recording."""
    cap = F.least(F.lit(maximum), F.greatest(F.lit(minimum), F.ceil(duration_ms / interval_ms))).cast("bigint")
    if override is None:
        return cap
    return F.when(override.isNull(), cap).otherwise(F.least(override, F.lit(maximum))).cast("bigint")


def section_budget(cap: Column, length_ms: Column, duration_ms: Column) -> Column:
    share = F.ceil(2 * cap * length_ms / duration_ms)
    return F.least(2 * cap, F.greatest(F.lit(3), share)).cast("bigint")


def _overlap_islands(rows: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """Number chains of overlapping rows; rows of different chains never overlap."""
    return islands(rows, Axis(keys, ("start_ms", "seq"), width), {"__reach": peak(F.col("end_ms"))},
                   F.col("start_ms") >= F.col("__reach"))


def best_per_span(rows: DataFrame, *keys: str) -> DataFrame:
    """Among rows with one span keep the best score, then the lowest seq; the others can never be picked.

    A map-side aggregate, so many copies of one span cost one row.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col("seq")))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*").select(*rows.columns)


def greedy_by_score(candidates: DataFrame, target: int, keys: tuple[str, ...] = MEDIA,
                    width: int = 600_000) -> DataFrame:
    """Best-first choice of up to `target` rows per key that do not overlap each other.

    Needs (start_ms, end_ms, score, seq). Rows of different overlap chains do
    not affect each other, so each chain is its own fold, and the first
    `target` of the accepted rows by score are the answer. A chain never needs
    more than `target` rows itself, which bounds the fold state.
    """
    def start():
        taken = []

        def step(begin, end):
            if len(taken) >= target or any(begin < e and end > s for s, e in taken):
                return None
            taken.append((begin, end))
            return (len(taken),)
        return step

    distinct = best_per_span(candidates, *keys, "start_ms", "end_ms")
    chains = _overlap_islands(distinct, keys, width).withColumn("__rank", -F.col("score"))
    kept = streaming_fold(chains, [*keys, "island"], ["__rank", "seq"], ["start_ms", "end_ms"], start, "__n INT")
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "seq")
    return (kept.drop("island", "__rank", "__n").withColumn("pick", F.row_number().over(best))
            .filter(F.col("pick") <= target))


def greedy_by_start(rows: DataFrame, keys: tuple[str, ...] = MEDIA, width: int = 600_000) -> DataFrame:
    """First-come choice: a row drops when it starts before the last kept row ends."""
    def start():
        state = [None]

        def step(begin, end):
            if state[0] is not None and begin < state[0]:
                return None
            state[0] = end
            return (1,)
        return step

    chains = _overlap_islands(rows, keys, width)
    return streaming_fold(chains, [*keys, "island"], ["start_ms", "seq"], ["start_ms", "end_ms"], start,
                          "__n INT").drop("island", "__n")


class Admission:
    """Accepted spans of one recording; shared by the batch fold and the stream."""

    def __init__(self, spans: list[tuple[int, int]] | None = None):
        self.spans = spans or []
        self.section = None
        self.closed = False

    def free(self, begin: int, end: int) -> bool:
        return not any(begin < e and end > s for s, e in self.spans)

    def offer(self, section: int, allowance: int, target: int, begin: int, end: int,
              final_begin: int, final_end: int) -> str:
        """One of accepted, deferred, dropped, unsearched."""
        if section != self.section:
            # A section after the target is reached is never searched.
            self.closed = len(self.spans) >= target
            self.section = section
        if self.closed:
            return "unsearched"
        if len(self.spans) >= allowance:
            return "deferred"
        return self.take(begin, end, final_begin, final_end)

    def take(self, begin: int, end: int, final_begin: int, final_end: int) -> str:
        if self.free(begin, end) and self.free(final_begin, final_end):
            self.spans.append((final_begin, final_end))
            return "accepted"
        return "dropped"


def allowance(section_end: Column, duration: Column, target: Column) -> Column:
    """Picks allowed up to the end of a section; room is kept for later sections."""
    part = F.greatest(F.lit(1), F.floor(target * section_end / duration))
    return F.when(section_end >= duration, target).otherwise(part).cast("bigint")


def admit_by_section(candidates: DataFrame, keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Admit candidates section by section within a growing allowance, then fill from the deferred ones.

    Needs (section, section_end, duration_ms, target, start_ms, end_ms,
    final_start, final_end, score, seq); candidates that failed review are to
    be filtered before. Two sorted passes; the state is the accepted spans, at
    most `target` per key.
    """
    key_list = list(keys)
    rows = best_per_span(candidates, *keys, "section", "start_ms", "end_ms", "final_start", "final_end")
    rows = rows.withColumn("__allow", allowance(F.col("section_end"), F.col("duration_ms"), F.col("target")))
    rows = rows.withColumn("__rank", -F.col("score"))

    def first_pass():
        admission = Admission()

        def step(*values):
            outcome = admission.offer(*values)
            return (outcome,) if outcome in ("accepted", "deferred") else None
        return step

    def fill_pass():
        admission = Admission()

        def step(state, target, *span):
            if state == "accepted":
                admission.spans.append(span[2:])
                return (True,)
            if len(admission.spans) >= target or admission.take(*span) != "accepted":
                return None
            return (False,)
        return step

    spans = ["start_ms", "end_ms", "final_start", "final_end"]
    first = streaming_fold(rows, key_list, ["section", "__rank", "seq"],
                           ["section", "__allow", "target", *spans], first_pass, "__state STRING")
    # "accepted" sorts before "deferred".
    filled = streaming_fold(first, key_list, ["__state", "__rank", "section", "seq"],
                            ["__state", "target", *spans], fill_pass, "in_order BOOLEAN")
    return filled.drop("__allow", "__rank", "__state")


def _pick_rounds(rows: DataFrame, count: int, keys: tuple[str, ...], order: Column, blocked: Column) -> DataFrame:
    """`count` rounds of: take the best row per key, remove the rows it blocks.

    `blocked` sees the row and the pick, whose columns start with `p_`. Each
    round is a map-side aggregate and a join with one row per key, so a long
    key is never sorted or gathered.
    """
    left, picks = stage(rows), []
    for number in range(1, count + 1):
        best = left.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("p"))
        best = stage(best.select("p.*"))
        picks.append(best.withColumn("pick", F.lit(number)))
        taken = best.select(*keys, *[F.col(c).alias("p_" + c) for c in rows.columns if c not in keys])
        left = left.join(taken, list(keys)).filter(~blocked).select(*rows.columns)
    result = picks[0]
    for more in picks[1:]:
        result = result.unionByName(more)
    return result


def spaced_top(rows: DataFrame, count: int, distance: int, keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Up to `count` rows by score whose starts are at least `distance` apart (2: the fullest chorus and one more)."""
    near = F.abs(F.col("start_ms") - F.col("p_start_ms")) < distance
    return _pick_rounds(rows, count, keys, F.struct("score", -F.col("seq")), near)


def peaks_with_suppression(frames: DataFrame, count: int, floor: float = 0.55,
                           keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Highest frames first; each blanks [blank_from, blank_to) and none below `floor` of the top counts.

    Needs (frame, level, blank_from, blank_to).
    """
    tops = frames.groupBy(*keys).agg(F.max("level").alias("__top"))
    high = frames.join(tops, list(keys)).filter(F.col("level") >= floor * F.col("__top")).select(*frames.columns)
    blanked = (F.col("frame") == F.col("p_frame")) | (
        (F.col("frame") >= F.col("p_blank_from")) & (F.col("frame") < F.col("p_blank_to")))
    return _pick_rounds(high, count, keys, F.struct("level", -F.col("frame")), blanked)


def best_section(scores: DataFrame, minimum: float = 5.0) -> DataFrame:
    """Best (clip, section) score; no row when it stays below the minimum. The first position wins a tie."""
    best = F.max(F.struct("score", (-F.col("position")).alias("p")))
    return (scores.groupBy("clip").agg(best.alias("b")).filter(F.col("b.score") >= minimum)
            .select("clip", (-F.col("b.p")).alias("position"), F.col("b.score").alias("score")))
