"""Gap, run-length, smoothing and session operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.operators.fold import streaming_fold
from timedspark.operators.scan import BLOCK, FRAMES, WORDS, Axis, islands, latest, peak, scan, total, upcoming, with_halo
from timedspark.operators.stage import stage

SENTENCE_ENDS = (".", "!", "?")


def ends_sentence(text: Column) -> Column:
    return F.right(F.trim(text), F.lit(1)).isin(*SENTENCE_ENDS)


def _gap_islands(words: DataFrame, axis: Axis, gap_ms: int, at_sentences: bool = False) -> DataFrame:
    previous = {"__end": latest(F.col("end_ms"))}
    breaks = F.col("start_ms") - F.col("__end") > gap_ms
    if at_sentences:
        previous["__stop"] = latest(ends_sentence(F.col("text")))
        breaks = breaks | F.col("__stop")
    return islands(words, axis, previous, breaks)


def speech_sessions(words: DataFrame, gap_ms: int = 700, max_ms: int = 15_000, axis: Axis = WORDS) -> DataFrame:
    """Add `session`: split at a pause over `gap_ms` or when a word would end beyond `max_ms`.

    The length limit depends on where the running session began, so it is a
    fold, but one that never reaches across a pause.
    """
    def start():
        state = [None, None]

        def step(seq, begin, end):
            if state[0] is None or end - state[1] > max_ms:
                state[0], state[1] = seq, begin
            return (state[0],)
        return step

    cut = _gap_islands(words, axis, gap_ms)
    return streaming_fold(cut, [*axis.keys, "island"], ["seq"], ["seq", "start_ms", "end_ms"], start,
                          "session BIGINT").drop("island")


def popups(words: DataFrame, max_words: int = 1, gap_ms: int = 1_000, axis: Axis = WORDS) -> DataFrame:
    """Add `popup`: groups of up to `max_words`, split at pauses and after sentence ends. Blank tokens drop."""
    spoken = words.filter(F.trim("text") != "")
    cut = _gap_islands(spoken, axis, gap_ms, at_sentences=True)
    if max_words == 1:
        return cut.withColumn("popup", F.col("seq")).drop("island")
    ranked = stage(scan(cut, axis.keyed("island"), __rank=total(F.lit(1))))
    head = F.when(F.col("__rank") % max_words == 0, F.col("seq"))
    return scan(ranked, axis.keyed("island"), popup=latest(head, inclusive=True)).drop("island", "__rank")


def caption_lines(words: DataFrame, max_chars: int = 20, gap_ms: int = 800, axis: Axis = WORDS) -> DataFrame:
    """Add `line`: words packed to `max_chars`, split at pauses and after sentence ends."""
    def start():
        state = [None, 0]

        def step(seq, text):
            size = len(text.strip())
            if state[0] is None or state[1] + 1 + size > max_chars:
                state[0], state[1] = seq, size
            else:
                state[1] += 1 + size
            return (state[0],)
        return step

    spoken = words.filter(F.trim("text") != "")
    cut = _gap_islands(spoken, axis, gap_ms, at_sentences=True)
    return streaming_fold(cut, [*axis.keys, "island"], ["seq"], ["seq", "text"], start, "line BIGINT").drop("island")


def grouped_spans(rows: DataFrame, group: str, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """One span with its text per group of words."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("text"))))
    return rows.groupBy(*keys, group).agg(
        F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"),
        F.count("*").alias("n_words"), F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("text"))


def rolling(df: DataFrame, axis: Axis, before: int, after: int, **values: Column) -> DataFrame:
    """Add aggregates over rows within [position - before, position + after] on the order column."""
    window = (Window.partitionBy(*axis.keys, BLOCK).orderBy(axis.order[0]).rangeBetween(-before, after))
    wide = with_halo(df, axis, before, after)
    return (wide.select("*", *[v.over(window).alias(n) for n, v in values.items()])
            .filter("__home").drop(BLOCK, "__home"))


def majority_smooth(frames: DataFrame, flag: str, window: int = 15, axis: Axis = FRAMES) -> DataFrame:
    """Add `smooth`: at least half of the frames around each frame have the flag."""
    half = window // 2
    share = F.avg(F.col(flag).cast("int"))
    return rolling(frames, axis, half, half, __share=share).withColumn("smooth", F.col("__share") >= 0.5).drop("__share")


def debounce(frames: DataFrame, flag: str, hold: int, axis: Axis = FRAMES) -> DataFrame:
    """Add `stable`: a change shows from the `hold`-th consecutive frame on."""
    if hold <= 1:
        return frames.withColumn("stable", F.col(flag))
    position = axis.order[0]
    runs = islands(frames, axis, {"__prev": latest(F.col(flag))}, F.col(flag) != F.col("__prev"), "__run")
    ranked = scan(stage(runs), axis, __first=latest(F.lit(True)))
    settled = F.when((F.col(position) - F.col("__run") + 1 >= hold) | F.col("__first").isNull(), F.col(flag))
    return scan(stage(ranked), axis, stable=latest(settled, inclusive=True)).drop("__run", "__first")


def fill_nearest(frames: DataFrame, label: str, default: int = 0, axis: Axis = FRAMES) -> DataFrame:
    """Give unlabelled frames the label of the nearer labelled neighbour; the later one wins a tie."""
    position = F.col(axis.order[0])
    seen = F.when(F.col(label).isNotNull(), F.struct(position.alias("at"), F.col(label).alias("label")))
    both = scan(frames, axis, __p=latest(seen), __n=upcoming(seen))
    p, n = F.col("__p"), F.col("__n")
    filled = (F.when(F.col(label).isNotNull(), F.col(label)).when(p.isNull(), n["label"]).when(n.isNull(), p["label"])
              .when(n["at"] - position <= position - p["at"], n["label"]).otherwise(p["label"]))
    return both.withColumn("filled", F.coalesce(filled, F.lit(default))).drop("__p", "__n")


def run_lengths(frames: DataFrame, label: str, axis: Axis = FRAMES) -> DataFrame:
    """Runs of equal labels as half-open [start, end) frame spans."""
    position = axis.order[0]
    runs = islands(frames, axis, {"__prev": latest(F.col(label))}, ~F.col(label).eqNullSafe(F.col("__prev")), "run")
    return runs.groupBy(*axis.keys, "run").agg(
        F.first(label).alias(label), F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("run")


def min_dwell(spans: DataFrame, min_length: int, label: str, axis: Axis) -> DataFrame:
    """Short spans join the span before them; the first span always stands."""
    start, end = "start_ms", "end_ms"
    grouped = islands(spans, axis, {}, F.col(end) - F.col(start) >= min_length, "dwell")
    order = F.struct(*[F.col(c) for c in axis.order])
    return grouped.groupBy(*axis.keys, "dwell").agg(
        F.min_by(label, order).alias(label), F.min_by(start, order).alias(start), F.max_by(end, order).alias(end)).drop("dwell")


def collapse_labels(spans: DataFrame, label: str, axis: Axis, gap_ms: int, inclusive: bool) -> DataFrame:
    """Join neighbours with one label whose gap is below `gap_ms` (or equal to it when inclusive)."""
    gap = F.col("start_ms") - F.col("__end")
    apart = gap > gap_ms if inclusive else gap >= gap_ms
    joined = islands(spans, axis, {"__label": latest(F.col(label)), "__end": latest(F.col("end_ms"))},
                     (F.col(label) != F.col("__label")) | apart, "turn_id")
    order = F.struct(*[F.col(c) for c in axis.order])
    return joined.groupBy(*axis.keys, "turn_id").agg(
        F.first(label).alias(label), F.min_by("start_ms", order).alias("start_ms"),
        F.max_by("end_ms", order).alias("end_ms")).drop("turn_id")


def rolling_variance(samples: DataFrame, frames: DataFrame, value: str, left: int, right: int,
                     floor: float = 1e-5, axis: Axis = FRAMES) -> DataFrame:
    """Winner track per frame: the largest variance over [frame - left, frame + right], at least `floor`.

    A track counts with three or more samples in the window; the lowest track wins a tie.
    """
    tracks = samples.select(*axis.keys, "track").distinct()
    grid = frames.join(tracks, list(axis.keys)).join(samples, [*axis.keys, "track", axis.order[0]], "left")
    rated = rolling(grid, axis.keyed("track"), left, right, variance=F.var_pop(value), n=F.count(value))
    best = F.max(F.when(F.col("n") >= 3, F.struct(F.col("variance"), (-F.col("track")).alias("t"))))
    return (rated.groupBy(*axis.keys, axis.order[0]).agg(best.alias("b"))
            .withColumn("winner", F.when(F.col("b.variance") >= floor, -F.col("b.t")))
            .withColumn("variance", F.col("b.variance")).drop("b"))


def concat_offsets(picks: DataFrame, words: DataFrame, gap_ms: int = 600) -> DataFrame:
    """Words of consecutive picks on one common clock, with a pause between picks.

    `picks`: (media_id, pick, length_ms); `words`: pick-local (media_id, pick, seq, start_ms, end_ms, ...).
    """
    timed = scan(picks, Axis(("media_id",), ("pick",), 4_096),
                 offset_ms=total((F.col("length_ms") + gap_ms).cast("bigint")))
    return (words.join(timed.select("media_id", "pick", "length_ms", "offset_ms"), ["media_id", "pick"])
            .filter((F.col("start_ms") >= 0) & (F.col("start_ms") <= F.col("length_ms")))
            .withColumn("start_ms", F.col("start_ms") + F.col("offset_ms"))
            .withColumn("end_ms", F.least("end_ms", "length_ms") + F.col("offset_ms"))
            .drop("length_ms", "offset_ms"))


def split_span(tokens: Column, start: Column, end: Column) -> Column:
    """Array of (text, start_ms, end_ms): a span shared by tokens in proportion to their length."""
    weight = lambda t: F.greatest(F.char_length(F.trim(t)), F.lit(1)).cast("bigint")
    add = lambda acc, x: acc + x
    zero = F.lit(0).cast("bigint")
    weights = F.transform(tokens, weight)
    whole = F.aggregate(weights, zero, add)
    until = lambda i: F.aggregate(F.slice(weights, 1, i), zero, add)
    at = lambda i: start + F.round((end - start) * until(i) / whole).cast("bigint")
    return F.transform(tokens, lambda t, i: F.struct(
        F.trim(t).alias("text"), at(i).alias("start_ms"), at(i + 1).alias("end_ms")))


def split_spans(tokens: DataFrame, keys: tuple[str, ...], order: str, width: int = 8_192) -> DataFrame:
    """The rule of `split_span` over rows (keys, order, text, from_ms, to_ms), for spans of any number of tokens."""
    weight = F.greatest(F.char_length(F.trim("text")), F.lit(1)).cast("bigint")
    summed = scan(tokens, Axis(keys, (order,), width), __upto=total(weight, inclusive=True))
    wholes = tokens.groupBy(*keys).agg(F.sum(weight).alias("__whole"))
    at = lambda n: F.col("from_ms") + F.round((F.col("to_ms") - F.col("from_ms")) * n / F.col("__whole")).cast("bigint")
    return summed.join(wholes, list(keys)).select(*keys, order, F.trim("text").alias("text"), at(F.col("__upto") - weight).alias("start_ms"), at(F.col("__upto")).alias("end_ms"))


def exact_percentile(df: DataFrame, keys: tuple[str, ...], value: str, p: float, scale: int, width: int = 4_096) -> DataFrame:
    """Linear-interpolated percentile by rank; equal values are counted first, so no key is held in memory."""
    counted = (df.groupBy(*keys, value).agg(F.count("*").alias("n"))
               .withColumn("__cell", F.floor(F.col(value) * scale).cast("bigint")))
    ranked = scan(counted, Axis(keys, ("__cell", value), width), __below=total(F.col("n")))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size"))
    position = (F.col("__size") - 1) * F.lit(p)
    holds = lambda r: (F.col("__below") <= r) & (r < F.col("__below") + F.col("n"))
    low, high = F.floor(position), F.ceil(position)
    return (ranked.join(sizes, list(keys)).groupBy(*keys).agg(
        F.max(F.when(holds(low), F.col(value))).alias("lo"), F.max(F.when(holds(high), F.col(value))).alias("hi"),
        F.max(position - low).alias("part"))
        .select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("__level")))


def normalised(df: DataFrame, value: str, scale: int, axis: Axis = FRAMES) -> DataFrame:
    """Divide by the 95th percentile of the key (1 when it is 0) and clip to [0, 1]."""
    levels = exact_percentile(df, axis.keys, value, 0.95, scale)
    level = F.when(F.col("__level") == 0, F.lit(1.0)).otherwise(F.col("__level"))
    return (df.join(levels, list(axis.keys))
            .withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / level))).drop("__level"))


def moving_average(df: DataFrame, value: str, window: int, axis: Axis = FRAMES) -> DataFrame:
    """Centred mean of `window` frames; positions beyond the ends count as zero."""
    before, after = window // 2, (window - 1) // 2
    return rolling(df, axis, before, after, __sum=F.sum(value)).withColumn(
        value, F.col("__sum") / window).drop("__sum")


def merge_chunk_segments(segments: DataFrame, slack_ms: int = 100, axis: Axis = WORDS) -> DataFrame:
    """Drop segments that start before the end of the last kept one (minus slack), in reading order.

    Adds `words_from`: words of a kept segment before it are repeats. A
    dropped segment does not move the mark, so this is a fold; it restarts
    where a segment begins after everything before it has ended.
    """
    def start():
        state = [None]

        def step(begin, end):
            mark = state[0]
            if mark is not None and begin < mark - slack_ms:
                return None
            state[0] = end if mark is None else max(mark, end)
            return (None if mark is None else mark - slack_ms,)
        return step

    cut = islands(segments, axis, {"__reach": peak(F.col("end_ms"))}, F.col("start_ms") >= F.col("__reach"))
    return streaming_fold(cut, [*axis.keys, "island"], list(axis.order), ["start_ms", "end_ms"], start,
                          "words_from BIGINT").drop("island")


# Fixed set of marks ignored when two boundary words are compared.
EDGE_MARKS = ".,!?;:।…\"'“”‘’()[]{}"


def dedupe_boundary_words(words: DataFrame, axis: Axis = WORDS) -> DataFrame:
    """Resolve overlaps between owned words of neighbouring chunks.

    Input has `left_x2`, the doubled left edge of the chunk owning the word. A
    word that repeats the kept word before it across that edge drops; any
    other overlap is split in the middle (rounded down).
    """
    def start():
        state = [None, None]

        def step(begin, end, plain, left_x2):
            if state[0] is None or begin >= state[0]:
                state[0], state[1] = end, plain
                return (begin, None)
            if 2 * begin < left_x2 < 2 * state[0] and plain == state[1]:
                return None
            middle = (state[0] + begin) // 2
            state[0], state[1] = end, plain
            return (middle, middle)
        return step

    plain = words.withColumn("__plain", F.btrim(F.lower("text"), F.lit(EDGE_MARKS)))
    cut = islands(plain, axis, {"__reach": peak(F.col("end_ms"))}, F.col("start_ms") >= F.col("__reach"))
    kept = stage(streaming_fold(cut, [*axis.keys, "island"], list(axis.order),
                                ["start_ms", "end_ms", "__plain", "left_x2"], start, "__from BIGINT, __cut BIGINT"))
    after = scan(kept, axis.keyed("island"), __next=upcoming(F.struct(F.col("__cut").alias("cut"))))
    return (after.withColumn("end_ms", F.coalesce("__next.cut", "end_ms")).withColumn("start_ms", F.col("__from"))
            .select(*words.columns))


def misses(frames: DataFrame, hit: str, axis: Axis = FRAMES) -> DataFrame:
    """Add `misses`: consecutive frames without a hit up to this one."""
    position = F.col(axis.order[0])
    seen = scan(frames, axis, __hit=latest(F.when(F.col(hit), position), inclusive=True))
    return seen.withColumn("misses", position - F.coalesce("__hit", F.lit(-1))).drop("__hit")
