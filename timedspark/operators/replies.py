"""Gates that turn raw model replies into validated rows.

Input is a table of replies (keys, attempt, raw); work is row-local, followed
by aggregates over one reply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.functions import text as T
from timedspark.functions.extract import flat_object, leading_array, lenient_array, outer_object
from timedspark.functions.numeric import round_exact
from timedspark.schema import finite, to_ms

RAW_CLIP = "ARRAY<STRUCT<start: STRING, end: STRING, title: STRING, reason: STRING, hook_score: STRING>>"


def score_with(prompts: DataFrame, scorer: Callable[[str, str], str], schema: str = "key STRING, raw STRING") -> DataFrame:
    """Replies from a pluggable scorer: `scorer(system_prompt, user_prompt)` per row, in Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [scorer(s, u) for s, u in zip(batch["system_prompt"], batch["user_prompt"])]
            yield pd.DataFrame({"key": batch["key"], "raw": raw})
    return prompts.select("key", "system_prompt", "user_prompt").mapInPandas(run, schema)


def latest_good(replies: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """Last good attempt per key. Empty text is never good."""
    usable = F.coalesce(good & (F.trim("raw") != ""), F.lit(False))
    best = F.max_by(F.struct("attempt", "raw"), F.when(usable, F.col("attempt")))
    return replies.groupBy(*keys).agg(best.alias("b")).filter("b IS NOT NULL").select(*keys, "b.*")


def coerce_clips(items: DataFrame, duration: Column, min_ms: int = 15_000, max_ms: int = 90_000) -> DataFrame:
    """Validated candidates from raw string fields (start, end, title, reason, hook_score)."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    clamp = lambda v: F.greatest(F.lit(0).cast("bigint"), F.least(to_ms(v), duration))
    rows = (items.withColumn("start_ms", clamp(number("start"))).withColumn("end_ms", clamp(number("end")))
            .withColumn("__score", F.when(F.col("hook_score").isNull(), F.lit(0.5)).otherwise(number("hook_score"))))
    length = F.col("end_ms") - F.col("start_ms")
    kept = rows.filter(finite(number("start")) & finite(number("end")) & finite(F.col("__score"))
                       & (length > 0) & length.between(min_ms, max_ms))
    plain = T.normalise_title(F.coalesce("title", F.lit("")))
    seconds = lambda c: F.rint(F.col(c) / 1_000).cast("bigint").cast("string")
    named = F.when(plain != "", plain).otherwise(F.concat(F.lit("Clip "), seconds("start_ms"), F.lit("-"), seconds("end_ms")))
    return (kept.withColumn("title", named).withColumn("reason", F.left(F.trim(F.coalesce("reason", F.lit(""))), F.lit(300)))
            .withColumn("hook_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score"))))
            .drop("start", "end", "__score"))


def discovery(replies: DataFrame, keys: list[str], min_ms: int = 15_000, max_ms: int = 90_000) -> DataFrame:
    """Candidates inside their search section. Replies carry section_start, section_end and duration_ms."""
    items = (replies.withColumn("__items", F.from_json(leading_array(F.col("raw")), RAW_CLIP))
             .select(*keys, "section_start", "section_end", "duration_ms", F.posexplode("__items").alias("pos", "i"))
             .select(*keys, "section_start", "section_end", "duration_ms", "pos", "i.*"))
    clips = coerce_clips(items, F.col("duration_ms"), min_ms, max_ms)
    return (clips.filter((F.col("start_ms") >= F.col("section_start")) & (F.col("end_ms") <= F.col("section_end")))
            .drop("section_start", "section_end", "duration_ms"))


REVIEW = ("reject BOOLEAN, opening_clear BOOLEAN, payoff_complete BOOLEAN, title_supported BOOLEAN, "
          "opening_context STRING, title STRING, title_evidence STRING, payoff_evidence STRING")


def review(replies: DataFrame, keys: list[str], latin: bool = False) -> DataFrame:
    """Final outcome per clip from up to two attempts.

    Replies carry `excerpt`, the exact words of the cut. An over-long title on
    the first attempt asks for the second; the last attempt made decides.
    """
    r = lambda c: F.col("__r." + c)
    title = T.normalise_title(r("title"))
    checks = ("opening_clear", "payoff_complete", "title_supported")
    denied = F.lit(False)
    confirmed = F.lit(True)
    # Checks go in order: an earlier unconfirmed one fails before a later denial is seen.
    for name in checks:
        denied = denied | (confirmed & F.coalesce(~r(name), F.lit(False)))
        confirmed = confirmed & F.coalesce(r(name), F.lit(False))
    evidence = T.quotes_excerpt(r("title_evidence"), F.col("excerpt")) & T.quotes_excerpt(r("payoff_evidence"), F.col("excerpt"))
    sound = (confirmed & (F.trim(F.coalesce(r("opening_context"), F.lit(""))) != "") & r("title").isNotNull()
             & F.coalesce(evidence, F.lit(False)) & (T.word_count(title) >= T.TITLE_MIN_WORDS))
    outcome = (F.when(F.col("__r").isNull(), "review_failed")
               .when(F.coalesce(r("reject"), F.lit(False)) | denied, "rejected")
               .when(~sound, "review_failed")
               .when(T.title_fits(title, latin), "accepted")
               .when(F.col("attempt") == 1, "title_too_long").otherwise("review_failed"))
    judged = replies.withColumn("__r", F.from_json(flat_object(F.col("raw")), REVIEW)).select(
        *keys, "attempt", outcome.alias("outcome"), title.alias("title"))
    second = F.struct("attempt", "outcome", "title")
    # A second attempt counts only when the first asked for it.
    by_key = judged.groupBy(*keys).agg(
        F.max(F.when(F.col("attempt") == 1, second)).alias("a"), F.max(F.when(F.col("attempt") == 2, second)).alias("b"))
    final = F.when((F.col("a.outcome") == "title_too_long") & F.col("b").isNotNull(), F.col("b")).otherwise(F.col("a"))
    return by_key.withColumn("__f", final).select(
        *keys, F.col("__f.outcome").alias("outcome"),
        F.when(F.col("__f.outcome") == "accepted", F.col("__f.title")).alias("title"))


def refine(replies: DataFrame, context: DataFrame, keys: list[str], min_ms: int = 15_000, max_ms: int = 90_000) -> DataFrame:
    """New clip bounds from picked word numbers, or the old bounds with the reason why not.

    `context`: numbered words (keys, idx, start_ms, end_ms, clip_start, clip_end) as from `context_words`.
    """
    picked = replies.select(*keys, F.from_json(flat_object(F.col("raw")), "reject BOOLEAN, first_word_idx INT, last_word_idx INT").alias("r"))
    rows = context.join(picked, keys, "left")
    at = lambda name, c: F.max(F.when(F.col("idx") == F.col("r." + name), F.col(c)))
    facts = rows.groupBy(*keys).agg(
        F.max("clip_start").alias("clip_start"), F.max("clip_end").alias("clip_end"), F.count("*").alias("n"),
        F.first("r").alias("r"), at("first_word_idx", "start_ms").alias("a"), at("last_word_idx", "end_ms").alias("b"))
    first, last = F.col("r.first_word_idx"), F.col("r.last_word_idx")
    outcome = (F.when(F.col("n") < 8, "sparse_window_fallback")
               .when(F.col("r").isNull(), "failed").when(F.coalesce(F.col("r.reject"), F.lit(False)), "rejected")
               .when(first.isNull() | last.isNull(), "failed")
               .when(~((first >= 0) & (first <= last) & (last < F.col("n"))), "out_of_range")
               .when(~(F.col("b") - F.col("a")).between(min_ms, max_ms), "invalid_duration_fallback")
               .otherwise("picked"))
    taken = F.col("outcome") == "picked"
    return facts.withColumn("outcome", outcome).select(
        *keys, "outcome", F.when(taken, F.col("a")).otherwise(F.col("clip_start")).alias("start_ms"),
        F.when(taken, F.col("b")).otherwise(F.col("clip_end")).alias("end_ms"))


def correction_chunks(words: DataFrame, size: int = 60) -> DataFrame:
    """Number the words of each recording in chunks of `size` (columns chunk, i)."""
    from timedspark.operators.scan import Axis, scan, total
    numbered = scan(words, Axis(("media_id",), ("seq",), 8_192), __n=total(F.lit(1).cast("bigint")))
    return (numbered.withColumn("chunk", F.floor(F.col("__n") / size).cast("bigint"))
            .withColumn("i", (F.col("__n") % size).cast("int")).drop("__n"))


def apply_corrections(words: DataFrame, replies: DataFrame, spelling: bool = True, latin: bool = True) -> tuple[DataFrame, DataFrame]:
    """Corrected words, and (keys, ok) per chunk; a chunk is taken whole or not at all.

    `words`: (media_id, chunk, i, start_ms, end_ms, text, confidence);
    `replies`: (media_id, chunk, raw). The corrections must name every word
    once, in order; each output is one token; a span shared by several tokens
    is split by their length.
    """
    from timedspark.operators.sequence import split_span
    keys = ["media_id", "chunk"]
    kind = "corrections ARRAY<STRUCT<source_indices: ARRAY<INT>, words: ARRAY<STRING>>>"
    exact = F.try_parse_json("raw")
    parsed = replies.select(*keys, F.when(exact.isNotNull(), F.from_json("raw", kind)).alias("r"),
                            F.array_sort(F.json_object_keys("raw")).alias("names"))
    sizes = words.groupBy(*keys).agg(F.count("*").alias("n"))
    named = F.flatten(F.transform("r.corrections", lambda c: c["source_indices"]))
    token = lambda t: t.isNotNull() & (F.trim(t) != "") & (T.word_count(t) == 1)
    single = lambda c: (F.size(c["source_indices"]) == 1) & (F.size(c["words"]) == 1)
    item_ok = lambda c: (c["source_indices"].isNotNull() & (F.size(c["source_indices"]) > 0)
                         & c["words"].isNotNull() & (F.size(c["words"]) > 0) & F.forall(c["words"], token)
                         & (F.lit(spelling) | single(c))
                         & (F.lit(not latin) | F.forall(c["words"], lambda t: T.latin_only(F.coalesce(t, F.lit(""))))))
    whole = ((F.col("names") == F.array(F.lit("corrections"))) & F.forall("r.corrections", item_ok)
             & (named == F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    judged = sizes.join(parsed, keys, "left").withColumn("ok", F.coalesce(whole, F.lit(False)))
    good = judged.filter("ok").select(*keys, F.posexplode("r.corrections").alias("item", "c"))
    sources = good.select(*keys, "item", F.col("c.words").alias("tokens"), F.explode("c.source_indices").alias("i"))
    spans = (sources.join(words, [*keys, "i"]).groupBy(*keys, "item").agg(
        F.first("tokens").alias("tokens"), F.min_by("start_ms", "i").alias("s"), F.max_by("end_ms", "i").alias("e"),
        F.min("confidence").alias("confidence")))
    fixed = spans.select(*keys, "item", "confidence", F.posexplode(split_span(F.col("tokens"), F.col("s"), F.col("e"))).alias("part", "w"))
    return (fixed.select(*keys, "item", "part", "w.start_ms", "w.end_ms", "w.text", "confidence"),
            judged.select(*keys, "n", "ok"))


SHOT_MODES = ("speaker", "audience", "other", "uncertain")


def shot_decisions(requested: DataFrame, replies: DataFrame, keys: list[str], modes: tuple[str, ...] = SHOT_MODES,
                   min_confidence: float = 0.70) -> DataFrame:
    """Mode of every requested shot: a reply counts only if it names exactly the requested shots, all valid.

    Low confidence becomes uncertain; shots of a bad reply keep review_error.
    """
    kind = "shots ARRAY<STRUCT<id: INT, mode: STRING, confidence: DOUBLE, reason: STRING>>"
    parsed = replies.select(*keys, F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), kind)["shots"].alias("shots"))
    entries = parsed.select(*keys, F.explode("shots").alias("s")).select(*keys, "s.*")
    counted = entries.groupBy(*keys, "id").agg(
        F.count("*").alias("n"), F.first("mode").alias("mode"), F.first("confidence").alias("confidence"),
        F.first("reason").alias("reason"))
    both = requested.withColumn("__asked", F.lit(True)).join(counted, [*keys, "id"], "full")
    fine = (F.col("__asked") & (F.col("n") == 1) & F.col("mode").isin(*modes) & F.col("reason").isNotNull()
            & F.col("confidence").between(0, 1))
    batches = both.groupBy(*keys).agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("whole"))
    return (both.filter("__asked").join(batches, keys).select(
        *keys, "id", F.when(F.col("whole") & (F.col("confidence") >= min_confidence), F.col("mode")).otherwise("uncertain").alias("mode"),
        F.when(F.col("whole"), F.col("confidence")).alias("confidence"), (~F.col("whole")).alias("review_error")))


def quotables(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Quoted sentences with usable times; replies carry duration_ms. Overlaps are for `greedy_by_start`."""
    kind = "ARRAY<STRUCT<start: STRING, end: STRING, sentence: STRING>>"
    items = replies.select(*keys, "duration_ms", F.posexplode(F.from_json(lenient_array(F.col("raw")), kind)).alias("seq", "i"))
    number = lambda c: F.expr(f"try_cast(i.{c} AS DOUBLE)")
    rows = items.select(*keys, F.col("seq").cast("bigint").alias("seq"), "duration_ms", to_ms(number("start")).alias("start_ms"),
                        to_ms(number("end")).alias("end_ms"), F.trim("i.sentence").alias("sentence"))
    return rows.filter("end_ms > start_ms AND sentence <> '' AND end_ms <= duration_ms").drop("duration_ms")


def section_scores(replies: DataFrame, sections: DataFrame) -> DataFrame:
    """(clip, position, song_id, section_id, score) from replies that score every section.

    `sections` is numbered by `position`. Only numbers count, and their count
    must equal the number of sections; positions then join as an equi-join.
    """
    found = F.try_parse_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0))
    listed = F.try_variant_get(found, "$.scores", "array<variant>")
    numbers = F.filter(F.transform(listed, lambda v: F.when(
        F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "double"))), lambda v: v.isNotNull())
    n = sections.agg(F.count("*").alias("n_sections"))
    usable = (replies.select("clip", numbers.alias("scores")).withColumn("n", F.size("scores").cast("bigint"))
              .join(n, F.col("n") == F.col("n_sections")))
    return usable.select("clip", F.posexplode("scores").alias("position", "score")).join(sections, "position")


def _padded(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _seconds(name: str) -> Column:
    """Milliseconds as `%7.2f` seconds, by integers: a formatter is slow for every word of every clip."""
    ms = F.col(name)
    cents = F.expr(f"({name} + 5) div 10")
    plain = F.concat(F.expr(f"({name} + 5) div 1000").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(ms >= 0, _padded(plain, 7)).otherwise(F.format_string("%7.2f", ms / 1_000))


def spoken_lines(words: DataFrame) -> DataFrame:
    """Add `spoken`, the prompt line of a word without its number: made once per word, not once per clip that shows it."""
    return words.withColumn("spoken", F.concat(_seconds("start_ms"), F.lit("-"), _seconds("end_ms"), F.lit("  "), F.col("text")))


def context_prompt(context: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered word lines (`idx`, `spoken`) of each clip, as one text."""
    number = F.when(F.col("idx") >= 0, _padded(F.col("idx").cast("string"), 4)).otherwise(F.format_string("%4d", "idx"))
    line = F.concat(F.lit("  ["), number, F.lit("] "), F.col("spoken"))
    rows = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return context.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("prompt"))


def scorecard_prompt(words: DataFrame, keys: list[str], title: str, length: str) -> DataFrame:
    """JSON payload for the clip judge: transcript, opening, first and last sentence."""
    texts = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(cond, F.struct("seq", F.trim("text").alias("t"))))), lambda r: r["t"]), " ")
    facts = words.groupBy(*keys, title, length).agg(
        F.count("*").alias("word_count"), texts(F.lit(True)).alias("transcript"),
        texts((F.col("start_ms") >= 0) & (F.col("start_ms") < 2_000)).alias("opening_2_seconds"))
    payload = F.struct(F.col(title).alias("title"), "transcript", round_exact(F.col(length) / 1_000, 1).alias("duration_seconds"),
                       "word_count", "opening_2_seconds", T.first_sentence(F.col("transcript")).alias("first_sentence"),
                       T.last_sentence(F.col("transcript")).alias("last_sentence"))
    return facts.select(*keys, F.to_json(payload).alias("prompt"))
