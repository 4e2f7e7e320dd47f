"""Reply gates, scoring and text rules over the driver tables.

The driver tables hold no model replies, so each query writes raw replies
from table columns (with good, damaged and tricky variants) and parses them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timedspark.functions import text as T
from timedspark.operators import clips as C
from timedspark.operators import replies as M
from timedspark.operators import scoring as A
from timedspark.operators import selection as K
from timedspark.operators.frames import boxes_per_frame, largest_box
from timedspark.operators.stage import stage
from timedspark.plans import bind
from timedspark.plans.frame_queries import face_boxes, numbered_boxes
from timedspark.plans.registry import query
from timedspark.plans.sequence_queries import frame_counts

BIG = "bigint"


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _decimal(ms):
    return F.concat((ms - ms % 1000).cast("string").substr(F.lit(1), F.greatest(F.char_length((ms - ms % 1000).cast("string")) - 3, F.lit(0))),
                    F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def discovery_replies(spark, sf):
    e = bind.table(spark, sf, "events")
    k = F.col("event_id")
    s = 1_000 + k * 1_237 % 700_000
    end = s + 10_000 + k * 7 % 90 * 1_000
    v = k % 9
    score = F.concat(F.floor(k % 130 / 100).cast("string"), F.lit("."), F.lpad((k % 130 % 100).cast("string"), 2, "0"))
    title = F.when(v == 2, F.lit("")).otherwise(_cat(', "title": "  Big   idea ', k.cast("string"), '!! "'))
    hook = F.when(v == 3, F.lit("")).when(v == 4, F.lit(', "hook_score": "high"')).otherwise(_cat(', "hook_score": ', score))
    start = F.when(v == 5, _cat('"', _decimal(s), '"')).otherwise(_decimal(s))
    stop = F.when(v == 6, _decimal(s - 500)).otherwise(_decimal(end))
    item = _cat('{"start": ', start, ', "end": ', stop, title, hook, ', "reason": " ok "}')
    raw = (F.when(v == 0, _cat("Sure!\n```json\n[", item, "]\n``` done"))
           .when(v == 1, _cat("Found: [", item, "] and [that] is all"))
           .when(v == 7, _cat("[", item, ", ", item, "]")).when(v == 8, _cat("[", item, ", {"))
           .otherwise(_cat("[", item, "]")))
    return e.select("event_id", raw.alias("raw"), F.lit(0).cast(BIG).alias("section_start"),
                    F.lit(600_000).cast(BIG).alias("section_end"), F.lit(650_000).cast(BIG).alias("duration_ms"))


@query("discovery")
def discovery(spark, sf):
    found = M.discovery(discovery_replies(spark, sf), ["event_id"])
    return found.select("event_id", F.col("pos").cast(BIG).alias("pos"), "start_ms", "end_ms", "title", "reason",
                        F.round("hook_score", 2).alias("hook_score"))


def review_replies(spark, sf):
    texts = C.clip_texts(bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text"),
                         bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end"))
    clean = texts.filter("excerpt <> ''").select("media_id", "clip", F.regexp_replace("excerpt", r'["\\{}]', "").alias("excerpt"))
    tries = clean.withColumn("v", (F.col("media_id") * 7 + F.col("clip")) % 8).withColumn(
        "attempt", F.explode(F.when(F.col("v") == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    v, first = F.col("v"), lambda n: F.array_join(F.slice(F.split("excerpt", " "), 1, n), " ")
    title = F.when(v == 6, first(2)).when((v == 5) & (F.col("attempt") == 1), first(9)).otherwise(first(4))
    proof = F.when(v == 3, F.lit("never said by anyone")).otherwise(first(3))
    body = _cat('{"reject": ', F.when(v == 0, "true").otherwise("false"), ', "opening_clear": ', F.when(v == 1, "false").otherwise("true"),
                F.when(v == 2, "").otherwise(', "payoff_complete": true'), ', "title_supported": true, "opening_context": "who",',
                ' "title": "', title, ' .", "title_evidence": "', proof, '", "payoff_evidence": "', first(2), '"}')
    raw = F.when(v == 7, F.lit("I cannot do that")).when(v == 4, _cat("Review: ", body, " Bye")).otherwise(body)
    return tries.select("media_id", "clip", "attempt", "excerpt", raw.alias("raw"))


@query("review_gate")
def review_gate(spark, sf):
    return M.review(review_replies(spark, sf), ["media_id", "clip"])


@query("refine_gate")
def refine_gate(spark, sf):
    context = stage(C.context_words(bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text"),
                                    bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")))
    sizes = context.groupBy("media_id", "clip").agg(F.count("*").alias("n"))
    v = F.col("clip") % 6
    first, last = (F.col("clip") % 5).cast("string"), (F.col("n") - 1 - F.col("clip") % 7).cast("string")
    raw = (F.when(v == 1, _cat('{"first_word_idx": ', first, ', "last_word_idx": 99999}'))
           .when(v == 2, _cat('{"first_word_idx": "', first, '", "last_word_idx": ', last, "}"))
           .when(v == 3, F.lit('{"reject": true}')).when(v == 4, F.lit("no idea"))
           .otherwise(_cat('{"first_word_idx": ', first, ', "last_word_idx": ', last, "}")))
    return M.refine(sizes.select("media_id", "clip", raw.alias("raw")), context, ["media_id", "clip"])


def correction_tables(spark, sf):
    w = bind.words(spark, sf).withColumn("confidence", F.lit(1.0) - F.col("pos") % 5 / 10)
    chunked = stage(M.correction_chunks(w.select("media_id", "seq", "start_ms", "end_ms", "text", "confidence")))
    v = F.col("chunk") % 4
    one = F.struct(F.array("i").alias("source_indices"), F.array("text").alias("words"))
    merged = F.struct(F.array(F.lit(0), F.lit(1)).alias("source_indices"), F.array(F.lit("joined")).alias("words"))
    split = F.struct(F.array(F.lit(0)).alias("source_indices"), F.array(F.lit("two"), F.lit("halves")).alias("words"))
    item = (F.when((v == 1) & (F.col("i") == 0), merged).when((v == 1) & (F.col("i") == 1), F.lit(None))
            .when((v == 2) & (F.col("i") == 0), split).when((v == 3) & (F.col("i") == 1), F.lit(None)).otherwise(one))
    entries = F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct("i", item.alias("c")))))
    replies = chunked.groupBy("media_id", "chunk").agg(
        F.to_json(F.struct(F.transform(entries, lambda x: x["c"]).alias("corrections"))).alias("raw"))
    return chunked, replies


@query("corrections")
def corrections(spark, sf):
    fixed, _ = M.apply_corrections(*correction_tables(spark, sf), latin=False)
    return fixed.select("media_id", "chunk", F.col("item").cast(BIG).alias("item"), F.col("part").cast(BIG).alias("part"),
                        "start_ms", "end_ms", "text", F.round("confidence", 2).alias("confidence"))


@query("correction_chunks")
def correction_chunks(spark, sf):
    _, judged = M.apply_corrections(*correction_tables(spark, sf), latin=False)
    return judged


@query("shot_decisions")
def shot_decisions(spark, sf):
    s = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("media_id"))
    requested = s.withColumn("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    v, m = F.col("media_id") % 6, F.col("media_id")
    entry = lambda i, mode, conf: _cat('{"id": ', str(i), ', "mode": "', mode, '", "confidence": ', conf, ', "reason": "r"}')
    conf = F.concat(F.lit("0."), F.lpad((m % 100).cast("string"), 2, "0"))
    raw = _cat('Here {"shots": [', entry(0, "speaker", conf), ", ",
               entry(1, F.when(v == 1, "wide").otherwise("audience"), F.when(v == 2, "1.5").otherwise("0.8")), ", ",
               F.when(v == 3, entry(1, "other", "0.9")).when(v == 4, entry(7, "other", "0.9")).otherwise(entry(2, "other", "0.71")),
               F.when(v == 5, "]").otherwise("]}"))
    return M.shot_decisions(requested, s.select("media_id", raw.alias("raw")), ["media_id"])


def scorecard_replies(spark, sf, dims):
    lab = bind.table(spark, sf, "labels")
    d, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    v = d % 7
    level = lambda i: (1 + (d * (i + 3) + q * 3 - t) % 5).cast("string")
    parts = []
    for i, name in enumerate(dims):
        whole = _cat(f'"{name}": {{"score": ', level(i), ', "reasoning": "because"}, ')
        parts.append(F.when(v == 1, _cat(f'"{name}": ', level(i), ", ")).when((v == 2) & F.lit(i == 1), F.lit("")).otherwise(whole))
    overall = F.when(v == 3, F.lit('"overall": 4.5, ')).otherwise(F.lit(""))
    verdict = F.when(v == 4, F.lit('"verdict": "publish", ')).when(v == 0, F.lit('"verdict": "great", ')).when(v == 1, F.lit('"verdict": "??", ')).otherwise(F.lit('"verdict": "?", '))
    body = _cat("{", *parts, overall, verdict, '"one_line_feedback": "fine"}')
    raw = F.when(v == 5, F.lit("nothing here")).when(v == 6, _cat("```json\n", body, "\n```")).otherwise(_cat("Result: ", body, " ok"))
    text = F.when(d % 11 == 0, F.lit(" ")).otherwise(F.lit("some words"))
    return lab.select("doc_id", "quality", raw.alias("raw"), text.alias("transcript"))


@query("scorecard")
def scorecard(spark, sf):
    card = A.parse_scorecard(scorecard_replies(spark, sf, A.DIMENSIONS))
    tech = 0.5 + F.col("quality") * 0.25
    return card.select("doc_id", *A.DIMENSIONS, "overall", "verdict", "feedback",
                       A.final_score(tech, F.col("content_mean")).alias("final_score"))


@query("trailer_scorecard")
def trailer_scorecard(spark, sf):
    card = A.parse_scorecard(scorecard_replies(spark, sf, A.TRAILER_AXES), A.TRAILER_AXES)
    return card.select("doc_id", *A.TRAILER_AXES, "overall", "verdict", "feedback")


@query("tech_metrics")
def tech_metrics(spark, sf):
    """Frames of supplier n and the words of conversation n stand for one clip."""
    best = largest_box(bind.detections(spark, sf)).select("media_id", "frame", (F.col("x") + F.col("w") / 2).alias("x_center"))
    faces = face_boxes(spark, sf).select("media_id", "frame").distinct().withColumn("face", F.lit(True))
    frames = (frame_counts(spark, sf).join(best, ["media_id", "frame"], "left").join(faces, ["media_id", "frame"], "left")
              .withColumn("face", F.coalesce("face", F.lit(False))).withColumn("person", F.col("n") > 0))
    m = A.frame_metrics(frames, ("media_id",), 1_920)
    clips = bind.durations(spark, sf).select("media_id", F.col("duration_ms").alias("length_ms"))
    words = bind.words(spark, sf).join(clips, "media_id").filter("end_ms <= length_ms").select("media_id", "start_ms", "end_ms")
    both = A.word_metrics(words, clips, ["media_id"]).join(m, "media_id")
    score = A.tech_score(F.col("face_visibility"), F.col("crop_stability"), F.col("speaker_coverage"), F.col("length_ms") / 1_000,
                         F.col("words_per_second"), F.col("subtitle_coverage"))
    names = ("face_visibility", "crop_stability", "speaker_coverage", "words_per_second", "subtitle_coverage")
    return both.select("media_id", *[F.round(n, 6).alias(n) for n in names], F.round(score, 6).alias("score"))


@query("quotables")
def quotables(spark, sf):
    e = bind.table(spark, sf, "events")
    k = F.col("event_id")
    one = lambda s, length, text: _cat('{"start": ', s.cast("string"), ', "end": ', (s + length).cast("string"), ', "sentence": "', text, '"}')
    base = k * 13 % 500
    raw = _cat("Picks: [", one(base + 20, 9, "later words"), ", ", one(base, k % 12, " first words "), ", ",
               one(base + 5, 10, F.when(k % 3 == 0, " ").otherwise("middle")), "] end")
    replies = e.select(k.alias("media_id"), raw.alias("raw"), F.lit(520_000).cast(BIG).alias("duration_ms"))
    picks = M.quotables(replies, ["media_id"])
    return K.greedy_by_start(picks).select("media_id", "seq", "start_ms", "end_ms", "sentence")


@query("section_choice")
def section_choice(spark, sf):
    """Sections of a small song library are scored for every order; the best above 5 wins."""
    sections = bind.table(spark, sf, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_regionkey").alias("song_id"),
                                                      F.col("n_name").alias("section_id"))
    o = bind.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    n = F.when(k % 5 == 0, 24).otherwise(25)
    scores = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((k * 7 + i * 31) % (2 + k % 9)).cast("string")), ", ")
    raw = F.when(k % 7 == 0, F.lit("none fit")).otherwise(_cat('I think {"scores": [', scores, F.when(k % 3 == 0, ', "x"').otherwise(""), "]}"))
    scored = M.section_scores(o.select(k.alias("clip"), raw.alias("raw")), sections)
    best = K.best_section(scored)
    return best.join(sections, "position").select("clip", F.col("position").cast(BIG).alias("position"), "score", "section_id")


@query("context_prompts")
def context_prompts(spark, sf):
    context = C.context_words(M.spoken_lines(bind.words(spark, sf)).select("media_id", "seq", "start_ms", "spoken"),
                              bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end"))
    return M.context_prompt(context, ["media_id", "clip"])


@query("scorecard_prompts")
def scorecard_prompts(spark, sf):
    clips = bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")
    words = C.clip_words(bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text"), clips)
    titled = words.withColumn("title", _cat("Clip ", F.col("clip").cast("string"))).withColumn("length", F.col("clip_end") - F.col("clip_start"))
    p = M.scorecard_prompt(titled, ["media_id", "clip"], "title", "length")
    get = lambda f: F.get_json_object("prompt", f"$.{f}")
    return p.select("media_id", "clip", get("title").alias("title"), get("word_count").cast(BIG).alias("word_count"),
                    get("duration_seconds").cast("double").alias("duration_seconds"), get("opening_2_seconds").alias("opening"),
                    get("first_sentence").alias("first_sentence"), get("last_sentence").alias("last_sentence"))


@query("timestamped_lines")
def timestamped_lines(spark, sf):
    s = bind.segments(spark, sf)
    return s.select("media_id", "turn", T.segment_line(F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("line"),
                    T.clock_hundredths(F.col("start_ms")).alias("at"))


def turns(spark, sf):
    w = bind.segments(spark, sf)
    return w.select("media_id", F.concat(F.lit("SPEAKER_0"), (F.col("turn") % 3).cast("string")).alias("speaker_id"), "start_ms", "end_ms")


@query("speaker_share")
def speaker_share(spark, sf):
    return A.speaker_share(turns(spark, sf))


@query("longest_turn")
def longest_turn(spark, sf):
    return A.longest_turn(turns(spark, sf))


@query("main_language")
def main_language(spark, sf):
    d = bind.table(spark, sf, "documents")
    return A.main_language(d.select(F.floor(F.col("doc_id") / 10).cast(BIG).alias("media_id"), (F.col("doc_id") % 10).alias("idx"),
                                    F.col("lang").alias("language"), F.col("n_chars").alias("n_words")))


@query("densest_pass")
def densest_pass(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    passes = (li.groupBy(F.col("l_orderkey").alias("media_id"), (F.col("l_linenumber") - 1).alias("pass"))
              .agg(F.sum(F.col("l_quantity").cast(BIG)).alias("n_words"))
              .withColumn("duration_ms", (F.col("media_id") % 40 * 1_000).cast(BIG)).withColumn("forced", F.col("media_id") % 13 == 0))
    return A.densest_pass(passes)


@query("usage_report")
def usage_report(spark, sf):
    o = bind.table(spark, sf, "orders")
    r = A.usage_report(o.select(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").cast("int").alias("day"),
                                F.round(F.col("o_totalprice") * 100).cast(BIG).alias("cost_usd"),
                                F.col("o_custkey").alias("seconds"), (F.col("o_orderkey") % 9_973).alias("elapsed_seconds")))
    return r.withColumn("cost_per_hour", F.round("cost_per_hour", 4)).withColumnRenamed("day", "year")


@query("stored_receipts")
def stored_receipts(spark, sf):
    """Receipts of two halves of the orders, appended as JSON lines one after the other, read back and rolled up."""
    from timedspark.sources import manifests as M
    from timedspark.streaming.run import new_folder
    o = bind.table(spark, sf, "orders")
    path, usage = new_folder(spark, "receipts"), F.create_map(F.lit("seconds"), F.col("o_custkey").cast("string"))
    receipts = o.select("o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_custkey").cast("double").alias("seconds"), F.col("o_totalprice").cast("decimal(18,8)").alias("cost_usd"),
                        usage.alias("usage"), F.col("o_orderkey").cast("string").alias("generation_id"), (F.col("o_orderkey") % 9_973).cast("double").alias("elapsed_seconds"),
                        F.col("o_orderdate").cast("timestamp").alias("received_at"))
    for half in (0, 1):
        M.append_receipts(receipts.filter(F.col("o_orderkey") % 2 == half).drop("o_orderkey"), path)
    report = A.usage_report(M.read_receipts(spark, path).withColumn("day", F.year("received_at")))
    whole = lambda c, times=1: F.round(F.col(c) * times).cast(BIG).alias(c)
    return report.select("model", F.col("day").alias("year"), "level", "requests", whole("cost_usd", 100), whole("seconds"), whole("fastest"), whole("slowest"))


@query("judge_agreement")
def judge_agreement(spark, sf):
    lab = bind.table(spark, sf, "labels")
    rows = lab.select((F.col("quality") + F.col("doc_id") % 3).alias("human_quality"), (F.col("quality") * 2).alias("model_quality"),
                      (F.col("toxic") * 3 + F.col("doc_id") % 2).alias("human_toxic"), F.col("toxic").alias("model_toxic"))
    r = A.judge_agreement(rows, ("quality", "toxic"))
    return r.withColumn("correlation", F.round("correlation", 6))


@query("timing_problems")
def timing_problems(spark, sf):
    w = bind.words(spark, sf).select("media_id", "seq", F.when(F.col("pos") % 23 == 5, None).otherwise(F.col("start_ms")).alias("start_ms"),
                                     F.when(F.col("pos") % 29 == 7, F.col("start_ms") - 1).otherwise(F.col("end_ms")).alias("end_ms"))
    late = w.withColumn("start_ms", F.when(F.col("seq") % 31 == 4, F.greatest(F.col("start_ms") - 2_000, F.lit(0))).otherwise(F.col("start_ms")))
    return A.timing_problems(late, F.lit(600_000))


@query("titles")
def titles(spark, sf):
    """Title and sentence rules on every line of every document."""
    d = bind.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    title = T.normalise_title(F.col("text"))
    return d.select("doc_id", "line", title.alias("title"), T.title_fits(title).alias("fits"), T.word_count(title).cast(BIG).alias("n_words"),
                    T.first_sentence(F.col("text")).alias("first_sentence"), T.last_sentence(F.col("text")).alias("last_sentence"))


@query("slugs")
def slugs(spark, sf):
    p = bind.table(spark, sf, "part")
    name = F.concat_ws("  ", F.col("p_name"), F.lit("& "), F.col("p_brand"), F.lit("_"), F.col("p_type"))
    return p.select("p_partkey", T.slug(name).alias("slug"))


@query("video_links")
def video_links(spark, sf):
    """Page links under the same rules as video links: listed hosts and an identifier of a fixed form."""
    p = bind.table(spark, sf, "pages")
    ident = F.lpad((F.col("page_id") * 7_919).cast("string"), 11, "a")
    v = F.col("page_id") % 8
    url = (F.when(v == 0, _cat("https://www.youtube.com/watch?list=1&v=", ident)).when(v == 1, _cat(" https://youtu.be/", ident, "?t=3 "))
           .when(v == 2, _cat("https://m.youtube.com/shorts/", ident, "/")).when(v == 3, _cat("http://youtu.be/", ident))
           .when(v == 4, _cat("https://user@youtube.com/watch?v=", ident)).when(v == 5, _cat("https://youtube.com:443/embed/", ident))
           .when(v == 6, _cat("https://youtube.com/watch?v=", ident, "x")).otherwise(F.col("url")))
    return p.select("page_id", T.video_id(url).alias("video"))


@query("hashtags")
def hashtags(spark, sf):
    d = bind.table(spark, sf, "documents")
    tagged = d.select("doc_id", "text", T.clean_tags(F.split("text", " ")).alias("clean"))
    return tagged.select("doc_id", F.array_join("clean", " ").alias("tags"),
                         F.char_length(T.caption_with_tags(F.col("text"), F.col("clean"))).cast(BIG).alias("caption_chars"))


@query("danda_words")
def danda_words(spark, sf):
    """Turns as captions: danda signs are put after every ninth word; every fifth caption holds Devanagari."""
    w = bind.words(spark, sf)
    text = F.when((F.col("turn") % 5 == 0) & (F.col("pos") == 1), F.lit("नमस्ते।")).when(F.col("pos") % 9 == 0, F.concat("text", F.lit("।"))).otherwise(F.col("text"))
    rows = w.select("media_id", "turn", "seq", text.alias("text"))
    per = rows.groupBy("media_id", "turn").agg((F.bool_and(T.latin_only(F.col("text"))) & F.bool_or(T.has_letters(F.col("text")))).alias("latin"))
    fixed = rows.join(per, ["media_id", "turn"]).select("media_id", "seq", "text", T.romanise_danda(F.col("text"), F.col("latin")).alias("fixed"))
    return fixed.filter(F.contains("text", F.lit("।"))).select("media_id", "seq", "fixed")


@query("scored_prompts")
def scored_prompts(spark, sf):
    """A deterministic scorer over prompts; real scorers plug in the same way."""
    context = C.context_words(M.spoken_lines(bind.words(spark, sf)).select("media_id", "seq", "start_ms", "spoken"),
                              bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end"))
    prompts = M.context_prompt(context, ["media_id", "clip"]).select(
        F.concat_ws("-", F.col("media_id").cast("string"), F.col("clip").cast("string")).alias("key"), F.lit("count").alias("system_prompt"),
        F.col("prompt").alias("user_prompt"))
    return M.score_with(prompts, lambda system, user: f"{system} {len(user.splitlines())}")


@query("latest_replies")
def latest_replies(spark, sf):
    """Event types as attempts per user: the last attempt with text and without an error."""
    e = bind.table(spark, sf, "events")
    tries = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("raw"))
    return M.latest_good(tries, ["key"], F.col("raw") != "error")
