"""Readers and sinks over raw documents that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timedspark.operators import clips as C
from timedspark.operators import repeats as Q
from timedspark.operators import store as D
from timedspark.plans import bind
from timedspark.plans.registry import query
from timedspark.sources import manifests as N
from timedspark.sources import sidecars as Y
from timedspark.sources import transcripts as X

BIG = "bigint"


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def turn_segments(spark, sf):
    """Turns as segments with their words; every third turn has none."""
    w = bind.words(spark, sf)
    item = F.struct("pos", "start_ms", "end_ms", "text", F.lit(1.0).alias("confidence"))
    rows = w.groupBy("media_id", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
                                             F.array_sort(F.collect_list(item)).alias("ws"))
    bare = F.transform("ws", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"),
                                                x["confidence"].alias("confidence")))
    text = F.array_join(F.transform("ws", lambda x: x["text"]), " ")
    return rows.select("media_id", F.lit("en").alias("language"), F.col("turn").cast("int").alias("seg"), "start_ms", "end_ms",
                       text.alias("text"), F.when(F.col("turn") % 3 == 2, F.filter(bare, lambda x: F.lit(False))).otherwise(bare).alias("words"))


@query("nested_transcripts")
def nested_transcripts(spark, sf):
    return X.segment_words(X.transcript_segments(X.nested_documents(turn_segments(spark, sf))))


@query("transcript_segments")
def transcript_segments(spark, sf):
    s = X.transcript_segments(X.nested_documents(turn_segments(spark, sf)))
    return s.select("media_id", "language", F.col("seg").cast(BIG).alias("seg"), "start_ms", "end_ms", "text", F.size("words").cast(BIG).alias("n_words"))


@query("flat_words")
def flat_words(spark, sf):
    s = turn_segments(spark, sf).filter("size(words) > 0")
    seconds = F.transform("words", lambda w: F.struct((w["start_ms"] / 1000).alias("start"), (w["end_ms"] / 1000).alias("end"), w["text"].alias("text")))
    docs = s.select(_cat(F.col("media_id").cast("string"), "-", F.col("seg").cast("string")).alias("media_id"), F.to_json(seconds).alias("raw"))
    return X.flat_words(docs)


@query("timestamped_text")
def timestamped_text(spark, sf):
    return X.timestamped_text(turn_segments(spark, sf), seconds=False).select("media_id", F.col("seg").cast(BIG).alias("seg"), "line")


@query("line_transcripts")
def line_transcripts(spark, sf):
    s = bind.segments(spark, sf)
    stamp = F.format_string("[%02d:%05.2f] ", F.floor(F.col("start_ms") / 60_000), F.col("start_ms") % 60_000 / 1_000)
    lines = s.select("media_id", F.col("turn").alias("line_no"), F.when(F.col("turn") == 1, F.lit("# note")).otherwise(F.concat(stamp, "text")).alias("value"))
    return X.timestamped_lines(lines)


@query("song_sections")
def song_sections(spark, sf):
    n = bind.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    section = lambda i: F.struct(F.lit(f"s{i}").alias("id"), (k + i * 1.5).alias("start"), (k + i * 1.5 + 20).alias("end"), F.lit("la").alias("lyrics"),
                                 F.when(k % 2 == 0, "ooh").alias("vocals"), (k % 3 == i).alias("disabled"))
    song = F.struct(k.cast("string").alias("id"), F.col("n_name").alias("title"), F.lit("f.mp3").alias("file"), (k % 7 == 0).alias("disabled"),
                    F.array(section(0), section(1)).alias("sections"))
    raw = n.groupBy(F.col("n_regionkey").alias("library")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(song)).alias("songs"))).alias("raw"))
    return N.enabled_sections(raw).select("library", "song_id", "section_id", "start_ms", "end_ms", "vocals")


def selection_files(spark, sf):
    c = bind.clips(spark, sf)
    item = F.struct((F.col("clip_start") / 1000).alias("start"),
                    F.when((F.col("media_id") % 5 == 1) & (F.col("clip") == 0), (F.col("duration_ms") + 5_000) / 1000).otherwise(F.col("clip_end") / 1000).alias("end"),
                    F.when((F.col("media_id") % 5 == 2) & (F.col("clip") == 0), " ").otherwise(_cat("T", F.col("clip").cast("string"))).alias("title"),
                    (F.col("score") / F.when(F.col("media_id") % 5 == 3, 100).otherwise(1000)).alias("hook_score"))
    files = c.groupBy("media_id").agg(F.max("duration_ms").alias("duration_ms"), F.max("score").alias("top"), F.array_sort(F.collect_list(item)).alias("clips"))
    source = F.when(F.col("media_id") % 5 == 4, "other.mp4").otherwise("video.mp4")
    raw = F.to_json(F.struct(source.alias("source"), "clips"))
    case, score = F.col("media_id") % 20, '"hook_score":[0-9.Ee-]+'
    # Scores that are text, null or absent, and titles that are numbers.
    raw = (F.when(case == 5, F.regexp_replace(raw, score, '"hook_score":"0.5"')).when(case == 10, F.regexp_replace(raw, score, '"hook_score":null'))
           .when(case == 15, F.regexp_replace(raw, '"title":"T([0-9]+)"', '"title":$1')).when(case == 0, F.regexp_replace(raw, "," + score, "")).otherwise(raw))
    return files.select(F.col("media_id").alias("path"), raw.alias("raw"),
                        F.lit("video.mp4").alias("source"), "duration_ms")


@query("selection_verdicts")
def selection_verdicts(spark, sf):
    return N.saved_selections(selection_files(spark, sf))[0]


@query("saved_clips")
def saved_clips(spark, sf):
    return N.saved_selections(selection_files(spark, sf))[1].select("path", "start_ms", "end_ms", "title", F.round("hook_score", 3).alias("hook_score"))


@query("probed_media")
def probed_media(spark, sf):
    p = bind.table(spark, sf, "pages")
    k = F.col("page_id")
    video = _cat('{"codec_type": "video", "codec_name": "h264", "width": ', F.when(k % 5 == 1, "0").otherwise("1920"), ', "height": 1080',
                 F.when(k % 3 == 0, _cat(', "duration": "', k.cast("string"), '.250"')).otherwise(""),
                 ', "avg_frame_rate": "', F.when(k % 7 == 2, "30/0").when(k % 7 == 4, "25").when(k % 7 == 5, "29.97/1").when(k % 7 == 6, "x/1").otherwise("30000/1001"), '"}')
    audio = F.when(k % 2 == 0, ', {"codec_type": "audio"}').otherwise("")
    streams = F.when(k % 11 == 3, '{"codec_type": "data"}').otherwise(F.concat(video, audio))
    raw = _cat('{"streams": [', streams, '], "format": {', F.when(k % 4 == 1, "").otherwise('"duration": "12.5"'), "}}")
    return N.probed_media(p.select(k.alias("path"), raw.alias("raw"))).select("path", "duration_ms", F.round("fps", 4).alias("fps"), "has_audio", "problem")


def responses(spark, sf):
    """Turns as speech responses: spacing, events and faults by turn number."""
    w = bind.words(spark, sf)
    lo = w.groupBy("media_id", "turn").agg(F.min("start_ms").alias("lo"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))
    rows = w.join(lo, ["media_id", "turn"])
    v = F.col("turn") % 5
    s, e = F.col("start_ms") - F.col("lo"), F.col("end_ms") - F.col("lo")
    kind = F.when(F.col("pos") % 10 == 3, "spacing").when(F.col("pos") % 10 == 7, "audio_event").otherwise("word")
    text = F.when(F.col("pos") % 20 == 7, "(laughter)").when(F.col("pos") % 20 == 17, "(door)").otherwise(_cat(" ", F.regexp_replace("text", r'["\\]', "x")))
    stop = F.when((v == 2) & (F.col("pos") == 5), s - 1).otherwise(e)
    number = lambda c: F.concat(F.floor(c / 1000).cast("string"), F.lit("."), F.lpad((F.pmod(c, F.lit(1000))).cast("string"), 3, "0"))
    item = _cat('{"type": "', kind, '", "text": "', text, '", "start": ', number(s), ', "end": ', number(stop),
                F.when(F.col("pos") % 3 == 0, ', "confidence": 0.4').otherwise(""), "}")
    lists = rows.groupBy("media_id", "turn", "duration_ms").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("j")))), lambda x: x["j"]), ", ").alias("items"))
    raw = F.when(F.col("turn") % 5 == 4, F.lit('{"text": "lost", "words": []}')).otherwise(_cat('{"words": [', F.col("items"), '], "text": "t"}'))
    return lists.select((F.col("media_id") * 100 + F.col("turn")).alias("response_id"), "duration_ms", raw.alias("raw"))


@query("speech_verdicts")
def speech_verdicts(spark, sf):
    return X.speech_responses(responses(spark, sf))[0].select("response_id", "accepted")


@query("speech_words")
def speech_words(spark, sf):
    r = X.speech_responses(responses(spark, sf))[1]
    return r.select("response_id", F.col("pos").cast(BIG).alias("pos"), "start_ms", "end_ms", "confidence")


@query("speech_events")
def speech_events(spark, sf):
    r = X.speech_responses(responses(spark, sf))[2]
    return r.select("response_id", F.col("pos").cast(BIG).alias("pos"), "start_ms", "end_ms", "text")


@query("sidecar_verdicts")
def sidecar_verdicts(spark, sf):
    e = bind.table(spark, sf, "events")
    k = F.col("event_id")
    word = F.element_at(F.array(F.lit("PUBLISH"), F.lit("REVIEW"), F.lit("SKIP"), F.lit("MAYBE")), (k % 4 + 1).cast("int"))
    text = _cat("title: A: b ", F.col("event_type"), "\nreason:  why \nnoise\nOverall:  3.5/5  →  ", word, "\n",
                F.when(k % 5 == 0, "").otherwise('Feedback: "ok"'), F.when(k % 7 == 0, "").otherwise("\n"))
    rows = e.select(k.alias("event_id"), text.alias("t"))
    f = Y.sidecar_fields(F.col("t"))
    return rows.select("event_id", F.element_at(f, "title").alias("title"), F.element_at(f, "reason").alias("reason"), Y.verdict(F.col("t")).alias("verdict"))


@query("finished_paths")
def finished_paths(spark, sf):
    e = bind.table(spark, sf, "events")
    k = F.col("event_id")
    line = _cat("[", (k % 9).cast("string"), "/9] Done (", F.when(k % 3 == 0, "publish").when(k % 3 == 1, "skip").otherwise("great"), "): ",
                F.when(k % 5 == 0, "/other/").when(k % 7 == 0, "/data/../etc/").otherwise("/data/"), k.cast("string"), F.when(k % 2 == 0, ".mp4").otherwise(".txt"))
    return Y.finished_paths(e.select(line.alias("message")), "/data")


@query("policy_problems")
def policy_problems(spark, sf):
    """Customers as members of market segments, some of them unknown groups, under a policy with faults."""
    c = bind.table(spark, sf, "customer")
    groups = c.select(F.col("c_mktsegment").alias("group")).distinct().filter("group <> 'FURNITURE'").select(
        "group", F.when(F.col("group") == "BUILDING", 0).otherwise(2).alias("monthly_videos"), F.lit(30).alias("retention_days"),
        (F.col("group") == "MACHINERY").alias("admin"))
    members = c.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("group"))
    return D.policy_problems(groups, members, "MACHINERY")


def _texts(spark, sf):
    clips = bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")
    return clips, C.clip_texts(bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text"), clips)


@query("selection_report")
def selection_report(spark, sf):
    return N.report_markdown(N.selection_report(*_texts(spark, sf)))


@query("caption_sidecars")
def caption_sidecars(spark, sf):
    clips = bind.clips(spark, sf).select("media_id", "clip", "clip_start", "clip_end")
    local = C.clip_words(bind.words(spark, sf).select("media_id", "seq", "start_ms", "end_ms", "text"), clips)
    s = N.caption_sidecars(local.select("media_id", "clip", "seq", "start_ms", "end_ms", "text"), clips)
    return s.select("media_id", "clip", F.size("words").cast(BIG).alias("n_words"), F.element_at("words", 1)["text"].alias("first"),
                    F.element_at("words", -1)["end_ms"].alias("last_ms"))


@query("source_limit")
def source_limit(spark, sf):
    return X.within_source_limit(bind.words(spark, sf), 60_000).select("media_id", "seq")


@query("extraction_bounds")
def extraction_bounds(spark, sf):
    return X.extraction_bounds(bind.clips(spark, sf)).select("media_id", "clip", "source_start", "source_end")


@query("trailer_words")
def trailer_words(spark, sf):
    w = bind.words(spark, sf).select("media_id", "seq", (F.col("start_ms") - 5_000).alias("start_ms"), (F.col("end_ms") - 5_000).alias("end_ms"))
    return X.trailer_words(w, F.lit(30_000).cast(BIG))


@query("repeated_lines")
def repeated_lines(spark, sf):
    """Lines said more than once in a document, spaces and case aside."""
    d = bind.table(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    norm = F.lower(F.trim(F.regexp_replace("line", r"[ \t]+", " ")))
    rows = lines.select("media_id", F.col("seq").cast(BIG).alias("seq"), norm.alias("norm")).filter(F.size(F.split("norm", " ")) >= 3)
    return Q.repeated_lines(rows)


def sung_lines(spark, sf):
    """Names of 400 parts in a row make one recording, so recordings grow in number with the table."""
    p = bind.table(spark, sf, "part")
    return p.select(F.floor(F.col("p_partkey") / 400).cast(BIG).alias("media_id"), F.col("p_partkey").alias("seq"),
                    F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


@query("line_clusters")
def line_clusters(spark, sf):
    return Q.line_clusters(sung_lines(spark, sf)).select("media_id", "norm", "leader", "n")


@query("refrains")
def refrains(spark, sf):
    return Q.refrains(sung_lines(spark, sf))


@query("phrase_onsets")
def phrase_onsets(spark, sf):
    """Where the first three words of each second turn are said best."""
    from timedspark.functions.text import skeleton
    w = bind.words(spark, sf).select("media_id", "turn", "pos", "seq", "start_ms", "text")
    heads = w.filter("turn = 1 AND pos < 3").groupBy("media_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("t"))
    phrases = heads.select("media_id", skeleton("t").alias("phrase"))
    return Q.locate_phrase(w.select("media_id", "seq", "start_ms", "text"), phrases, 3).select("media_id", "seq", "start_ms", F.round("ratio", 6).alias("ratio"))
