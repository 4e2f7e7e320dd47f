"""Files written and read back, and store operators on small tables."""

import json

from pyspark.sql import functions as F

from timedspark.operators import store as D
from timedspark.sources import manifests as N
from timedspark.sources import sidecars as Y
from timedspark.sources import transcripts as X


def test_transcript_file_round_trip(spark, tmp_path):
    doc = {"language": "en", "segments": [{"start": 0.0, "end": 1.5, "text": "hi there", "words": [
        {"start": 0.0, "end": 0.5, "text": "hi", "confidence": 0.5}, {"start": 0.7, "end": 1.5, "text": "there"}]}, {"start": 2, "end": 3, "text": "bare"}]}
    (tmp_path / "talk.json").write_text(json.dumps(doc))
    segments = X.transcript_segments(X.read_documents(spark, str(tmp_path / "*.json")))
    assert [(r.media_id, r.seg, r.start_ms, len(r.words)) for r in segments.orderBy("seg").collect()] == [("talk", 0, 0, 2), ("talk", 1, 2000, 0)]
    words = X.segment_words(segments).orderBy("seq").collect()
    assert [(w.start_ms, w.end_ms, w.text, w.confidence) for w in words] == [(0, 500, "hi", 0.5), (700, 1500, "there", 1.0)]
    X.write_segments(segments.drop("words"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sidecar_files(spark, tmp_path, table):
    clips = table([("m", 0, 1_500, "T: x", "why", 0.9, 61_234)], "media_id STRING, clip BIGINT, start_ms BIGINT, title STRING, reason STRING, hook_score DOUBLE, end_ms BIGINT")
    Y.write_sidecars(clips, str(tmp_path / "side"))
    rows = Y.read_sidecars(spark, str(tmp_path / "side" / "*" / "*.txt")).collect()
    assert rows[0].fields == {"title": "T: x", "reason": "why", "source_start": "1.50", "source_end": "61.23", "hook_score": "0.90"}
    assert rows[0].verdict is None


def test_receipts_append(spark, tmp_path, table):
    path = str(tmp_path / "usage")
    rows = table([("a", 60.0, {"tokens": "5"})], "model STRING, seconds DOUBLE, usage MAP<STRING,STRING>")
    N.append_receipts(rows, path)
    N.append_receipts(rows, path)
    assert N.read_receipts(spark, path).filter("usage['tokens'] = '5'").count() == 2


def test_caption_and_report_sinks(spark, tmp_path, table):
    words = table([("m", 0, 1, 5, 9, "b"), ("m", 0, 0, 0, 4, "a")], "media_id STRING, clip BIGINT, seq BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING")
    clips = table([("m", 0, 100, 200)], "media_id STRING, clip BIGINT, clip_start BIGINT, clip_end BIGINT")
    N.write_captions(N.caption_sidecars(words, clips), str(tmp_path / "cap"))
    assert [w.text for w in spark.read.json(str(tmp_path / "cap")).first().words] == ["a", "b"]
    texts = table([("m", 0, 2, "a", "b", "a b")], "media_id STRING, clip BIGINT, n_words BIGINT, opening STRING, ending STRING, excerpt STRING")
    N.write_report(N.selection_report(clips, texts), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "json")).first().transcript == "a b"


def test_store_tables(spark, tmp_path, table):
    table([("j", 1)], "id STRING, n INT").write.parquet(str(tmp_path / "jobs"))
    assert N.read_store(spark, str(tmp_path), "jobs").count() == 1


def test_upload_completeness(table):
    uploads = table([(1, 64_000_001), (2, 64_000_001), (3, 1)], "job_id INT, size BIGINT")
    chunks = table([(1, 2, 1), (1, 0, 5), (1, 1, 5), (1, 1, 5), (2, 0, 5), (2, 2, 1)], "job_id INT, chunk_index BIGINT, chunk_bytes BIGINT")
    got = {r.job_id: (r.complete, r.total_chunks) for r in D.upload_status(uploads, chunks).collect()}
    assert got == {1: (True, 3), 2: (False, 3), 3: (False, 1)}


def test_policy(table):
    groups = table([("free", 1, 30, False), ("plus", None, None, False)], "group STRING, monthly_videos INT, retention_days INT, admin BOOLEAN")
    good = table([("u", "plus")], "user_id STRING, group STRING")
    assert D.policy_problems(groups, good, "free").count() == 0
    bad = table([("u", "nobody"), (" ", "free")], "user_id STRING, group STRING")
    assert {r.problem for r in D.policy_problems(groups, bad, "missing").collect()} == {"unknown group", "blank user", "bad default group"}


def test_probe_problems(table):
    def probe(**video):
        return json.dumps({"streams": [{"codec_type": "video", "width": 10, "height": 10, "avg_frame_rate": "30/1", "duration": "2.5", **video}, {"codec_type": "audio"}]})
    df = table([("ok", probe()), ("fps", probe(avg_frame_rate="30/0")), ("none", '{"streams": []}')], "path STRING, raw STRING")
    got = {r.path: r for r in N.probed_media(df).collect()}
    assert got["ok"].problem is None and got["ok"].fps == 30.0 and got["ok"].duration_ms == 2_500 and got["ok"].has_audio
    assert got["fps"].problem == "bad frame rate" and got["none"].problem == "no video stream"


def test_word_times_of_long_turns(spark, monkeypatch):
    """Times run on over the pieces of a turn and over turns; words become rows only when all is added up."""
    from timedspark.plans import bind
    turns = [(1, t, "user", " ".join("w" * (1 + (i * 7 + t) % 9) for i in range(n)) + "\t") for t, n in enumerate((1, 127, 128, 129, 0, 1_000))] + [(2, 7, "user", " a\nbb "), (3, 0, "user", None)]
    monkeypatch.setattr(bind, "table", lambda *_: spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    found = bind._timed_words(spark, "")
    want, at, of = [], 0, None
    for media, turn, role, text in turns:
        at, of = (0 if media != of else at), media
        for pos, word in enumerate((text or "").split()):
            start = at + (bind.TURN_GAP if pos == 0 else 40 + 170 * (pos % 7))
            at = start + len(word) * 80 + 60
            want.append((media, turn, pos, (turn << 32) + pos, role, start, at, word))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found.columns == ["media_id", "turn", "pos", "seq", "role", "start_ms", "end_ms", "text"] and dict(found.dtypes)["pos"] == "bigint"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
