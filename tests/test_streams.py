"""Streams that must not lose rows or keep state for ever."""

from pyspark.sql import functions as F

from timedspark.streaming import run as S
from timedspark.streaming import keyed as K
from timedspark.streaming import windows as W


def recordings(spark, ended=False):
    rows = [(m, 1_000 * k, 1_000 * k + 900, m * 10_000 + k, 1_704_067_200 + m, False) for m in (1, 2) for k in range(300)]
    rows += [(m, 400_000, 400_000, m * 10_000 + 999, 1_704_067_200 + m, True) for m in (1, 2)] if ended else []
    return spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long, place long, s long, ended boolean").withColumn("arrived", F.timestamp_seconds("s"))


def test_a_second_recording_is_not_late(spark):
    feed = S.Feed(recordings(spark), "density", "place", parts=4)
    rows = S.run_upserts(feed, W.speech_density(feed.stream()), ["media_id", "start_ms", "arrived"], "density")
    per = {r["media_id"]: (r["n"], r["words"]) for r in rows.groupBy("media_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()}
    assert per == {1: (101, 600), 2: (101, 600)}


def test_a_running_aggregate_is_worked_out_once_per_batch(spark, monkeypatch):
    """The merge reads its rows several times; it must not run the stateful plan of the batch for each."""
    plans, merge = [], S.merge_stored
    monkeypatch.setattr(S, "merge_stored", lambda path, rows, *rest: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), merge(path, rows, *rest)))
    feed = S.Feed(recordings(spark), "once", "place", parts=2)
    S.run_upserts(feed, W.speech_density(feed.stream()), ["media_id", "start_ms", "arrived"], "once")
    assert plans and not any("StateStore" in p for p in plans)


def test_sessions_end_with_their_recording(spark):
    feed = S.Feed(recordings(spark, ended=True), "sessions", "place", parts=4)
    rows = S.run_carried(feed, feed.stream(), W.word_sessions, W.OPEN_SESSION, "sessions").orderBy("media_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 299_900, 300), (2, 0, 299_900, 300)]


def test_a_pause_must_exceed_the_gap(spark):
    """700 ms join and 701 ms part, within a batch, over batches and over blocks of the scan; an open session waits."""
    starts = [0, 800, 1_601, 600_000, 600_800, 601_601]
    rows = [(9, s, s + 100, k, False) for k, s in enumerate(starts)] + [(8, 5, 10, 3, False)]
    frame = spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long, place long, ended boolean")
    for parts in (1, 4):
        feed = S.Feed(frame, "gaps", "place", parts=parts)
        out = S.run_carried(feed, feed.stream(), W.word_sessions, W.OPEN_SESSION, "gaps").orderBy("start_ms").collect()
        assert [tuple(r) for r in out] == [(9, 0, 900, 2), (9, 1_601, 1_701, 1), (9, 600_000, 600_900, 2)]


def keyed(feed, stream, name, rounds=None):
    """Rows of a stream run round by round, and the number of state rows at the end of each."""
    target, kept = S.new_folder(stream.sparkSession, name), []
    with S.settings(stream.sparkSession, S.KEYED_STORE):
        while True:
            query = (stream.writeStream.outputMode("append").format("parquet").option("path", target)
                     .option("checkpointLocation", target + "-state").trigger(availableNow=True).start())
            assert query.awaitTermination(180)
            kept.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
            if feed.pushed == feed.parts:
                return [tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(target).collect()], kept
            feed.push()


HOUR, T0 = 3_600_000, 1_704_067_200_000


def beats(spark, rows, name, parts):
    feed = S.Feed(spark.createDataFrame([(owner, T0 + at) for owner, at in rows], "owner long, at_ms long"), name, "at_ms", parts=parts)
    found, kept = keyed(feed, K.stale_owners(feed.stream(), 6 * HOUR), name)
    return sorted((owner, last - T0, stale - T0) for owner, last, stale in found), kept


def test_an_owner_is_reported_without_a_row_of_its_own(spark):
    """Owner 1 falls silent after hour 1; only owner 2 is heard of later, and the query restarts in between."""
    rows = [(1, 0), (1, HOUR)] + [(2, k * HOUR) for k in range(12)]
    found, kept = beats(spark, rows, "silent", 3)
    assert found == [(1, HOUR, 7 * HOUR)]
    assert kept[-1] < kept[0]  # what owner 1 had is gone


def test_a_beat_after_a_silence_begins_a_new_lease(spark):
    rows = [(1, 0), (1, 10 * HOUR), (1, 10 * HOUR), (1, 30 * HOUR), (2, 60 * HOUR)]
    found, _ = beats(spark, rows, "again", 2)
    assert found == [(1, 0, 6 * HOUR), (1, 10 * HOUR, 16 * HOUR), (1, 30 * HOUR, 36 * HOUR)]


def test_tokens_are_forgotten_when_they_end(spark):
    rows = [("a", "issue", 0, HOUR), ("a", "use", 10, None), ("a", "use", 20, None), ("b", "issue", 0, HOUR), ("b", "use", HOUR, None), ("c", "use", 5, None),
            ("a", "use", 3 * HOUR, None), ("d", "issue", 4 * HOUR, 1), ("e", "use", 9 * HOUR, None)]
    rows = [(token, kind, T0 + at, ttl) for token, kind, at, ttl in rows]
    feed = S.Feed(spark.createDataFrame(rows, "token string, kind string, at_ms long, ttl_ms long"), "spent", "at_ms", parts=3)
    found, kept = keyed(feed, K.consume_tokens(feed.stream()), "spent")
    assert sorted((token, at - T0, outcome) for token, at, outcome in found) == [("a", 10, "accepted"), ("a", 20, "used"), ("a", 3 * HOUR, "expired"), ("b", HOUR, "expired"), ("c", 5, "expired"), ("e", 9 * HOUR, "expired")]
    assert kept[-1] == 0


def test_chunks_out_of_order_over_restarts(spark):
    rows = [(1, 2, "x", 3, 0), (1, 0, "y", 3, 1), (1, 2, "x", 3, 2), (2, 0, "z", 1, 3), (1, 2, "q", 3, 4), (1, 1, "w", 3, 5), (1, 1, "w", 3, 6)]
    feed = S.Feed(spark.createDataFrame(rows, "job_id long, chunk_index long, sha256 string, total long, arrival long"), "upload", "arrival", parts=3)
    out = S.run_keyed(feed, K.chunk_intake(feed.stream()), "upload", clock=True)
    got = sorted((r["job_id"], r["chunk_index"], r["sha256"], r["outcome"]) for r in out.collect())
    assert got == [(1, 0, "y", "stored"), (1, 1, "w", "complete"), (1, 1, "w", "repeat"), (1, 2, "q", "conflict"), (1, 2, "x", "repeat"), (1, 2, "x", "stored"), (2, 0, "z", "complete")]


def test_chunks_are_forgotten_after_their_time(spark):
    """An entry outlives its time to live by no batch: the same chunk counts as new."""
    rows = [(1, 0, "x", 2, 0), (1, 0, "x", 2, 9)]
    feed = S.Feed(spark.createDataFrame(rows, "job_id long, chunk_index long, sha256 string, total long, arrival long"), "stale", "arrival", parts=2)
    out = S.run_keyed(feed, K.chunk_intake(feed.stream(), keep_ms=1), "stale", clock=True)
    assert [r["outcome"] for r in out.collect()] == ["stored", "stored"]


CHUNK = "job_id long, chunk_index long, sha256 string, total long, arrival long"


def chunk_results(spark, rows, keep_ms=K.DAY_MS, parts=3):
    feed = S.Feed(spark.createDataFrame(rows, CHUNK), "intake", "arrival", parts=parts)
    out = S.run_known(feed, feed.stream(), W.chunk_outcomes, W.CHUNK_KNOWN, keep_ms, "intake")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_chunks_judged_by_earlier_batches(spark):
    """As the typed state says it, over restarts, with repeats in the same and in later batches, and no digest at all."""
    rows = [(1, 2, "x", 3, 0), (1, 0, "y", 3, 1), (1, 2, "x", 3, 2), (2, 0, "z", 1, 3), (1, 2, "q", 3, 4), (1, 1, "w", 3, 5), (1, 1, "w", 3, 6),
            (3, 0, None, 2, 0), (3, 0, None, 2, 7), (3, 1, "a", 2, 8)]
    feed = S.Feed(spark.createDataFrame(rows, CHUNK), "typed", "arrival", parts=3)
    typed = S.run_keyed(feed, K.chunk_intake(feed.stream()), "typed", clock=True)
    got = chunk_results(spark, rows)
    assert got == sorted((tuple(r) for r in typed.collect()), key=str) and (1, 1, "w", "complete") in got and (3, 0, None, "repeat") in got


def test_found_chunks_are_forgotten_after_their_time(spark):
    rows = [(1, 0, "x", 2, 0), (1, 0, "x", 2, 9)]
    assert [r[3] for r in chunk_results(spark, rows, 1, 2)] == ["stored", "stored"]


SELECTION = "media_id long, section long, seq long, score long, allowance long, target long, start_ms long, end_ms long, final_start long, final_end long, last boolean, arrival long"


def test_sections_wait_for_their_turn(spark):
    """Section 1 arrives and closes first; picks of section 0 come before it, deferred ones fill the rest, repeats change nothing."""
    clip = lambda section, seq, score, at, arrival: (7, section, seq, score, 1 if section == 0 else 2, 3, at, at + 20, at, at + 20, False, arrival)
    close = lambda section, last, arrival: (7, section, -1, *[0] * 7, last, arrival)
    rows = [clip(1, 5, 50, 100, 0), clip(1, 5, 50, 100, 1), close(1, True, 1), clip(0, 1, 90, 0, 2), clip(0, 2, 80, 30, 2), clip(0, 3, 95, 10, 2), close(0, False, 3)]
    feed = S.Feed(spark.createDataFrame(rows, SELECTION), "wait", "arrival", parts=3)
    found, kept = keyed(feed, K.admit_incrementally(feed.stream()), "wait")
    assert sorted((r[1], r[2], r[6]) for r in found) == [(0, 2, False), (0, 3, True), (1, 5, True)]
    assert kept[-1] == 1  # a finished recording is one word


def test_sections_in_batches_as_with_typed_state(spark):
    """The same picks over one, two and four rounds, with late rows, repeats, a recording that never ends and rows after the last section."""
    rows = []
    for media in range(6):
        for section in range(5):
            at = section + (-2 * (section % 2) if media % 2 else 0)
            for seq in range(4):
                begin = (section * 37 + seq * 13 + media * 7) % 150
                rows.append((media, section, section * 10 + seq, (seq * 31 + section * 17) % 50, 1 + section // 2, 4, begin, begin + 25, begin, begin + 20, False, at * 10 + seq))
            if (media, section) != (5, 3):
                rows.append((media, section, -1, *[0] * 7, section == 4, at * 10 + 5))
        rows.append(rows[-3])
        rows.append((media, 0, 99, 999, 5, 5, 0, 5, 400, 405, False, 90))
    found = []
    for parts in (1, 2, 4):
        feed = S.Feed(spark.createDataFrame(rows, SELECTION), "rounds", "arrival", parts=parts)
        found.append(sorted(tuple(r) for r in S.run_carried(feed, feed.stream(), K.admit_in_batches, K.OPEN_SELECTION, "rounds").collect()))
    feed = S.Feed(spark.createDataFrame(rows, SELECTION), "typed", "arrival", parts=4)
    typed = sorted(tuple(r) for r in S.run_keyed(feed, K.admit_incrementally(feed.stream()), "typed").collect())
    assert found[2] == typed and {r[0] for r in typed} == set(range(6)) and {r[-1] for r in typed} == {True, False}
    assert all({r for r in f if r[2] != 99} >= {r for r in typed if r[-1]} for f in found[1:])


def test_selection_keeps_its_state_in_tables(spark, monkeypatch):
    """The query must not ask a state store entry by entry."""
    from timedspark.plans import stream_queries as Q
    monkeypatch.setattr(S, "run_keyed", None)
    assert Q.stream_selection(spark, "/root/testdata/sf0.001").count() > 0


def test_latest_count_wins(spark):
    rows = spark.createDataFrame([(1, 1, 9, 1), (1, 2, 4, 2), (1, 1, None, None)], "job_id long, place int, selected long, with long")
    once = W.job_progress(rows)
    assert [tuple(r) for r in W.job_progress(once).collect()] == [(1, 2, 4, 2)]
