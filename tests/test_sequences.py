"""Caption, session, frame and crop operators on stated cases and against brute force."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from timedspark.functions.numeric import spread
from timedspark.operators import frames as R
from timedspark.operators import repeats as Q
from timedspark.operators import sequence as S
from timedspark.operators.scan import Axis

WORD = "media_id STRING, seq BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING"
AXIS = Axis(("media_id",), ("seq",), 3)


def words(table, *items):
    return table([("m", i, s, e, t) for i, (s, e, t) in enumerate(items)], WORD)


def test_popups_break_on_sentence_gap_and_size(table):
    w = words(table, (0, 100, "a"), (120, 200, "b."), (220, 300, "c"), (320, 400, " "), (1_500, 1_600, "d"), (1_650, 1_700, "e"), (1_710, 1_800, "f"), (1_810, 1_900, "g"))
    got = S.grouped_spans(S.popups(w, 3, 1_000, AXIS), "popup").orderBy("popup").collect()
    assert [r.text for r in got] == ["a b.", "c", "d e f", "g"]


def test_gap_must_exceed_the_limit(table):
    w = words(table, (0, 100, "a"), (800, 900, "b"), (1_601, 1_700, "c"))
    got = S.speech_sessions(w, 700, 15_000, AXIS).orderBy("seq").collect()
    assert [r.session for r in got] == [0, 0, 2]


def test_session_length_limit(table):
    w = words(table, *[(i * 5_000, i * 5_000 + 4_900, f"w{i}") for i in range(6)])
    assert [r.session for r in S.speech_sessions(w, 700, 15_000, AXIS).orderBy("seq").collect()] == [0, 0, 0, 3, 3, 3]


def test_caption_lines_pack_characters(table):
    w = words(table, (0, 1, "twelve-chars"), (1, 2, "seven77"), (2, 3, "x"), (3, 4, "end."), (4, 5, "new"))
    got = S.grouped_spans(S.caption_lines(w, 20, 800, AXIS), "line").orderBy("line").collect()
    assert [r.text for r in got] == ["twelve-chars seven77", "x end.", "new"]


@pytest.mark.parametrize("seed,hold", [(1, 3), (2, 2), (3, 5), (4, 1)])
def test_debounce_equals_brute_force(table, seed, hold):
    rng = random.Random(seed)
    flags = [rng.random() < 0.5 for _ in range(80)]
    stable, pending, want = flags[0], 0, []
    for f in flags:
        pending = 0 if f == stable else pending + 1
        if f != stable and pending >= hold:
            stable, pending = f, 0
        want.append(stable)
    df = table([("m", i, f) for i, f in enumerate(flags)], "media_id STRING, frame BIGINT, flag BOOLEAN")
    got = S.debounce(df, "flag", hold, Axis(("media_id",), ("frame",), 9)).orderBy("frame").collect()
    assert [r.stable for r in got] == (want if hold > 1 else flags)


def test_flicker_is_smoothed(table):
    df = table([("m", i, i != 20) for i in range(41)], "media_id STRING, frame BIGINT, flag BOOLEAN")
    got = S.majority_smooth(df, "flag").collect()
    assert all(r.smooth for r in got)


def test_run_lengths_and_dwell(table):
    labels = [0, 0, 0, 1, 0, 0, 2, 2, 2, 2]
    df = table([("m", i, v) for i, v in enumerate(labels)], "media_id STRING, frame BIGINT, label INT")
    runs = S.run_lengths(df, "label", Axis(("media_id",), ("frame",), 4)).orderBy("start").collect()
    want, at = [], 0
    for value, group in groupby(labels):
        n = len(list(group))
        want.append((value, at, at + n))
        at += n
    assert [(r.label, r.start, r.end) for r in runs] == want
    spans = table([("m", lab, s, e) for lab, s, e in want], "media_id STRING, label INT, start_ms BIGINT, end_ms BIGINT")
    got = S.min_dwell(spans, 3, "label", Axis(("media_id",), ("start_ms",), 4)).orderBy("start_ms").collect()
    assert [(r.label, r.start_ms, r.end_ms) for r in got] == [(0, 0, 6), (2, 6, 10)]


def test_chunk_merge_is_not_a_running_maximum(table):
    # The dropped second segment must not move the mark.
    df = table([("m", 0, 0, 1_000, ""), ("m", 1, 500, 5_000, ""), ("m", 2, 950, 1_900, ""), ("m", 3, 6_000, 7_000, "")], WORD)
    assert sorted(r.seq for r in S.merge_chunk_segments(df, axis=AXIS).collect()) == [0, 2, 3]


def test_boundary_words(table):
    rows = [("m", 0, 0, 1_000, "Hello,", 0), ("m", 1, 950, 1_100, "hello", 1_950), ("m", 2, 980, 1_400, "there", 1_950), ("m", 3, 2_000, 2_100, "x", 1_950)]
    df = table(rows, WORD + ", left_x2 BIGINT")
    got = S.dedupe_boundary_words(df, AXIS).orderBy("seq").collect()
    assert [(r.seq, r.start_ms, r.end_ms) for r in got] == [(0, 0, 990), (2, 990, 1_400), (3, 2_000, 2_100)]


def test_concat_offsets_case(table):
    picks = table([("m", 0, 2_000), ("m", 1, 3_000)], "media_id STRING, pick BIGINT, length_ms BIGINT")
    w = table([("m", 0, 0, 0, 500), ("m", 0, 1, 500, 1_500), ("m", 1, 0, 0, 1_000), ("m", 1, 1, 1_000, 2_500), ("m", 0, 2, 5_000, 6_000)],
              "media_id STRING, pick BIGINT, seq BIGINT, start_ms BIGINT, end_ms BIGINT")
    got = [(r.start_ms, r.end_ms) for r in S.concat_offsets(picks, w, 500).orderBy("start_ms").collect()]
    assert got == [(0, 500), (500, 1_500), (2_500, 3_500), (3_500, 5_000)]


BOX = "media_id STRING, frame BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT"
WIDE = [("one", [(100, 100, 200, 600)], False), ("two", [(100, 200, 300, 500), (1_400, 200, 300, 500)], True),
        ("tall", [(100, 50, 300, 900), (1_400, 50, 300, 900)], True), ("tiny", [(300, 100, 400, 700), (1_500, 300, 80, 100)], False),
        ("close", [(100, 200, 300, 500), (300, 200, 300, 500)], False)]


def test_wide_frame_cases(table):
    boxes = table([(name, f, *b) for name, bs, _ in WIDE for f in range(3) for b in bs], BOX)
    frames = table([(name, f) for name, _, _ in WIDE for f in range(3)], "media_id STRING, frame BIGINT")
    got = R.wide_frames(boxes, frames, 1_920, 1_080).collect()
    assert {(r.media_id, r.wide) for r in got} == {(name, wide) for name, _, wide in WIDE}


def test_shot_cuts_equal_direct_simulation(table):
    rng = random.Random(5)
    series = [(i, rng.choice([0.0, 5.0, 25.0, 12.0]), rng.choice([0.0, 22.0, 9.0])) for i in range(200)]
    last, want = 0, []
    for i, d1, d6 in series:
        if i - last >= 3 and max(d1, d6 if i - last >= 6 else 0) >= 20:
            last = i
            want.append(i)
    df = table([("m", *r) for r in series], "media_id STRING, frame BIGINT, d1 DOUBLE, d6 DOUBLE")
    got = R.shot_cuts(df, 20.0, axis=Axis(("media_id",), ("frame",), 17)).collect()
    assert sorted(r.frame for r in got) == want


def test_locked_crop_holds_glides_jumps_and_returns(table):
    box = lambda x: [(x, 100, 300, 800)]
    plan = [box(800)] * 2 + [box(830)] * 2 + [box(1_020)] * 3 + [box(100)] + [None] * 17
    boxes = table([("m", f, *b[0]) for f, b in enumerate(plan) if b], BOX)
    frames = table([("m", 0, f) for f in range(len(plan))], "media_id STRING, shot BIGINT, frame BIGINT")
    rows = R.locked_crops(R.boxes_per_frame(boxes, frames), 1_920, 608).orderBy("frame").collect()
    x = [r.crop_x for r in rows]
    assert x[0] == x[3] == 648          # 950 - 304 = 646, on the grid of 8; a small move keeps the lock
    assert x[4] == round(648 + (864 - 648) / 16) and x[4] < x[5] < x[6] < 864   # under half overlap: glide
    assert x[7] == 0                     # no overlap: jump
    assert x[22] == 0 and x[23] == (1_920 - 608) // 2   # held for 15 misses, then the middle


def test_follow_primary(table):
    boxes = table([("m", 0, 0, 0, 100, 100, None), ("m", 0, 500, 0, 200, 200, None), ("m", 1, 0, 0, 100, 100, 50.0), ("m", 2, 0, 0, 100, 100, None),
                   ("m", 2, 600, 0, 300, 300, None)], BOX + ", face_x DOUBLE")
    frames = table([("m", f) for f in range(4)], "media_id STRING, frame BIGINT")
    got = R.follow_primary(R.boxes_per_frame(boxes, frames, "face_x"), axis=Axis(("media_id",), ("frame",), 2)).orderBy("frame").collect()
    assert [None if r.primary is None else r.primary.x for r in got] == [500.0, 0.0, 0.0, None]


def test_line_clusters_and_refrain(table):
    lines = table([("m", 0, "oh carry me home"), ("m", 1, "the river runs cold"), ("m", 2, "Oh, carry me hóme!"), ("m", 3, "oh carry us home"), ("m", 4, "la la")],
                  "media_id STRING, seq BIGINT, text STRING")
    got = {r.norm: r.leader for r in Q.line_clusters(lines).collect()}
    assert got["oh carry me home"] == 0 and got["oh carry us home"] == 0 and got["the river runs cold"] == 1 and "la la" not in got
    assert [tuple(r) for r in Q.refrains(lines).collect()] == [("m", 0, 3)]


def test_phrase_onset(table):
    w = words(table, (0, 1, "so"), (10, 11, "carry"), (20, 21, "me"), (30, 31, "home"), (40, 41, "now"))
    phrases = table([("m", "cary me home")], "media_id STRING, phrase STRING")
    assert Q.locate_phrase(w, phrases, 3).first().seq == 1


def test_split_span_ends_exactly(table):
    df = table([(["a", "bbb", "cc"],)], "t ARRAY<STRING>")
    got = df.select(S.split_span(F.col("t"), F.lit(100).cast("bigint"), F.lit(200).cast("bigint")).alias("p")).first().p
    assert [(p.start_ms, p.end_ms) for p in got] == [(100, 117), (117, 167), (167, 200)]


def test_all_frames_are_never_broadcast(spark, tmp_path):
    """A supplier makes 300 frames, three panels each: joins shuffle them whatever Spark takes their size to be."""
    from timedspark.plans import bind, frame_queries
    spark.range(5).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    boxes = spark.range(1_000).selectExpr("id % 5 AS media_id", "id % 300 AS frame", "id AS det")
    for frames, keys in ((bind.media_frames(spark, tmp_path), ["media_id", "frame"]), (frame_queries.panels(spark, tmp_path), ["media_id", "frame"]),
                         (bind.media_frames(spark, tmp_path).drop("frame"), ["media_id"])):
        assert "Broadcast" not in boxes.join(frames, keys)._jdf.queryExecution().executedPlan().toString()
    assert bind.media_frames(spark, tmp_path).distinct().count() == 1_500


def test_boxes_are_numbered_in_one_shuffle(spark, monkeypatch):
    """Equal boxes count once, and no hash table of a task's boxes comes before the numbers."""
    from pyspark.sql import Window
    from timedspark.plans import bind
    from timedspark.plans.frame_queries import KEYS, box_overlaps, numbered_boxes
    box = "media_id long, frame long, x long, y long, w long, h long"
    rows = [(1, 0, 5, 0, 9, 9), (1, 0, 5, 0, 9, 9), (1, 0, 4, 9, 9, 9), (1, 0, 5, 0, 9, 8), (1, 1, 0, 0, 1, 1), (2, 0, 7, 7, 7, 7), (2, 0, 7, 7, 7, 7), (None, 0, 1, 1, 1, 1), (None, 0, 1, 1, 1, 1)]
    monkeypatch.setattr(bind, "detections", lambda *_: spark.createDataFrame(rows, box))
    got = numbered_boxes(spark, "")
    want = spark.createDataFrame(rows, box).distinct().withColumn("person", F.row_number().over(Window.partitionBy(*KEYS).orderBy("x", "y", "w", "h")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    for df, sorts in ((got, 1), (box_overlaps(spark, ""), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan and plan.count("Sort [") == sorts


def test_centres_are_staged_three_times(spark, table, monkeypatch):
    """Shots, panels and boxes share their passes; a panel changes a run only against panels of its own shot."""
    rows = [(1, f, float(f) if f % 3 == 0 else None, 0 if f < 8 else 1, None if f in (4, 8, 9) else (f // 3) % 2) for f in range(16)]
    staged, stage = [], R.stage
    from timedspark.operators import scan as scans
    for module in (R, scans):
        monkeypatch.setattr(module, "stage", lambda df: (staged.append(1), stage(df))[1])
    got = R.smoothed_centers(stage(table(rows, "media_id long, frame long, x double, segment long, panel long")), 100, 2).orderBy("frame").collect()
    want, state, held, seen, shot = [], None, None, None, 0
    for _, frame, x, segment, panel in rows:
        if frame == 0 or segment != rows[frame - 1][3]:
            state, held, seen, shot = None, None, None, frame
        if panel is not None and seen is not None and panel != seen:
            state = None
        seen = seen if panel is None else panel
        held = held if x is None else x
        ahead = next((r[2] for r in rows[frame:] if r[2] is not None and r[3] == segment and r[1] <= shot + 2), None)
        target = held if held is not None else 50.0 if ahead is None else ahead
        state = target if state is None else 0.1 * target + 0.9 * state
        want.append((frame, target, state))
    assert [(r["frame"], r["target"], r["center"]) for r in got] == want and len(staged) <= 2


def test_equal_movement_goes_to_the_smaller_cluster(spark, table):
    """The same distances at other heights are the same movement, in whatever order and however many tasks they come."""
    shapes = [[12, 24, 48], [0, 12, 12, 36, 60, 0, 12], [0, 24, 36], [36, 0, 48, 12, 24]]
    rows = []
    for media in range(200):
        shape, r = shapes[media % 4], random.Random(media)
        for cluster in range(4):
            height = 150 + r.randrange(600)
            values = [float(height + distance) for distance in shape]
            r.shuffle(values)
            rows += [(media, frame, cluster, value) for frame, value in enumerate(values)]
    random.Random(1).shuffle(rows)
    samples = table(rows, "media_id long, frame long, cluster int, openness double").repartition(7)
    turns = spark.range(200).selectExpr("id AS media_id", "'S0' AS speaker_id", "0L AS start_ms", "1000L AS end_ms")
    assert {r["cluster"] for r in R.link_speakers(turns, samples, 30.0).collect()} == {0}


def test_spread(table):
    got = table([([],), ([3.0],), ([7.0, 7.0, 7.0],), ([1.0, 2.0, 4.0],), ([0.25, 0.5],)], "v array<double>").select(spread(F.col("v"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 0.0, 14 / 9, 0.015625]
