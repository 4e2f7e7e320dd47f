"""Interval algebra against brute force, and its laws."""

import random

import pytest
from pyspark.sql import functions as F

from timedspark.operators import clips as C
from timedspark.operators import intervals as I

SPAN = "media_id STRING, seq BIGINT, start_ms BIGINT, end_ms BIGINT"


def spans(seed, n, longest=60, width=1_000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(width)
        out.append((rng.choice("mmmn"), i, start, start + rng.randrange(1, longest)))
    return out


def covered(rows, media):
    return {t for m, _, s, e in rows if m == media for t in range(s, e)}


@pytest.mark.parametrize("salt, long_spans", [(1, False), (3, False), (3, True)])
def test_overlap_join_equals_theta_join(table, salt, long_spans):
    a, b = spans(1, 80), spans(2, 60, 200)
    right = table(b, SPAN).toDF("media_id", "r_seq", "r_start_ms", "r_end_ms")
    got = {(r.seq, r.r_seq) for r in I.overlap_join(table(a, SPAN), right, 50, salt=salt, long_spans=long_spans).collect()}
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]}
    assert got == want
    assert I.overlap_join(table(a, SPAN), right, 50, salt=salt, long_spans=long_spans).count() == len(want)


@pytest.mark.parametrize("width", [1, 7, 50, 100_000])
def test_overlap_join_of_short_and_long_spans(table, width):
    """Lengths from 1 to 40,000 on both sides, empty and negative spans too: same pairs as comparing all."""
    rng = random.Random(width)
    sides = [[(rng.choice("mn"), i, s := rng.randrange(-20_000, 20_000), s + rng.choice([0, 1, 3, 60, 900, 9_000, 40_000])) for i in range(150)] for _ in "ab"]
    a, b = sides
    right = table(b, SPAN).toDF("media_id", "r_seq", "r_start_ms", "r_end_ms")
    got = sorted((r.seq, r.r_seq) for r in I.overlap_join(table(a, SPAN), right, width, long_spans=True).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])


def test_a_long_span_is_copied_a_few_times_only(table):
    """One span of 12 hours among words: every row has at most four places and two more a wider level."""
    words = table([("m", i, 500 * i, 500 * i + 300) for i in range(1_000)], SPAN)
    long = table([("m", 0, 0, 43_200_000), ("m", 1, 10_000, 30_000), ("m", 2, 600_000, 1_500_000)], SPAN)
    span = ("start_ms", "end_ms")
    for rows, other, role in ((words, long, 1), (long, words, 2), (long, long, 1)):
        places = I.overlap_places(rows, span, 60_000, I.levels_of(other, span, 60_000), role)
        most = places.groupBy("seq").count().agg(F.max("count")).first()[0]
        assert most <= 8, "12 hours are 720 buckets of a minute"
    right = long.toDF("media_id", "r_seq", "r_start_ms", "r_end_ms")
    assert I.overlap_join(words, right, 60_000, long_spans=True).groupBy("r_seq").count().orderBy("r_seq").collect() == [(0, 1_000), (1, 40)]
    # Spans of one level meet at one place, as if there were no levels.
    assert I.overlap_places(words, span, 60_000, I.levels_of(words, span, 60_000), 1).count() < 1_010


@pytest.mark.parametrize("long_spans", [False, True])
def test_overlap_join_of_nulls_and_empty_tables(table, long_spans):
    some, none = table([("m", 0, None, 5), ("m", 1, 3, None), (None, 2, 1, 9), ("m", 3, 1, 9)], SPAN), table([], SPAN)

    def pairs(a, b):
        right = b.toDF("media_id", "r_seq", "r_start_ms", "r_end_ms")
        return [(r.seq, r.r_seq) for r in I.overlap_join(a, right, 4, long_spans=long_spans).collect()]
    assert pairs(some, some) == [(3, 3)]
    assert pairs(some, none) == pairs(none, some) == []


def test_union_is_idempotent_and_covers(table):
    a = spans(3, 60)
    once = I.union_ranges(table(a, SPAN), width=40)
    twice = I.union_ranges(once, width=70)
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, twice.collect()))
    for media in "mn":
        assert {t for m, s, e in rows if m == media for t in range(s, e)} == covered(a, media)
    merged = [r for r in rows if r[0] == "m"]
    assert all(x[2] < y[1] for x, y in zip(merged, merged[1:])), "touching ranges must merge"


def test_touching_ranges_merge_but_do_not_overlap(table):
    a = table([("m", 0, 0, 10), ("m", 1, 10, 20)], SPAN)
    assert [tuple(r) for r in I.union_ranges(a).collect()] == [("m", 0, 20)]
    b = table([("m", 10, 20)], "media_id STRING, start_ms BIGINT, end_ms BIGINT")
    kept = I.exclude_overlapping(a, b).collect()
    assert [(r.start_ms, r.end_ms) for r in kept] == [(0, 10)]


def test_subtract_and_intersection_partition_the_input(table):
    a, b = spans(4, 40, 120), spans(5, 40)
    pieces = I.subtract(table(a, SPAN), table(b, SPAN), ["seq"], 64).collect()
    holes = {m: covered(b, m) for m in "mn"}
    for media, seq, start, end in a:
        got = sorted(t for r in pieces if r.seq == seq for t in range(r.start_ms, r.end_ms))
        assert got == sorted(set(range(start, end)) - holes[media])


def test_gaps(table):
    a = spans(6, 25, 30)
    durations = table([("m", 1_100), ("n", 1_200), ("empty", 5)], "media_id STRING, duration_ms BIGINT")
    got = I.gaps(table(a, SPAN), durations, width=90).collect()
    for media, length in (("m", 1_100), ("n", 1_200), ("empty", 5)):
        free = {t for r in got if r.media_id == media for t in range(r.start_ms, r.end_ms)}
        assert free == set(range(length)) - covered(a, media)


def test_measure_and_counts(table):
    q, regions, words = spans(7, 30, 100), spans(8, 50), spans(9, 80, 9)
    got = {r.seq: (r.overlap_ms, r.n) for r in I.measure_within(
        table(q, SPAN), ["seq"], table(regions, SPAN), {"n": table(words, SPAN)}, width=37).collect()}
    for media, seq, s, e in q:
        overlap = sum(max(0, min(e, b) - max(s, a)) for m, _, a, b in regions if m == media)
        count = sum(2 * s <= a + b < 2 * e for m, _, a, b in words if m == media)
        assert got[seq] == (overlap, count)


def test_flag_overlaps_equals_theta(table):
    a, b = spans(10, 60), spans(11, 20)
    got = {r.seq: r.overlapped for r in I.flag_overlaps(table(a, SPAN), table(b, SPAN), width=33).collect()}
    assert got == {x[1]: any(x[0] == y[0] and x[2] < y[3] and x[3] > y[2] for y in b) for x in a}


def test_nearest_prefers_the_earlier_on_a_tie(table):
    rows = table([("m", 0, 10), ("m", 1, 15), ("m", 2, 99), ("z", 3, 1)], "media_id STRING, id BIGINT, at BIGINT")
    points = table([("m", 5), ("m", 5), ("m", 15), ("m", 25)], "media_id STRING, p BIGINT")
    got = {r.id: r.near for r in I.nearest_value(rows, "at", points, "p", "near", width=4).collect()}
    assert got == {0: 5, 1: 15, 2: 25, 3: None}


def test_next_at_or_after_is_inclusive(table):
    rows = table([("m", 0, 10), ("m", 1, 11), ("m", 2, 90)], "media_id STRING, id BIGINT, at BIGINT")
    points = table([("m", 10), ("m", 40)], "media_id STRING, p BIGINT")
    got = {r.id: r.nxt for r in I.next_at_or_after(rows, "at", points, "p", "nxt", width=8).collect()}
    assert got == {0: 10, 1: 40, 2: None}


def test_chunk_plan(table):
    media = table([("a", 700), ("b", 100), ("c", 300), ("d", 301), ("none", 0)], "media_id STRING, duration_ms BIGINT")
    got = sorted((r.media_id, r.idx, r.start_ms, r.end_ms) for r in I.overlapping_chunks(media, 300, 10).collect())
    assert got == [("a", 0, 0, 300), ("a", 1, 290, 590), ("a", 2, 580, 700), ("b", 0, 0, 100), ("c", 0, 0, 300),
                   ("d", 0, 0, 300), ("d", 1, 290, 301)]
    with pytest.raises(ValueError):
        I.overlapping_chunks(media, 10, 10)


def test_cut_bounds_cases(table):
    words = table([("a", 0, 10_000, 10_500), ("a", 1, 11_000, 11_500), ("a", 2, 12_000, 12_500), ("b", 0, 100_000, 100_500), ("c", 0, 50, 500)], SPAN)
    quotes = table([("a", 0, 10_000, 12_500), ("b", 0, 10_000, 12_000)], "media_id STRING, clip BIGINT, clip_start BIGINT, clip_end BIGINT")
    got = {r.media_id: (r.cut_start, r.cut_end) for r in C.cut_bounds(quotes, words).collect()}
    assert got["a"] == (9_900, 12_600)
    wide = {r.media_id: (r.cut_start, r.cut_end) for r in C.cut_bounds(quotes, words, head_ms=200, tail_ms=300).collect()}
    assert wide["b"] == (9_800, 12_300)
    floor = C.cut_bounds(table([("c", 0, 0, 600)], "media_id STRING, clip BIGINT, clip_start BIGINT, clip_end BIGINT"), words, head_ms=1_000)
    assert floor.first().cut_start == 0


def test_excerpt_takes_only_words_fully_inside(table):
    words = table([("m", 0, 900, 1_100, "cut"), ("m", 1, 1_200, 1_300, " in "), ("m", 2, 1_400, 1_500, " "), ("m", 3, 1_900, 2_100, "out")],
                  SPAN + ", text STRING")
    clips = table([("m", 0, 1_000, 2_000), ("m", 1, 5_000, 6_000)], "media_id STRING, clip BIGINT, clip_start BIGINT, clip_end BIGINT")
    got = {r.clip: (r.n_words, r.excerpt) for r in C.clip_texts(words, clips).collect()}
    assert got == {0: (2, "in"), 1: (0, "")}


def test_splice_between_anchors_and_without(table):
    old = table([("m", 0, 0, 500, "one"), ("m", 1, 600, 900, "two"), ("m", 2, 1_500, 1_800, "bad"), ("m", 3, 3_000, 3_300, "three")], SPAN + ", text STRING")
    windows = table([("m", 0, 1_000, 2_500)], "media_id STRING, win BIGINT, start_ms BIGINT, end_ms BIGINT")
    new = table([("m", 0, 0, 620, 880, "Two."), ("m", 0, 1, 1_100, 1_300, "good"), ("m", 0, 2, 1_400, 1_600, "better"), ("m", 0, 3, 3_010, 3_200, "three")],
                "media_id STRING, win BIGINT, j BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING")
    got = [r.text for r in C.splice_words(old, new, windows).orderBy("start_ms").collect()]
    assert got == ["one", "two", "good", "better", "three"]
    loose = new.filter("j in (1, 2)")
    assert [r.text for r in C.splice_words(old, loose, windows).orderBy("start_ms").collect()] == ["one", "two", "good", "better", "three"]


def test_tolerance_is_strict(table):
    clip = "media_id STRING, clip BIGINT, clip_start BIGINT, clip_end BIGINT"
    clips = table([("m", 0, 1_000, 2_000), ("m", 1, 1_049, 2_049), ("m", 2, 1_050, 2_000)], clip)
    done = table([("m", 9, 1_000, 2_000)], clip)
    assert [r.clip for r in C.skip_finished(clips, done).collect()] == [2]


def test_tokens_of_all_scripts(table):
    """The short rule for plain letters gives what the rule for all scripts gives, and only texts beyond ASCII go through it."""
    from timedspark.operators.clips import _token
    texts = ["Hello", "it's", "A_b-9!", "...", "", "Naïve,", "नमस्ते।", "İx", "\u212aelvin", "e\u0301!", "tab\there", "\x7f!a", None]
    df = table([(t,) for t in texts], "text string")
    for got, want in df.select(_token(F.col("text")), F.regexp_replace(F.lower("text"), r"(?U)[^\w]", "")).collect():
        assert got == want
