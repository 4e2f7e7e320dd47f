"""Greedy choice, section quotas and their live form."""

import random

import pytest
from pyspark.sql import functions as F

from timedspark.operators import selection as K

CAND = "media_id STRING, seq BIGINT, start_ms BIGINT, end_ms BIGINT, score BIGINT"


def brute(rows, target):
    kept = {}
    for m, seq, s, e, score in sorted(rows, key=lambda r: (-r[4], r[1])):
        mine = kept.setdefault(m, [])
        if len(mine) < target and not any(s < b and e > a for _, a, b in mine):
            mine.append((seq, s, e))
    return {(m, x[0]) for m, v in kept.items() for x in v}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_brute_force(table, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("hhhab"), i, s := rng.randrange(600), s + rng.randrange(5, 60), rng.randrange(30)) for i in range(150)]
    rows += [("h", 200 + i, 100, 140, 29) for i in range(30)]  # many copies of one span
    got = K.greedy_by_score(table(rows, CAND), 4, width=50).collect()
    assert {(r.media_id, r.seq) for r in got} == brute(rows, 4)
    for media in "hab":
        mine = sorted((r.start_ms, r.end_ms) for r in got if r.media_id == media)
        assert all(x[1] <= y[0] for x, y in zip(mine, mine[1:]))


def test_greedy_by_start(table):
    rows = [("m", 0, 0, 10, 0), ("m", 1, 5, 12, 0), ("m", 2, 10, 20, 0), ("m", 3, 11, 15, 0), ("m", 4, 30, 40, 0)]
    got = K.greedy_by_start(table(rows, CAND), width=4)
    assert sorted(r.seq for r in got.collect()) == [0, 2, 4]


CASES = [
    ("boundary duplicate", [1120], [1120, 1300], 5, [1120, 1300]),
    ("slot reservation", [20, 100, 200, 300], [1300], 3, [20, 100, 1300]),
    ("deferred fill", [20, 100, 200], [], 3, [20, 100, 200]),
]


def section_rows(name, first, second, target):
    rows = []
    for section, (end, starts) in enumerate([(1_200, first), (1_500, second)]):
        for start in starts:
            s, e = start * 1_000, (start + 20) * 1_000
            rows.append((name, section, end * 1_000, 1_500_000, target, s, e, s, e, 900, len(rows)))
    return rows


SECTION = ("media_id STRING, section BIGINT, section_end BIGINT, duration_ms BIGINT, target BIGINT, start_ms BIGINT, end_ms BIGINT, "
           "final_start BIGINT, final_end BIGINT, score BIGINT, seq BIGINT")


def test_section_quota_cases(table):
    rows = [r for name, a, b, target, _ in CASES for r in section_rows(name, a, b, target)]
    got = K.admit_by_section(table(rows, SECTION)).collect()
    for name, _, _, _, want in CASES:
        assert sorted(r.start_ms // 1_000 for r in got if r.media_id == name) == want, name


def test_caps(table):
    minutes = {5: 3, 15: 3, 30: 6, 60: 12, 120: 24, 180: 30}
    got = table([(m,) for m in minutes], "m BIGINT").select("m", K.clip_cap(F.col("m") * 60_000).alias("cap")).collect()
    assert {r.m: r.cap for r in got} == minutes


def test_peaks_and_spacing(table):
    frames = table([("m", i, v, i - 2, i + 5) for i, v in enumerate([1.0, 9.0, 8.9, 2.0, 1.0, 1.0, 7.0, 4.0, 1.0, 6.0])],
                   "media_id STRING, frame BIGINT, level DOUBLE, blank_from BIGINT, blank_to BIGINT")
    assert [r.frame for r in K.peaks_with_suppression(frames, 3).orderBy("pick").collect()] == [1, 6]
    rows = table([("m", i, s, s + 5, v) for i, (s, v) in enumerate([(0, 5), (10, 9), (30, 8), (40, 7)])], CAND)
    assert [r.start_ms for r in K.spaced_top(rows, 2, 25).orderBy("pick").collect()] == [10, 40]
