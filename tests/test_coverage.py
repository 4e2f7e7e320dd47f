"""Repair acceptance and chunk exclusion on stated cases."""

import pytest
from pyspark.sql import functions as F

from timedspark.operators import coverage as V


@pytest.mark.parametrize("words,spoken,inside,valid,old,new,want", [
    (10, 500, True, True, 2.0, 1.0, True), (11, 500, True, True, 2.0, 1.0, False), (16, 2_000, True, True, 2.0, 1.0, True),
    (5, 500, False, True, 2.0, 1.0, False), (5, 500, True, False, 2.0, 1.0, False), (5, 500, True, True, 2.0, 1.995, False)])
def test_accept_repair(spark, words, spoken, inside, valid, old, new, want):
    got = spark.range(1).select(V.accept_repair(*[F.lit(v) for v in (words, spoken, inside, valid, old, new)]).alias("taken"))
    assert got.first().taken is want


def test_small_issues_are_excluded_and_large_ones_reject_the_chunk(table):
    chunks = table([("m", 0, 0, 100_000, 0, 190_000), ("m", 1, 90_000, 190_000, 190_000, 380_000)],
                   "media_id STRING, idx INT, start_ms BIGINT, end_ms BIGINT, left_x2 BIGINT, right_x2 BIGINT")
    issues = table([("m", 0, 92_000, 99_000), ("m", 1, 10_000, 21_000)], "media_id STRING, idx INT, start_ms BIGINT, end_ms BIGINT")
    judged, excluded = V.unreliable_ranges(issues, chunks, 4_000)
    assert {r.idx: r.rejected for r in judged.collect()} == {0: False, 1: True}
    assert [(r.start_ms, r.end_ms) for r in excluded.collect()] == [(88_000.0, 95_000.0)]
