"""Registered queries against DuckDB on the smallest driver tables, and the contract."""

import os

import pytest

import __spark_entry__ as entry
from tests_compare import difference, duck

SF = "/root/testdata/sf0.001"
SOME = ("clip_words", "nearest_snap", "interval_subtract", "coverage_audit", "anchor_splice", "word_sessions", "debounce", "min_dwell", "boundary_words",
        "select_clips", "wide_frames", "face_match", "shot_cuts", "online_clusters", "review_gate", "corrections", "scorecard", "retention",
        "upload_status", "resume_selection", "nested_transcripts", "speech_events", "stream_selection")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", SOME)
def test_query_matches(spark, name):
    assert difference(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
