"""Exact search and hard negatives against plain numpy."""

import math

import numpy as np
import pytest

from timedspark.llm import block_search, hard_negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, Row string, score int, v int"
ASKED = "vec_id % 50 = 0"


def whole(rows):
    """(vec_id, vector, label) of the rows that take part."""
    width = max([len(r[1]) for r in rows if r[1] is not None] or [0])
    out = []
    for vec_id, x, label, *_ in rows:
        if vec_id is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            out.append((vec_id, np.array([math.floor(256 * float(np.float32(c))) for c in x] + [0] * (width - len(x)), dtype=object), label))
    return out


def top(rows, k=5):
    rows, out = whole(rows), []
    for n, (q, x, _) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-int(x @ y), c) for m, (c, y, _) in enumerate(rows) if m != n)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def negatives(rows):
    rows, out = [r for r in whole(rows) if r[2] is not None], []
    for n, (q, x, label) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-int(x @ y), c, other == label) for m, (c, y, other) in enumerate(rows) if m != n)
            for s, c, _ in [t for t in scores if t[2]][:5]:
                inside = [(t, d) for t, d, same in scores if not same and -50 * s <= -100 * t <= -95 * s]
                out += [(q, c, r + 1, d, -s, -t) for r, (t, d) in enumerate(inside[:3])]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())


def mined(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_rows(seed, n=700, width=24):
    """Clusters, a third of all vectors the same, ties, repeated rows and ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    rows = []
    for k in range(n):
        x = centers[0] if k % 3 == 0 else centers[k % 6] + 0.5 * rng.normal(size=width)
        rows.append((k, [float(c) for c in x / np.linalg.norm(x)], int(rng.integers(0, 4)), "r", 1, 2))
    rows += [rows[50], rows[50], rows[7], (50, rows[8][1], 1, "r", 1, 2), (None, rows[3][1], 1, "r", 1, 2), (1_000, None, 1, "r", 1, 2), (1_050, [1.0, None] * 12, 1, "r", 1, 2),
             (1_100, [float("nan")] * width, 1, "r", 1, 2), (1_150, [float("inf")] * width, 1, "r", 1, 2), (1_200, rows[4][1], None, "r", 1, 2), (1_250, [], 2, "r", 1, 2), (1_300, [0.5], 2, "r", 1, 2)]
    return rows


@pytest.fixture(params=["one cell", "many cells"])
def cells(request, monkeypatch):
    if request.param == "many cells":
        monkeypatch.setattr(vectors, "LEAST_ROWS", 40)
        monkeypatch.setattr(vectors, "CELL_QUERIES", 5)


def test_search_against_all_scores(table, cells):
    rows = some_rows(1)
    assert found(block_search.top_k(table(rows, SCHEMA), ASKED)) == top(rows)


def test_negatives_against_all_scores(table, cells):
    rows = some_rows(2)
    assert mined(hard_negatives.mine_hard_negatives(table(rows, SCHEMA), ASKED)) == negatives(rows)


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()]
    assert found(block_search.top_k(frame, ASKED)) == top(rows)
    assert mined(hard_negatives.mine_hard_negatives(frame, ASKED)) == negatives(rows)


def test_empty_and_few_rows(table):
    for rows in ([], [(50, [0.5, 0.5], 1, "r", 1, 2)], [(50, [0.5, 0.5], 1, "r", 1, 2), (51, [0.5, 0.25], 1, "r", 1, 2), (52, [0.25, 0.25], 2, "r", 1, 2)]):
        assert found(block_search.top_k(table(rows, SCHEMA), ASKED)) == top(rows)
        assert mined(hard_negatives.mine_hard_negatives(table(rows, SCHEMA), ASKED)) == negatives(rows)


def test_products_beyond_doubles_are_exact(table):
    rows = [(k, [3e5 + k, -1e5 * k, 1.0], k % 2, "r", 1, 2) for k in range(60)]
    assert found(block_search.top_k(table(rows, SCHEMA), ASKED)) == top(rows)
    assert mined(hard_negatives.mine_hard_negatives(table(rows, SCHEMA), ASKED)) == negatives(rows)


def test_blocks_beyond_the_bound_are_not_scored():
    rng = np.random.default_rng(4)
    centers = 200 * rng.normal(size=(16, 32))
    x = np.floor(np.repeat(centers, 500, axis=0) + rng.normal(size=(8_000, 32)))
    index, ids = block_search.BlockIndex(x), np.arange(8_000)
    bounds = index.bounds(x[:100])
    share = []
    for q in range(100):
        places, scores, done = index.search(x[q], bounds[q], ids, q, 5)
        others = x @ x[q]
        others[q] = -np.inf
        assert list(scores) == sorted(others, reverse=True)[:5]
        assert all(index.bounds(x[q:q + 1])[0][b] >= (index.forward[index.starts[b]:index.ends[b]] @ x[q]).max() for b in range(len(index.starts)))
        share.append(done / len(index.starts))
    assert np.mean(share) < 0.5


def test_candidates_shrink_while_columns_are_read():
    rng = np.random.default_rng(5)
    x = np.floor(200 * rng.normal(size=(4_000, 64)) * np.geomspace(1, 0.01, 64))
    block = hard_negatives.Columns(x, np.zeros(4_000, np.int64), np.arange(4_000), np.arange(4_000))
    scan, left = hard_negatives.VerticalScan(block, x[9], np.arange(4_000)), []
    while scan.read():
        assert (scan.least <= x[scan.candidates] @ x[9]).all() and (scan.most >= x[scan.candidates] @ x[9]).all()
        scan.keep(scan.most >= hard_negatives.kth_largest(scan.least, 5))
        left.append(len(scan.candidates))
    assert left[3] < 400 and left[-1] >= 5 and left == sorted(left, reverse=True)
