"""Hard negatives by vertical scans over columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.llm.common import cut
from timedspark.llm.vectors import best_first, in_cells, integer_vectors, keep_best, matrices

#: Dimensions read between two looks at the candidates.
STRIDE = 8

POSITIVES = "anchor long, anchor_id long, vec_id long, row long, score long"
NEGATIVES = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, vec_id long, row long, score long"


class Columns:
    """Vectors of a block by dimension, rows of a label side by side, with the smallest and largest value of each dimension."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.labels, self.ids, self.numbers = labels[order], ids[order], numbers[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.low, self.top = self.columns.min(axis=1), self.columns.max(axis=1)

    def of_label(self, label: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return int(a), int(b)


class VerticalScan:
    """Partial scores of candidates while an anchor reads the columns in descending magnitude of its own components.

    What the columns not yet read can add lies between the sums of their smallest and largest contributions; after
    the last column `least` and `most` are both the score.
    """

    def __init__(self, block: Columns, query: np.ndarray, candidates: np.ndarray):
        self.block, self.query, self.candidates, self.done = block, query, candidates, 0
        self.order = np.argsort(-np.abs(query), kind="stable")
        ends = np.sort(np.stack([query * block.low, query * block.top]), axis=0)[:, self.order]
        self.rest = np.concatenate([ends[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
        self.scores = np.zeros(len(candidates), block.columns.dtype)

    def read(self) -> bool:
        """Read the next STRIDE columns; False when none is left."""
        dims = self.order[self.done:self.done + STRIDE]
        if not len(dims):
            return False
        columns = self.block.columns[dims]
        if 8 * len(self.candidates) > columns.shape[1]:  # most rows are candidates: read the columns through
            self.scores += (self.query[dims] @ columns)[self.candidates]
        else:
            self.scores += self.query[dims] @ columns[:, self.candidates]
        self.done += len(dims)
        return True

    @property
    def least(self) -> np.ndarray:
        return self.scores + self.rest[0, self.done]

    @property
    def most(self) -> np.ndarray:
        return self.scores + self.rest[1, self.done]

    def keep(self, bitmap: np.ndarray) -> None:
        self.candidates, self.scores = self.candidates[bitmap], self.scores[bitmap]


def kth_largest(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def best_of_label(block: Columns, query: np.ndarray, label: int, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows of the label, without row number `own`."""
    a, b = block.of_label(label)
    scan = VerticalScan(block, query, np.arange(a, b)[block.numbers[a:b] != own])
    while scan.read():
        if len(scan.candidates) > k:
            scan.keep(scan.most >= kth_largest(scan.least, k))
    best = best_first(scan.scores, block.ids[scan.candidates], k)
    return scan.candidates[best], scan.scores[best]


def best_in_windows(block: Columns, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, both ends included, places and scores of the k best rows of other labels in it.

    A row stays a candidate while its bounds meet a window and it may still be among the k best there: rows whose
    bounds lie in the window set a score that others have to reach.
    """
    a, b = block.of_label(label)
    scan = VerticalScan(block, query, np.r_[0:a, b:len(block.labels)])
    while scan.read():
        least, most = scan.least, scan.most
        stay = np.zeros(len(least), bool)
        for low, top in windows:
            sure = least[(least >= low) & (most <= top)]
            reach = max(low, kth_largest(sure, k)) if len(sure) >= k else low
            stay |= (most >= reach) & (least <= top)
        scan.keep(stay)
    out = []
    for low, top in windows:
        inside = np.flatnonzero((scan.scores >= low) & (scan.scores <= top))
        best = inside[best_first(scan.scores[inside], block.ids[scan.candidates[inside]], k)]
        out.append((scan.candidates[best], scan.scores[best]))
    return out


def _block(rows: pa.Table, queries: pa.Table) -> tuple[Columns, np.ndarray]:
    vectors, asked = matrices(rows, queries)
    return Columns(vectors, *(rows.column(c).to_numpy() for c in ("label", "vec_id", "row"))), asked


def _gathered(found: list[tuple], rows: tuple[np.ndarray, np.ndarray], names: list[str]) -> pa.Table:
    """One table from (values of the leading columns, places in `rows`, scores)."""
    lengths = np.array([len(f[-1]) for f in found], np.int64)
    at = np.concatenate([f[-2] for f in found]).astype(np.int64) if found else np.empty(0, np.int64)
    scores = np.concatenate([f[-1] for f in found]).astype(np.int64) if found else np.empty(0, np.int64)
    lead = {n: pa.array(np.repeat(np.array([f[k] for f in found], np.int64), lengths)) for k, n in enumerate(names)}
    return pa.table(lead | {"vec_id": pa.array(rows[0][at]), "row": pa.array(rows[1][at]), "score": pa.array(scores)})


def _positives(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        block, asked = _block(rows, queries) if len(rows) else (None, ())
        for query, own, name, label in zip(asked, *(queries.column(c).to_pylist() for c in ("row", "vec_id", "label"))):
            found.append((own, name, *best_of_label(block, query, label, own, k)))
        return _gathered(found, (block.ids, block.numbers) if block else (np.empty(0, np.int64),) * 2, ["anchor", "anchor_id"])
    return run


def _negatives(k: int, low: int, top: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        block, asked = _block(rows, queries) if len(rows) else (None, ())
        for query, own, name, label, positives in zip(asked, *(queries.column(c).to_pylist() for c in ("row", "vec_id", "label", "positives"))):
            windows = [(-(-low * p["score"] // 100), top * p["score"] // 100) for p in positives]
            for p, best in zip(positives, best_in_windows(block, query, label, windows, k)):
                found.append((own, name, p["rank"], p["vec_id"], p["score"], *best))
        return _gathered(found, (block.ids, block.numbers) if block else (np.empty(0, np.int64),) * 2,
                         ["anchor", "anchor_id", "positive", "positive_id", "positive_score"])
    return run


def mine_hard_negatives(vectors: DataFrame, asked: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, top: int = 95) -> DataFrame:
    """Negatives that score nearly as high as a positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `asked` holds. An anchor's positives are its best `positives` other rows of the same label
    by integer inner product of floor(256 * x). For each, the best `negatives` rows of other labels whose score lies between
    `low` and `top` percent of the positive's, both included, are returned.

    Anchors and rows meet in cells of bounded size, first for positives, then for negatives. In a cell the vectors lie
    by column. An anchor reads the columns in order of its own magnitudes; what the columns not yet read can add shrinks
    the candidates until positives, and then the windows of scores, are exact.

    Ties go to the smaller vec_id. Repeated rows are rows of their own, as anchors, positives and negatives. An anchor without
    positives, or a positive without negatives (such as one with a score below 0), has no rows; with fewer all are returned. Rows without vec_id, label
    or vector, and vectors with a null, NaN or infinite component take no part. Shorter vectors are filled up with zeros. Other columns do not
    matter; an empty table gives no rows.
    """
    rows = integer_vectors(vectors.filter("label IS NOT NULL"), F.col("label").cast("long").alias("label"))
    anchors = rows.filter(asked)
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    near = keep_best(in_cells(rows, anchors, _positives(positives), POSITIVES), positives, ["anchor"], order)
    listed = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    kind = listed.schema["positives"].dataType
    windowed = cut(anchors.join(listed, "row"))
    found = in_cells(rows.withColumn("positives", F.lit(None).cast(kind)), windowed, _negatives(negatives, low, top), NEGATIVES)
    best = keep_best(found, negatives, ["anchor", "positive"], order)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
