"""Exact top-k search by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.llm.vectors import best_first, in_cells, integer_vectors, keep_best, matrices

#: Documents of a block.
BLOCK_ROWS = 128
#: Dimensions whose signs put similar documents into the same block.
SIGNS = 10

FOUND = "query long, query_id long, vec_id long, row long, score long"


class BlockIndex:
    """Ranges of documents, each with its forward index (the vectors) and the largest and smallest weight of every term."""

    def __init__(self, vectors: np.ndarray, rows: int = BLOCK_ROWS):
        spread = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")[:SIGNS] if len(vectors) else []
        self.order = np.lexsort([vectors[:, d] > 0 for d in spread][::-1]) if len(spread) else np.arange(len(vectors))
        self.forward = vectors[self.order]
        self.starts = np.arange(0, len(vectors), rows)
        self.ends = np.minimum(self.starts + rows, len(vectors))
        self.top = np.maximum.reduceat(self.forward, self.starts, axis=0) if len(vectors) else vectors
        self.low = np.minimum.reduceat(self.forward, self.starts, axis=0) if len(vectors) else vectors

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Summed term maxima: no document of the block can score more. One row a query, one column a block."""
        return np.maximum(queries, 0) @ self.top.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, out: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents without `out`, and how many blocks were scored.

        Blocks come by descending bound, one, then two, four and so on at a time, until the next bound is below the kth score.
        """
        order, done, step = np.argsort(-bounds, kind="stable"), 0, 1
        places, scores = np.empty(0, np.int64), np.empty(0, self.forward.dtype)
        while done < len(order):
            if len(scores) == k and bounds[order[done]] < scores[-1]:
                break
            blocks = order[done:done + step]
            if len(scores) == k:
                blocks = blocks[bounds[blocks] >= scores[-1]]
            fresh = [self.forward[self.starts[b]:self.ends[b]] @ query for b in blocks]
            at = np.concatenate([places, *(self.order[self.starts[b]:self.ends[b]] for b in blocks)])
            got = np.concatenate([scores, *fresh])
            if out is not None:
                got, at = got[at != out], at[at != out]
            best = best_first(got, ids[at], k)
            places, scores = at[best], got[best]
            done, step = done + len(blocks), 2 * step
        return places, scores, done


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        vectors, asked = matrices(rows, queries)
        ids, numbers = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        place = {int(n): p for p, n in enumerate(numbers)} if len(asked) else {}
        index = BlockIndex(vectors)
        bounds = index.bounds(asked) if len(ids) else np.empty((len(asked), 0))
        found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for n, (query, name, own) in enumerate(zip(asked, queries.column("vec_id").to_pylist(), queries.column("row").to_pylist())):
            places, scores, _ = index.search(query, bounds[n], ids, place.get(own), k)
            found.append((own, name, places, scores))
        lengths = np.array([len(p) for _, _, p, _ in found], np.int64)
        at = np.concatenate([p for _, _, p, _ in found]).astype(np.int64) if found else np.empty(0, np.int64)
        score = np.concatenate([s for _, _, _, s in found]).astype(np.int64) if found else np.empty(0, np.int64)
        return pa.table({"query": pa.array(np.repeat(np.array([f[0] for f in found], np.int64), lengths)), "query_id": pa.array(np.repeat(np.array([f[1] for f in found], np.int64), lengths)),
                         "vec_id": pa.array(ids[at]), "row": pa.array(numbers[at]), "score": pa.array(score)})
    return run


def top_k(vectors: DataFrame, asked: Column | str, k: int = 5) -> DataFrame:
    """The k rows with the highest integer inner product for each row where `asked` holds: query_id, rank, vec_id, score.

    Components are floor(256 * x). Rows and queries meet in cells of bounded size. A cell orders its rows by the signs of
    their most varied dimensions, cuts them into ranges, and keeps for each range the vectors and the largest and
    smallest component of every dimension. A query visits ranges by descending summed maxima of its terms until that
    bound falls below its kth score, so nothing that could belong to the k best is left out. The best of all cells are the result.

    Ties go to the smaller vec_id. All rows but the query's own are candidates, repeated rows and other rows with the same
    vec_id too; a repeated query is answered each time. With fewer rows all are returned. Rows without vec_id or vector, and
    vectors with a null, NaN or infinite component take no part. Shorter vectors are filled up with zeros, an empty one
    scores 0. Products beyond 64 bits wrap around. Other columns do not matter; an empty table gives no rows.
    """
    rows = integer_vectors(vectors)
    found = in_cells(rows, rows.filter(asked), _search(k), FOUND)
    best = keep_best(found, k, ["query"], [F.desc("score"), F.asc("vec_id"), F.asc("row")])
    return best.select("query_id", "rank", "vec_id", "score")
