"""Integer vectors, and queries against all rows in cells of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.llm.common import cut

#: Rows of a cell at most (in the mean; rows are dealt by hash) and, where there are fewer than that for every core, at least.
MOST_ROWS, LEAST_ROWS = 16_384, 1_024
#: Queries of a cell, in the mean.
CELL_QUERIES = 512
#: Times a component before its fraction is cut off.
SCALE = 256


def integer_vectors(vectors: DataFrame, *kept: Column) -> DataFrame:
    """Rows that take part, written once: row (a number of its own), vec_id, v (longs), and the `kept` columns.

    A component x becomes floor(256 * x), x as double, and stops at the ends of a long. Rows without a vec_id, without a
    vector, or with a component that is null, NaN or infinite take no part. Repeated rows are rows of their own.
    """
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    clean = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(fit)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))
    return cut(clean.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *kept))


def parts_of(rows: int, most: int, least: int, cores: int) -> int:
    """Into how many parts so many rows go: by the bound `most`, and one for every core while each has `least` rows."""
    return max(1, -(-rows // most), min(cores, -(-rows // least)))


def in_cells(rows: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run(rows, queries)` for every block of rows and block of queries, each pair of blocks as one group.

    Both frames have `row` and the same columns. A block is a hash of `row`, so no value of the data makes one large:
    a group holds about MOST_ROWS rows and CELL_QUERIES queries. Every row goes to as many cells as there are blocks
    of queries, every query to as many as there are blocks of rows; nothing is sent whole.
    """
    spark = rows.sparkSession
    n_rows = parts_of(rows.count(), MOST_ROWS, LEAST_ROWS, spark.sparkContext.defaultParallelism)
    n_queries = parts_of(queries.count(), CELL_QUERIES, CELL_QUERIES, 1)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = (rows.select("*", block(n_rows).alias("_i"), every(n_queries).alias("_j"), F.lit(False).alias("_query"))
             .unionByName(queries.select("*", every(n_rows).alias("_i"), block(n_queries).alias("_j"), F.lit(True).alias("_query"))))
    names = [c.split()[0] for c in schema.split(", ")]

    def cell(group: pa.Table) -> pa.Table:
        asked = group.column("_query")
        return run(group.filter(pa.compute.invert(asked)), group.filter(asked)).select(names)

    return cells.groupBy("_i", "_j").applyInArrow(cell, schema)


def matrices(*tables: pa.Table) -> list[np.ndarray]:
    """The vectors of several tables, a row each; shorter ones are filled up with zeros.

    As doubles where every inner product of them is a whole number below 2**53, so that it is exact, else as longs,
    whose products wrap around at 64 bits.
    """
    lists = [t.column("v").combine_chunks() for t in tables]
    lengths = [np.diff(x.offsets.to_numpy()) for x in lists]
    width, out = max((int(n.max()) for n in lengths if len(n)), default=0), []
    for x, n in zip(lists, lengths):
        flat = x.flatten().to_numpy()
        if len(n) and n.min() == width:
            out.append(flat.reshape(len(n), width))
        else:
            full = np.zeros((len(n), width), np.int64)
            full[np.arange(width) < n[:, None]] = flat
            out.append(full)
    largest = max((float(np.abs(m.astype(np.float64)).max()) for m in out if m.size), default=0.0)
    return [m.astype(np.float64) for m in out] if largest * largest * width < 2.0 ** 53 else out


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def keep_best(found: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each key, numbered in `rank` from 1. Spark applies the limit before the shuffle as well."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
