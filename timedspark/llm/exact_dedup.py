"""Exact deduplication: counting quotient filters, then a comparison of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timedspark.llm.common import cut

#: Fixed value: the characters that do not count.
BLANKS = b" \t\n\x0b\x0c\r"
#: Fingerprints a filter holds before a task sends it off and begins another.
FILTER_ROWS = 1 << 20
#: Repeated fingerprints up to which they are broadcast (16 bytes each).
BROADCAST_ROWS = 200_000

FILTERS = "block int, remainders binary, counts binary"


def build_filter(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and how often each came: the runs and counters of a counting quotient filter."""
    return np.unique(fingerprints.astype(np.uint64), return_counts=True)


def merge_filters(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One filter from several: runs merge by sorted remainder, counters of equal remainders add up. Nothing is lost."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    remainders, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order].astype(np.int64)
    heads = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]]) if len(remainders) else np.empty(0, int)
    return remainders[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _filters(bits: int):
    """Filters of a partition, in blocks of the quotient's leading bits: block, remainders, counts."""
    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = build_filter(np.concatenate(held)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        quotient = (values >> np.uint64(64 - bits)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(values) else np.empty(0, int)
        ends = np.r_[heads[1:], len(values)]
        rest = values & np.uint64((1 << (64 - bits)) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(quotient[heads].astype(np.int32)), pa.array([rest[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()),
             pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(heads, ends)], pa.binary())], ["block", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield blocks(held)
                held = []
        if held:
            yield blocks(held)
    return run


def _repeated(bits: int):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64)) for r, c in zip(rows["remainders"], rows["counts"])]
        remainders, counts = merge_filters(parts)
        twice = counts > 1
        whole = remainders[twice] | (np.uint64(key[0]) << np.uint64(64 - bits))
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counts[twice]})
    return merge


def repeated_fingerprints(prints: DataFrame, rows: int, column: str = "fp", rows_per_block: int = 1 << 16) -> DataFrame:
    """Fingerprints (64-bit longs in `column`) that come more than once: fp, n.

    Each task turns its rows into filters, so a frequent fingerprint leaves a task as one entry.
    Blocks follow the number of rows, so a merge holds about `rows_per_block` entries a task that fed it.
    """
    bits = max(6, (max(rows, 1) // rows_per_block).bit_length())
    return (prints.select(column).mapInArrow(_filters(bits), FILTERS)
            .groupBy("block").applyInPandas(_repeated(bits), "fp long, n long"))


def _normalised(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        bare = [t.encode().translate(None, BLANKS) if t else b"" for t in texts]
        digests = [hashlib.sha256(b).digest() for b in bare]
        out = {"doc_id": batch.column("doc_id"), "n_cp": pa.array([len(t) if t else 0 for t in texts], pa.int64()),
               "fp": pa.array(np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64).view(np.int64), pa.int64())}
        out |= {"bare": pa.array(bare, pa.binary())} if keep_text else {"sha": pa.array(digests, pa.binary())}
        yield pa.RecordBatch.from_pydict(out)


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (hex, of the text without blanks).

    Texts are equal when they are the same bytes after deleting space and the
    control characters 9 to 13; null counts as empty. Of equal texts the row with the most code points
    in the original, then the smallest doc_id (null last) stays. The fingerprint
    is the head of the SHA-256. Counting quotient filters, built per partition and merged by block,
    give every fingerprint that comes twice; only texts with such a fingerprint
    are compared, byte by byte, by grouping on the bytes themselves.

    All rows of a group get the same keep_id. Where the row that stays is repeated whole, one of the
    repeats is kept. An empty table gives an empty result; other columns are not read.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    narrow = cut(given.mapInArrow(lambda b: _normalised(b, False), f"doc_id {kind}, n_cp long, fp long, sha binary"))
    repeated = cut(repeated_fingerprints(narrow, narrow.count()))
    n_repeated = repeated.count()
    only = repeated.select("fp")
    bare = given.mapInArrow(lambda b: _normalised(b, True), f"doc_id {kind}, n_cp long, fp long, bare binary")
    routed = bare.join(F.broadcast(only) if n_repeated <= BROADCAST_ROWS else only, "fp", "left_semi")
    equal = routed.groupBy("bare", "n_cp").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    best = F.min(F.struct((-F.col("n_cp")).alias("short"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"))).alias("best")
    classes = (equal.select(F.unhex(F.sha2("bare", 256)).alias("sha"), "n_cp", "n", "doc_id").groupBy("sha").agg(F.sum("n").alias("group_size"), best)
               .where("group_size > 1").select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.short")).alias("longest")))
    twin = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy(F.desc("n_cp")))
    joined = narrow.withColumn("twin", twin).join(classes, "sha", "left")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("longest")) & (F.col("twin") == 1)
    single = F.col("group_size").isNull()
    return joined.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (single | stays).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
