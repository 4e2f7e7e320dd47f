"""Sharding by sampled splitters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timedspark.llm.common import aside, cut, fresh


#: How often overfull ranges are subdivided; a record that is larger than a range stays one.
ROUNDS = 3


def text_bytes(text: Column) -> Column:
    """Size of a record: UTF-8 bytes of the text, none for null, plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _passed(splitters: list[int], key: Column, strict: bool) -> Column:
    """How many splitters lie below `key` (strict) or at most at it: binary search over a literal array."""
    jumps = [1 << k for k in range(max(len(splitters), 1).bit_length() - 1, -1, -1)]
    keys = _longs(splitters)

    def step(low: Column, jump: Column) -> Column:
        at = F.try_element_at(keys, low + jump)
        goes = (at < key) if strict else (at <= key)
        return F.when((low + jump <= len(splitters)) & goes, low + jump).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), step)


def shard_by_splitters(docs: DataFrame, shards: int = 8, text: str = "text", ranges_per_shard: int = 16,
                       range_bytes: int = 256 << 20, samples_per_range: int = 200, whole_group: float = 0.01,
                       seed: int = 17, order: str | None = None) -> DataFrame:
    """Add `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard); the shards' bytes are near equal.

    Records are ordered by the hash of their text. A sample in which a record's
    chance grows with its size gives quantile boundaries of that order, and each
    record goes to the range between two boundaries. A key that takes several
    boundaries overfills its range: its records are spread over all the ranges
    it takes. The exact sizes of the ranges, and running sizes inside them, then
    cut the whole order into shards.

    Equal texts share a shard if together they weigh at most `whole_group` of
    one; a larger group is cut where the sizes ask for it. Ranges follow the
    input, one per `range_bytes`, so no task sorts more than a few of these; the
    driver holds three longs a range.

    `order` names a column of longs to order by in place of the text's hash; where its values differ, equal texts part.

    Null texts are one group, of size 1 a record; nulls elsewhere do not matter.
    Repeated rows are records of their own with slots of their own. An empty
    table gives an empty result. Columns named `shard` or `slot` are kept under
    a longer name.
    """
    docs = aside(docs, "shard", "slot")
    names = docs.columns
    key, size, draw, low, high, part, run, row, first, group = (
        fresh(docs, f"_{x}") for x in ("key", "size", "draw", "low", "high", "range", "run", "row", "first", "group"))
    others = [F.col(c) for c, kind in docs.dtypes if c != text and not kind.startswith(("map", "variant"))]
    keyed = docs.select("*", (F.col(order) if order else F.xxhash64(text)).alias(key), text_bytes(F.col(text)).alias(size),
                        F.xxhash64(F.lit(seed), *([order] if order else [text, *others])).alias(draw))

    total = keyed.agg(F.sum(size)).first()[0] or 0
    ranges = max(shards * ranges_per_shard, -(-total // range_bytes))
    share = max(total / ranges, 1.0)

    def quantiles(rows: DataFrame, n: int, *by: str) -> list:
        """Rows of (by, n - 1 boundaries of the key), from a sample of `samples_per_range` records a share of bytes."""
        per_sample = max(share / samples_per_range, 1.0)
        drawn = rows.where(F.pmod(F.xxhash64(draw), F.lit(1 << 40)) < F.col(size) / per_sample * (1 << 40))
        times = F.greatest(F.lit(1), (F.col(size) / per_sample).cast("int"))
        points = F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 10 * n))
        return drawn.select(*by, key, F.explode(F.sequence(F.lit(1), times))).groupBy(*by).agg(points.alias("points")).collect()

    splitters, rounds = next((r["points"] for r in quantiles(keyed, ranges)), None) or [], 0
    while True:
        placed = keyed.select("*", _passed(splitters, F.col(key), True).alias(low), _passed(splitters, F.col(key), False).alias(high))
        heavy = F.col(high) - F.col(low) >= 2
        placed = placed.withColumn(part, F.when(heavy, F.col(low) + F.pmod(F.col(draw), F.col(high) - F.col(low) + 1)).otherwise(F.col(high)).cast("int"))
        sizes, counts = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
        for k, n_bytes, n_rows in placed.groupBy(part).agg(F.sum(size), F.count("*")).collect():
            sizes[k], counts[k] = n_bytes, n_rows
        overfull = [k for k, n_bytes in enumerate(sizes) if n_bytes > 2 * share]
        if not overfull or rounds == ROUNDS:
            break
        most = -(-max(sizes) // int(share))
        found = quantiles(placed.where(F.col(part).isin(overfull)), int(most), part)
        splitters, rounds = sorted([*splitters, *(x for r in found for x in r["points"] or [])]), rounds + 1
    bytes_before, rows_before = (F.element_at(_longs(_running(xs)), F.col(part) + 1) for xs in (sizes, counts))

    order = Window.partitionBy(part).orderBy(key, draw)
    same = Window.partitionBy(part, key)
    ran = placed.select("*", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(run),
                        (F.row_number().over(order) - 1 + rows_before).alias(row))
    ran = ran.select("*", F.sum(size).over(same).alias(group), F.min(F.col(run) - F.col(size)).over(same).alias(first))
    whole = ~heavy & (F.col(group) <= whole_group * total / shards)
    middle = bytes_before + F.when(whole, F.col(first) + F.col(group) / 2).otherwise(F.col(run) - F.col(size) / 2)
    sharded = ran.select(*names, row, F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int").alias("shard"))

    starts = {k: n for k, n in sharded.groupBy("shard").agg(F.min(row)).collect()}
    start = F.element_at(_longs([starts.get(k, 0) for k in range(shards)]), F.col("shard") + 1)
    return sharded.select(*names, "shard", (F.col(row) - start).alias("slot"))


def shard_in_random_order(docs: DataFrame, shards: int = 8, seed: int = 31, **options) -> DataFrame:
    """Shards of near equal bytes, in an order that has nothing to do with the texts: copies of a text lie anywhere.

    The place of a record is hashed from the file and the row it was read from; records that come from no file are
    first written with numbers of their own. Otherwise as `shard_by_splitters`.
    """
    place = fresh(docs, "_place")
    try:
        placed = docs.select("*", F.xxhash64(F.lit(seed), F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(place))
        placed.schema  # fails here where rows have no file
    except AnalysisException:
        placed = cut(docs.select("*", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias(place)))
    return shard_by_splitters(placed, shards, seed=seed, order=place, **options).drop(place)


def _running(xs: list[int]) -> list[int]:
    out, total = [], 0
    for x in xs:
        out.append(total)
        total += x
    return out
