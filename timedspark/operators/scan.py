"""Ordered running values that never put one whole key into one task.

A plain ``Window.partitionBy(media_id)`` sorts a whole recording in a single
task, so one very long recording decides the run time. Here each key is cut
into blocks of a fixed width on its order column. A local window runs per
(key, block), one summary row per block is carried across the key, and the
carry joins back on (key, block), which is the partitioning the local window
already produced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.operators.stage import stage

BLOCK = "__block"


@dataclass(frozen=True)
class Axis:
    """Keys, order columns (the first is an integer) and block width on that first column."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int

    def block(self) -> Column:
        return F.floor(F.col(self.order[0]) / F.lit(self.width)).cast("bigint")

    def keyed(self, *extra: str) -> Axis:
        return replace(self, keys=self.keys + extra)


def word_number(turn: Column, position: Column) -> Column:
    """Order number of a word: its turn above its 32-bit position, so no turn can run into the next."""
    return F.shiftleft(turn.cast("bigint"), 32) + position


# Blocks of words end with their turn; a long turn is several blocks.
WORDS = Axis(("media_id",), ("seq",), 8_192)
FRAMES = Axis(("media_id",), ("frame",), 4_096)
TIMES = Axis(("media_id",), ("start_ms",), 600_000)


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    inclusive: bool = False


def total(value: Column, inclusive: bool = False) -> Running:
    """Sum of the earlier rows (and this one when inclusive); 0 when there are none."""
    return Running("total", value, inclusive)


def peak(value: Column, inclusive: bool = False) -> Running:
    """Maximum of the earlier rows."""
    return Running("peak", value, inclusive)


def latest(value: Column, inclusive: bool = False) -> Running:
    """Last non-null value of the earlier rows."""
    return Running("latest", value, inclusive)


def upcoming(value: Column, inclusive: bool = False) -> Running:
    """First non-null value of the later rows."""
    return Running("upcoming", value, inclusive)


def scan(df: DataFrame, axis: Axis, **specs: Running) -> DataFrame:
    """Add one running column per spec."""
    order = [F.col(c) for c in axis.order]
    backwards = [F.col(c).desc() for c in axis.order]
    # One primitive order column keeps the block summary a hash aggregate.
    at = order[0] if len(order) == 1 else F.struct(*order)
    local_keys = [*axis.keys, BLOCK]
    blocked = df.withColumn(BLOCK, axis.block())

    def frame(spec: Running):
        ordering = backwards if spec.kind == "upcoming" else order
        return (Window.partitionBy(*local_keys).orderBy(*ordering)
                .rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1))

    across = Window.partitionBy(*axis.keys).rowsBetween(Window.unboundedPreceding, -1)
    # A running value in blocks: fold the block, fold the blocks before it, combine both.
    block_fold = {
        "total": F.sum,
        "peak": F.max,
        "latest": lambda v: F.max_by(v, F.when(v.isNotNull(), at)),
        "upcoming": lambda v: F.min_by(v, F.when(v.isNotNull(), at)),
    }
    row_fold = {
        "total": F.sum,
        "peak": F.max,
        "latest": lambda v: F.last(v, ignorenulls=True),
        "upcoming": lambda v: F.last(v, ignorenulls=True),
    }
    combine = {
        "total": lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)),
        "peak": lambda near, far: F.greatest(near, far),
        "latest": lambda near, far: F.coalesce(near, far),
        "upcoming": lambda near, far: F.coalesce(near, far),
    }

    blocks = blocked.groupBy(*local_keys).agg(
        *[block_fold[s.kind](s.value).alias(n) for n, s in specs.items()])
    carry = blocks.select(*local_keys, *[
        row_fold[s.kind](F.col(n)).over(
            across.orderBy(F.col(BLOCK).desc() if s.kind == "upcoming" else F.col(BLOCK))
        ).alias("__far_" + n) for n, s in specs.items()])
    near = blocked.select("*", *[
        row_fold[s.kind](s.value).over(frame(s)).alias("__near_" + n) for n, s in specs.items()])
    joined = near.join(carry, local_keys, "left")  # left: a row without a key or position is kept
    return joined.select(
        *[c for c in df.columns if c not in specs],
        *[combine[s.kind](F.col("__near_" + n), F.col("__far_" + n)).alias(n)
          for n, s in specs.items()])


def islands(df: DataFrame, axis: Axis, previous: dict[str, Running], breaks: Column,
            name: str = "island") -> DataFrame:
    """Number runs of rows; a run starts where `breaks` holds or there is no earlier row.

    `breaks` may use the `previous` columns, which are dropped again. The id
    is the order value of the first row of the run, so it is unique per key.
    """
    seen = scan(df, axis, __any=latest(F.lit(1)), **previous)
    head = F.when(F.col("__any").isNull() | breaks, F.col(axis.order[0]))
    marked = stage(seen.select(*df.columns, head.alias("__head")))
    return scan(marked, axis, **{name: latest(F.col("__head"), inclusive=True)}).drop("__head")


def with_halo(df: DataFrame, axis: Axis, before: int, after: int) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block, for bounded frames.

    Adds BLOCK and `__home`; compute the window per (key, BLOCK) and keep rows
    with `__home`. `before` and `after` are reaches on the order column and
    must not exceed the block width.
    """
    position = F.col(axis.order[0])
    home = axis.block()
    low = F.floor((position - F.lit(after)) / F.lit(axis.width)).cast("bigint")
    high = F.floor((position + F.lit(before)) / F.lit(axis.width)).cast("bigint")
    return (df.withColumn("__native", home)
            .withColumn(BLOCK, F.explode(F.sequence(low, high)))
            .withColumn("__home", F.col(BLOCK) == F.col("__native"))
            .drop("__native"))
