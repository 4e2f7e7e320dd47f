"""Interval algebra on (media_id, start_ms, end_ms) tables.

Overlap is half-open: intervals that only touch do not overlap. Union merges
touching intervals. Measures, semi and anti overlap and nearest lookups are
sweeps over end points (see ``scan``): their cost is linear in the input rows
whatever the overlap. Only `overlap_join`, whose result is the pairs
themselves, builds pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.operators.scan import Axis, latest, peak, scan, total, upcoming
from timedspark.operators.stage import stage

MEDIA = ("media_id",)
# Each level's buckets are 16 times as wide as those below; the levels reach from 1 ms to centuries.
LEVELS = 12
# Meetings of a bucket, over three times the levels; a power of two.
PLACES = 64


def _last(start: Column, end: Column) -> Column:
    return F.greatest(end - 1, start)


def _last(start: Column, end: Column) -> Column:
    return F.greatest(end - 1, start)


def _bucket(value: Column, width: int, level: Column | None = None) -> Column:
    """Number of the bucket of `width` ms, or of `width` * 16^level."""
    lowest = F.floor(value / F.lit(width)).cast("bigint")
    return lowest if level is None else F.call_function("shiftright", lowest, level * 4)


def _level(start: Column, end: Column, width: int) -> Column:
    """Lowest level whose buckets are as wide as the span, which then touches at most two of them."""
    length = _last(start, end) - start + 1
    wider = [(length > F.lit(min(width * 16 ** k, 2 ** 62))).cast("int") for k in range(LEVELS - 1)]
    return sum(wider[1:], wider[0])


def overlap_places(df: DataFrame, span: tuple[str, str], width: int, others: Column, visits: int) -> DataFrame:
    """Add `__place` to each row, once per place where it can meet spans of the other side: bucket * 64 + meeting.

    A row is at home in the buckets of its own level and visits those of wider levels. Of a pair the shorter
    visits the longer, or both are at home, so two visitors never meet and a pair has one meeting: three times
    the level, and 0 at home, 1 or 2 when the left or right row visits. `others` has the bits of the levels of
    the other side; places at other levels are left out. A row has at most four places at home and two at each
    wider level, whatever its length.
    """
    start, end = (F.col(c) for c in span)
    level, there = F.col("__level"), F.col("__others")
    here = F.expr("shiftleft(1L, __level)")
    no_meetings = F.array().cast("array<struct<level: int, meeting: int>>")

    def at(on: Column, kind: int) -> Column:
        return F.struct(on.cast("int").alias("level"), (on * 3 + kind).cast("int").alias("meeting"))

    def places(on: Column, meeting: Column) -> Column:
        first, last = (_bucket(x, width, on) * PLACES + meeting for x in (start, _last(start, end)))
        return F.sequence(first, last, F.lit(PLACES).cast("bigint"))

    equal = F.when(there.bitwiseAND(here) != 0, F.array(at(level, 0))).otherwise(no_meetings)
    shorter = F.when(there.bitwiseAND(here - 1) != 0, F.array(at(level, 3 - visits))).otherwise(no_meetings)
    wider = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: (k > level) & (F.call_function("getbit", there, k) == 1))
    meetings = F.concat(equal, shorter, F.transform(wider, lambda k: at(k, visits)))
    # Most tables have short spans only; these meet in one set of buckets, without the general expression.
    plain = (level == 0) & (there == 1)
    found = F.when(plain, places(F.lit(0), F.lit(0))).otherwise(F.flatten(F.transform(meetings, lambda m: places(m["level"], m["meeting"]))))
    return (df.withColumn("__level", _level(start, end, width)).withColumn("__others", others)
            .withColumn("__place", F.explode(found)).drop("__level", "__others"))


def levels_of(df: DataFrame, span: tuple[str, str], width: int) -> Column:
    """Bits of the levels that the spans of `df` are on: a scalar subquery of one aggregate over two columns."""
    start, end = (F.col(c) for c in span)
    bits = df.select(_level(start, end, width).alias("level")).agg(F.bit_or(F.expr("shiftleft(1L, level)")))
    return F.coalesce(bits.scalar(), F.lit(0).cast("bigint"))


def overlap_join(left: DataFrame, right: DataFrame, width: int, keys: tuple[str, ...] = MEDIA,
                 left_span: tuple[str, str] = ("start_ms", "end_ms"),
                 right_span: tuple[str, str] = ("r_start_ms", "r_end_ms"),
                 salt: int = 1, long_spans: bool = False) -> DataFrame:
    """Inner join of overlapping pairs, each pair once.

    Both sides are cut into buckets of `width` ms and equi-joined on the
    bucket; a pair is kept only in the bucket that holds the later of the two
    starts, so no distinct is needed. Column names apart from `keys` must
    differ. `salt` spreads the left rows of a bucket over that many join keys,
    for buckets known to be hot; otherwise skew is left to adaptive execution.

    With `long_spans`, spans beyond `width` lie in wider buckets of their own
    level, so that none is copied into more than a few (see `overlap_places`);
    both sides are then read twice, first for the levels they have. Without,
    a span is copied into every bucket it touches: right where lengths are
    bounded by what made them. The pairs are the same.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    later = F.greatest(ls, rs)
    if long_spans:
        lhs = overlap_places(left, left_span, width, levels_of(right, right_span, width), 1)
        rhs = overlap_places(right, right_span, width, levels_of(left, left_span, width), 2)
        level = F.expr(f"int(pmod(__place, {PLACES}) div 3)")
        first = F.call_function("shiftright", "__place", F.lit(6)) == _bucket(later, width, level)
    else:
        lhs, rhs = (df.withColumn("__place", F.explode(F.sequence(_bucket(s, width), _bucket(_last(s, e), width))))
                    for df, s, e in ((left, ls, le), (right, rs, re)))
        first = F.col("__place") == _bucket(later, width)
    on = [*keys, "__place"]
    if salt > 1:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salt)).cast("int")
        lhs = lhs.withColumn("__salt", spread)
        rhs = rhs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("__salt")
    return lhs.join(rhs, on).filter((ls < re) & (le > rs) & first).drop("__place", "__salt")


def point_join(points: DataFrame, spans: DataFrame, width: int, at: str,
               span: tuple[str, str], keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Points with every closed span [start, end] that contains them."""
    moments = points.withColumn("__from", F.col(at)).withColumn("__to", F.col(at) + 1)
    closed = spans.withColumn("__end", F.col(span[1]) + 1)
    return overlap_join(moments, closed, width, keys, ("__from", "__to"), (span[0], "__end")
                        ).drop("__from", "__to", "__end")


def _furthest_ends(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per start. A map-side aggregate, which bounds a block by its number of distinct milliseconds."""
    return df.groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("end_ms"))


def union_ranges(df: DataFrame, keys: tuple[str, ...] = MEDIA, width: int = 600_000) -> DataFrame:
    """Merge overlapping or touching ranges.

    A merged range starts where a start lies beyond everything before it, and
    ends at the furthest end seen before the next such start. Only these
    starts take part in the second pass.
    """
    starts = _furthest_ends(df, keys)
    axis = Axis(keys, ("start_ms",), width)
    seen = scan(starts, axis, __reach=peak(F.col("end_ms")))
    heads = stage(seen.filter(F.col("__reach").isNull() | (F.col("start_ms") > F.col("__reach")))
                  .select(*keys, "start_ms", "__reach"))
    closed = scan(heads, axis, __end=upcoming(F.col("__reach")))
    last = df.groupBy(*keys).agg(F.max("end_ms").alias("__last"))
    return closed.join(last, list(keys)).select(*keys, "start_ms", F.coalesce("__end", "__last").alias("end_ms"))


def gaps(covered: DataFrame, durations: DataFrame, keys: tuple[str, ...] = MEDIA,
         width: int = 600_000) -> DataFrame:
    """Uncovered ranges of [0, duration_ms]; `covered` need not be merged. One pass."""
    ends = durations.select(*keys, F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"),
                            F.lit(1).alias("closing"))
    rows = _furthest_ends(covered, keys).withColumn("closing", F.lit(0)).unionByName(ends)
    axis = Axis(keys, ("start_ms", "closing"), width)
    seen = scan(rows, axis, cursor=peak(F.col("end_ms")))
    return (seen.select(*keys, F.greatest(F.coalesce("cursor", F.lit(0)), F.lit(0)).cast("bigint").alias("gap_start"),
                        F.col("start_ms").alias("gap_end"))
            .filter("gap_start < gap_end")
            .select(*keys, F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms")))


def subtract(ranges: DataFrame, removed: DataFrame, ident: list[str], width: int,
             keys: tuple[str, ...] = MEDIA, bucket: int | None = None) -> DataFrame:
    """Parts of every range left after removing `removed`; `ident` names a row within its key.

    Ranges are cut against the merged subtrahend, so pairs per range are
    bounded by the holes in it.
    """
    holes = union_ranges(removed, keys, width).select(
        *keys, F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"))
    base = ranges.select(*keys, *ident, "start_ms", "end_ms")
    cuts = overlap_join(base, holes, bucket or width, keys, long_spans=True).select(
        *keys, *ident, "start_ms", "end_ms",
        F.greatest("r_start_ms", "start_ms").alias("hole_start"),
        F.least("r_end_ms", "end_ms").alias("hole_end"))
    tails = base.select("*", F.col("end_ms").alias("hole_start"), F.col("end_ms").alias("hole_end"))
    axis = Axis((*keys, *ident), ("hole_start", "hole_end"), width)
    seen = scan(cuts.unionByName(tails), axis, cursor=latest(F.col("hole_end")))
    left = F.coalesce(F.col("cursor"), F.col("start_ms"))
    return (seen.select(*keys, *ident, left.alias("piece_start"), F.col("hole_start").alias("piece_end"))
            .filter("piece_start < piece_end")
            .select(*keys, *ident, F.col("piece_start").alias("start_ms"), F.col("piece_end").alias("end_ms")))


def flag_overlaps(rows: DataFrame, others: DataFrame, keys: tuple[str, ...] = MEDIA,
                  width: int = 600_000, span: tuple[str, str] = ("start_ms", "end_ms"),
                  name: str = "overlapped") -> DataFrame:
    """Mark rows that overlap any range of `others`.

    A row overlaps iff the furthest end among ranges starting before its end
    lies after its start: one running maximum, no pairs.
    """
    start, end = span
    reach = (others.groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("__end"))
             .select(*keys, F.col("start_ms").alias("__at"), F.lit(1).alias("__side"), "__end"))
    probes = rows.withColumn("__at", F.col(end)).withColumn("__side", F.lit(0))
    axis = Axis(keys, ("__at", "__side"), width)
    swept = scan(probes.unionByName(reach, allowMissingColumns=True), axis, __reach=peak(F.col("__end")))
    return (swept.filter("__side = 0")
            .withColumn(name, F.coalesce(F.col("__reach") > F.col(start), F.lit(False)))
            .select(*rows.columns, name))


def exclude_overlapping(rows: DataFrame, others: DataFrame, keys: tuple[str, ...] = MEDIA,
                        width: int = 600_000, span: tuple[str, str] = ("start_ms", "end_ms")) -> DataFrame:
    """Anti-join: rows that overlap no range of `others`."""
    return flag_overlaps(rows, others, keys, width, span, "__hit").filter("NOT __hit").drop("__hit")


def measure_within(queries: DataFrame, ident: list[str], regions: DataFrame | None = None,
                   counted: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = MEDIA,
                   width: int = 600_000) -> DataFrame:
    """Per query range: total overlap with `regions` and midpoint counts of word tables.

    `ident` names a query within its key. Regions are not merged first, so
    parallel regions count twice. For each `counted` name the result holds the
    number of rows whose midpoint m has start <= m < end.

    Both are differences of a running total at the two ends of the query:
    covered(t) = t * open(t) - sum(starts before t) + sum(ends before t).
    Positions are doubled so that midpoints stay integers. Input rows at one
    position are pre-aggregated.
    """
    counted = counted or {}
    zero = F.lit(0).cast("bigint")
    weights = ["opened", "moment", *counted]

    def rows(df: DataFrame, position: Column, **given: Column) -> DataFrame:
        return df.select(*keys, position.cast("bigint").alias("at"),
                         *[given.get(w, zero).alias(w) for w in weights])

    parts = []
    if regions is not None:
        parts.append(rows(regions, F.col("start_ms") * 2, opened=F.lit(1).cast("bigint"), moment=-F.col("start_ms")))
        parts.append(rows(regions, F.col("end_ms") * 2, opened=F.lit(-1).cast("bigint"), moment=F.col("end_ms")))
    for name, words in counted.items():
        parts.append(rows(words, F.col("start_ms") + F.col("end_ms"), **{name: F.lit(1).cast("bigint")}))
    stream = parts[0]
    for part in parts[1:]:
        stream = stream.unionByName(part)
    stream = stream.groupBy(*keys, "at").agg(*[F.sum(w).alias(w) for w in weights]).withColumn("side", F.lit(1))

    edges = queries.select(*keys, *ident, F.explode(F.array(
        F.struct((F.col("start_ms") * 2).alias("at"), F.lit(-1).cast("bigint").alias("sign")),
        F.struct((F.col("end_ms") * 2).alias("at"), F.lit(1).cast("bigint").alias("sign")),
    )).alias("edge")).select(*keys, *ident, "edge.at", "edge.sign").withColumn("side", F.lit(0))
    axis = Axis(keys, ("at", "side"), 2 * width)
    swept = scan(edges.unionByName(stream, allowMissingColumns=True), axis,
                 **{"__" + w: total(F.coalesce(F.col(w), zero)) for w in weights}).filter("side = 0")
    covered = F.expr("at div 2") * F.col("__opened") + F.col("__moment")
    return swept.groupBy(*keys, *ident).agg(
        *([F.sum(F.col("sign") * covered).alias("overlap_ms")] if regions is not None else []),
        *[F.sum(F.col("sign") * F.col("__" + n)).alias(n) for n in counted])


def nearest_value(rows: DataFrame, at: str, points: DataFrame, point: str, name: str,
                  keys: tuple[str, ...] = MEDIA, width: int = 600_000,
                  carry: list[str] | None = None) -> DataFrame:
    """Add the nearest `point` to `at` for every row; the smaller one wins a tie.

    `carry` names further columns of `points` to bring along, as a struct.
    Points are made distinct by position, lowest carried values first.
    """
    carried = [F.min(F.struct(F.col(point), *[F.col(c) for c in carry or []])).alias("__value")]
    grid = points.groupBy(*keys, F.col(point).alias("__at")).agg(*carried).withColumn("__side", F.lit(0))
    probes = rows.withColumn("__at", F.col(at)).withColumn("__side", F.lit(1))
    axis = Axis(keys, ("__at", "__side"), width)
    swept = scan(probes.unionByName(grid, allowMissingColumns=True), axis,
                 __below=latest(F.col("__value")), __above=upcoming(F.col("__value"))).filter("__side = 1")
    below, above = F.col("__below"), F.col("__above")
    near = (F.when(above.isNull(), below).when(below.isNull(), above)
            .when(F.col(at) - below[point] <= above[point] - F.col(at), below).otherwise(above))
    result = swept.withColumn("__near", near)
    if carry:
        return result.select(*rows.columns, F.col("__near").alias(name))
    return result.select(*rows.columns, F.col("__near")[point].alias(name))


def next_at_or_after(rows: DataFrame, at: str, points: DataFrame, point: str, name: str,
                     keys: tuple[str, ...] = MEDIA, width: int = 600_000) -> DataFrame:
    """Forward as-of: the first `point` at or after `at`, or null."""
    grid = points.select(*keys, F.col(point).alias("__at")).distinct().withColumn("__side", F.lit(1))
    probes = rows.withColumn("__at", F.col(at)).withColumn("__side", F.lit(0))
    axis = Axis(keys, ("__at", "__side"), width)
    swept = scan(probes.unionByName(grid, allowMissingColumns=True), axis,
                 **{name: upcoming(F.when(F.col("__side") == 1, F.col("__at")))})
    return swept.filter("__side = 0").select(*rows.columns, name)


def containing_contiguous(rows: DataFrame, at: str, tiles: DataFrame, start: str, carry: list[str],
                          keys: tuple[str, ...] = MEDIA, width: int = 600_000) -> DataFrame:
    """Point in interval for tiles without holes: the last tile starting at or before `at`."""
    grid = tiles.select(*keys, F.col(start).alias("__at"), F.struct(*carry).alias("__tile")).withColumn("__side", F.lit(0))
    probes = rows.withColumn("__at", F.col(at)).withColumn("__side", F.lit(1))
    axis = Axis(keys, ("__at", "__side"), width)
    swept = scan(probes.unionByName(grid, allowMissingColumns=True), axis, __found=latest(F.col("__tile")))
    return swept.filter("__side = 1").select(*rows.columns, *[F.col("__found")[c].alias(c) for c in carry])


def first_containing(points: DataFrame, at: str, spans: DataFrame, span: tuple[str, str], order: str,
                     width: int, ident: list[str], keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Point in closed interval for arbitrary spans: the lowest `order` that contains the point."""
    return (point_join(points, spans, width, at, span, keys)
            .groupBy(*keys, *ident).agg(F.min(order).alias(order)))


def tiles_whole(df: DataFrame, totals: DataFrame, start: str, end: str, total_name: str,
                keys: tuple[str, ...] = MEDIA, width: int = 4_096) -> DataFrame:
    """Per key: do the rows tile [0, total) in order without a hole or an empty tile?"""
    seen = scan(df, Axis(keys, (start, end), width), __prev=latest(F.col(end)))
    fits = (F.col(start) == F.coalesce("__prev", F.lit(0))) & (F.col(end) > F.col(start))
    checked = seen.groupBy(*keys).agg(F.bool_and(fits).alias("fits"), F.max(end).alias("last_end"))
    return totals.join(checked, list(keys), "left").select(
        *keys, F.coalesce(F.col("fits") & (F.col("last_end") == F.col(total_name)), F.lit(False)).alias("contiguous"))


def overlapping_chunks(media: DataFrame, size_ms: int, overlap_ms: int,
                       duration: str = "duration_ms") -> DataFrame:
    """Plan chunks of `size_ms` with `overlap_ms` shared by neighbours, up to the duration."""
    if not 0 <= overlap_ms < size_ms:
        raise ValueError("overlap must be non-negative and shorter than the chunk")
    step = size_ms - overlap_ms
    length = F.col(duration)
    # The last chunk is the first whose end reaches the duration.
    last = F.greatest(F.ceil((length - F.lit(size_ms)) / F.lit(step)), F.lit(0)).cast("int")
    return (media.filter(length > 0)
            .withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("start_ms", F.col("idx").cast("bigint") * step)
            .withColumn("end_ms", F.least(F.col("start_ms") + size_ms, length)))


def owned_ranges(chunks: DataFrame, keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Owned part of each chunk: up to the middle of the overlap with its neighbours.

    Doubled milliseconds (`left_x2`, `right_x2`) keep odd midpoints exact.
    """
    axis = Axis(keys, ("idx",), 4_096)
    seen = scan(chunks, axis, __before=latest(F.col("end_ms")), __after=upcoming(F.col("start_ms")))
    left = F.coalesce(F.col("__before") + F.col("start_ms"), F.lit(0).cast("bigint"))
    right = F.coalesce(F.col("end_ms") + F.col("__after"), F.col("end_ms") * 2)
    return seen.withColumn("left_x2", left).withColumn("right_x2", right).drop("__before", "__after")


def retry_windows(issues: DataFrame, durations: DataFrame, max_retry_ms: int, context_ms: int,
                  cap: int, keys: tuple[str, ...] = MEDIA) -> DataFrame:
    """Split issue ranges into cores that leave room for context, pad and clamp them.

    The first `cap` windows per key are the retry budget; cap is the feature.
    """
    core = max_retry_ms - 2 * context_ms
    cores = issues.withColumn("core", F.explode(F.sequence(
        F.col("start_ms"), F.greatest(F.col("end_ms") - 1, F.col("start_ms")), F.lit(core).cast("bigint"))))
    rows = (cores.select(*keys, F.col("core").alias("start_ms"),
                         F.least(F.col("core") + core, F.col("end_ms")).alias("end_ms")))
    numbered = scan(rows, Axis(keys, ("start_ms", "end_ms"), 600_000), window_no=total(F.lit(1), inclusive=True))
    return (numbered.filter(F.col("window_no") <= cap).join(durations, list(keys))
            .select(*keys, F.col("window_no").cast("bigint").alias("window_no"),
                    F.col("start_ms").alias("core_start"), F.col("end_ms").alias("core_end"),
                    F.greatest(F.col("start_ms") - context_ms, F.lit(0)).alias("start_ms"),
                    F.least(F.col("end_ms") + context_ms, F.col("duration_ms")).alias("end_ms")))
