"""Blocked running values equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from timedspark.operators import sequence as S
from timedspark.operators.scan import Axis, islands, latest, peak, scan, total, upcoming


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for media in ("hot", "a", "b"):
        count = n if media == "hot" else 20
        out += [(media, i, rng.choice([None, rng.randrange(50)]), rng.randrange(4) == 0) for i in range(count)]
    return out


def test_scan_equals_plain_windows(table):
    df = table(rows(1), "media_id STRING, frame BIGINT, v BIGINT, flag BOOLEAN")
    axis = Axis(("media_id",), ("frame",), 7)
    got = scan(df, axis, t=total(F.coalesce("v", F.lit(0))), ti=total(F.coalesce("v", F.lit(0)), inclusive=True), p=peak(F.col("v")),
               l=latest(F.col("v")), li=latest(F.col("v"), inclusive=True), u=upcoming(F.col("v")))
    w = Window.partitionBy("media_id").orderBy("frame")
    back, with_self = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select("*", F.coalesce(F.sum("v").over(back), F.lit(0)).alias("t"), F.coalesce(F.sum("v").over(with_self), F.lit(0)).alias("ti"),
                     F.max("v").over(back).alias("p"), F.last("v", True).over(back).alias("l"), F.last("v", True).over(with_self).alias("li"),
                     F.first("v", True).over(ahead).alias("u"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_islands_across_blocks(table):
    df = table([("m", i, g) for i, g in enumerate([0, 0, 9, 0, 0, 0, 0, 9, 0, 0])], "media_id STRING, frame BIGINT, gap BIGINT")
    for width in (1, 3, 100):
        got = islands(df, Axis(("media_id",), ("frame",), width), {}, F.col("gap") > 5)
        assert [r.island for r in got.orderBy("frame").collect()] == [0, 0, 2, 2, 2, 2, 2, 7, 7, 7]


def test_rolling_halo_equals_plain_window(table):
    df = table(rows(2), "media_id STRING, frame BIGINT, v BIGINT, flag BOOLEAN")
    got = S.rolling(df, Axis(("media_id",), ("frame",), 10), 3, 4, s=F.sum("v"))
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("media_id").orderBy("frame").rangeBetween(-3, 4)))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_percentile_equals_numpy(table):
    import numpy as np
    rng = random.Random(3)
    values = [rng.random() * 100 for _ in range(333)] + [5.0] * 40
    df = table([("m", v) for v in values], "media_id STRING, v DOUBLE")
    got = S.exact_percentile(df, ("media_id",), "v", 0.95, 10, width=16).first()[1]
    assert abs(got - np.percentile(values, 95)) < 1e-9
