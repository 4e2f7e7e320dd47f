"""Box, shot and crop queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timedspark.functions import geometry as G
from timedspark.operators import frames as R
from timedspark.operators.intervals import containing_contiguous
from timedspark.operators.scan import FRAMES
from timedspark.operators.stage import stage
from timedspark.plans import bind
from timedspark.plans.registry import query

WIDTH, HEIGHT, BIG = 1_920, 1_080, "bigint"
KEYS = ["media_id", "frame"]
CUT = 0.165


def box_order():
    return Window.partitionBy(*KEYS).orderBy("x", "y", "w", "h")


def numbered_boxes(spark, sf, extra=()):
    """Distinct boxes with a number per frame (frames hold a few boxes).

    Equal boxes stand together in the order that numbers them, and the first stays: one shuffle and one sort, which
    spills, where a distinct before the numbers would hold the boxes of a task in a hash table and shuffle them twice.
    """
    number, place, row = (f().over(box_order()) for f in (F.dense_rank, F.rank, F.row_number))
    return (bind.detections(spark, sf).select(*KEYS, "x", "y", "w", "h")
            .select("*", number.alias("person"), (place == row).alias("first")).filter("first").drop("first"))


def face_boxes(spark, sf):
    """A face inside some boxes, a little to the right of the middle."""
    b = numbered_boxes(spark, sf).filter("(x + y) % 3 <> 0")
    return b.select(*KEYS, F.col("person").alias("face"), (F.col("x") + F.floor(F.col("w") / 3)).alias("x"),
                    (F.col("y") + 5).alias("y"), F.floor(F.col("w") / 4).alias("w"), F.floor(F.col("h") / 8).alias("h"))


@query("person_boxes")
def person_boxes(spark, sf):
    d = bind.detections(spark, sf)
    raw = d.select(*KEYS, "det", "confidence", F.col("x").alias("x1"), F.col("y").alias("y1"),
                   (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), (F.col("y") % 3).alias("cls"))
    return R.person_boxes(raw).select(*KEYS, "det", "x", "y", "w", "h")


@query("foreground_boxes")
def foreground_boxes(spark, sf):
    return R.foreground(bind.detections(spark, sf), HEIGHT, 0.3, 0.6).select(*KEYS, "det", "x", "y", "w", "h")


@query("foreground_faces")
def foreground_faces(spark, sf):
    return R.foreground_faces(face_boxes(spark, sf), HEIGHT).select(*KEYS, "face", "h")


@query("wide_frames")
def wide_frames(spark, sf):
    return R.wide_frames(bind.detections(spark, sf), bind.media_frames(spark, sf), WIDTH, HEIGHT)


@query("hit_rates")
def hit_rates(spark, sf):
    r = R.hit_rates(bind.detections(spark, sf), bind.media_frames(spark, sf))
    return r.select("media_id", "frames", F.round("person_rate", 6).alias("person_rate"), F.round("multi_rate", 6).alias("multi_rate"))


@query("largest_box")
def largest_box(spark, sf):
    return R.largest_box(bind.detections(spark, sf))


@query("best_performer")
def best_performer(spark, sf):
    lit = bind.detections(spark, sf).withColumn("brightness", (F.col("det") % 256) / 255.0)
    return R.best_performer(lit, HEIGHT, 0.25 * HEIGHT, 1.0, 0.5)


def panels(spark, sf):
    spans = F.array(*[F.struct(F.lit(i).alias("panel"), F.lit(a).alias("left"), F.lit(b).alias("right"))
                      for i, (a, b) in enumerate([(0, 630), (650, 1_270), (1_290, 1_920)])])
    return bind.media_frames(spark, sf).withColumn("p", F.explode(spans)).select(*KEYS, "p.*")


@query("nearest_panel")
def nearest_panel(spark, sf):
    points = numbered_boxes(spark, sf).select(*KEYS, "person", (F.col("x") + F.col("w") / 2).alias("x_center"))
    return R.nearest_panel(points, panels(spark, sf)).select(*KEYS, "person", "panel")


@query("prominent_panels")
def prominent_panels(spark, sf):
    return R.prominent_panels(numbered_boxes(spark, sf), panels(spark, sf)).select(*KEYS, "panel", "area", "place")


@query("face_match")
def face_match(spark, sf):
    boxed = lambda df: df.withColumn("box", G.box("x", "y", "w", "h")).drop("x", "y", "w", "h")
    m = R.match_faces(boxed(face_boxes(spark, sf)), boxed(numbered_boxes(spark, sf)))
    return m.select(*KEYS, "face", "person", F.round("score", 6).alias("score"))


@query("distinct_subjects")
def distinct_subjects(spark, sf):
    """Ten consecutive vectors are the faces of one frame."""
    e = bind.table(spark, sf, "embeddings")
    v = F.col("vec_id")
    faces = e.select(F.floor(v / 250).cast(BIG).alias("media_id"), F.floor(v / 10).cast(BIG).alias("frame"), v.alias("face"),
                     F.col("embedding").alias("feature"),
                     G.box((v % 10) * 60, F.lit(0).cast(BIG), 100 + v * 7 % 50, 100 + v * 13 % 50).alias("box"))
    return R.distinct_subjects(faces, 0.05)


@query("signature_changes")
def signature_changes(spark, sf):
    c = R.signature_changes(bind.signatures(spark, sf))
    return c.select(*KEYS, F.round("d1", 6).alias("d1"), F.round("d6", 6).alias("d6"))


def cuts(spark, sf):
    return R.shot_cuts(stage(R.signature_changes(bind.signatures(spark, sf))), CUT)


@query("shot_cuts")
def shot_cuts(spark, sf):
    return cuts(spark, sf)


@query("shots")
def shots(spark, sf):
    lengths = bind.signatures(spark, sf).groupBy("media_id").agg((F.max("frame") + 1).alias("frames"))
    return R.shots_from_cuts(stage(cuts(spark, sf)), lengths)


@query("frame_shot")
def frame_shot(spark, sf):
    frames = bind.signatures(spark, sf).select(*KEYS)
    lengths = frames.groupBy("media_id").agg((F.max("frame") + 1).alias("frames"))
    tiles = stage(R.shots_from_cuts(stage(cuts(spark, sf)), lengths))
    return containing_contiguous(frames, "frame", tiles, "start_frame", ["start_frame", "end_frame"], width=4_096)


@query("smoothed_centers")
def smoothed_centers(spark, sf):
    best = R.largest_box(bind.detections(spark, sf)).select(*KEYS, (F.col("x") + F.col("w") / 2).alias("x"))
    frames = (bind.media_frames(spark, sf).join(best, KEYS, "left")
              .withColumn("segment", F.floor(F.col("frame") / 37)).withColumn("panel", F.floor(F.col("frame") / 50) % 2))
    out = R.smoothed_centers(stage(frames), WIDTH, 3)
    center = F.round(F.col("center") + 1e-9, 6)  # keeps exact halves from depending on the last bit
    return out.select(*KEYS, "target", center.alias("center"), G.crop_left(center, WIDTH, 608).alias("crop_x"))


@query("locked_crops")
def locked_crops(spark, sf):
    frames = bind.media_frames(spark, sf).withColumn("shot", F.floor(F.col("frame") / 100))
    return R.locked_crops(R.boxes_per_frame(numbered_boxes(spark, sf), frames), WIDTH, 608).select(*KEYS, "shot", "crop_x")


@query("follow_primary")
def follow_primary(spark, sf):
    b = numbered_boxes(spark, sf).withColumn("face_x", F.when((F.col("x") + F.col("y")) % 3 == 0, F.col("x") + F.col("w") / 3))
    out = R.follow_primary(R.boxes_per_frame(b, bind.media_frames(spark, sf), "face_x"), 2)
    return out.select(*KEYS, *[F.round(F.col("primary")[c], 6).alias(c) for c in "xywh"])


@query("online_clusters")
def online_clusters(spark, sf):
    best = R.largest_box(bind.detections(spark, sf)).select(*KEYS, (F.col("x") + F.col("w") / 2).alias("x"))
    return R.online_clusters(best).select(*KEYS, "cluster")


@query("drifting_tracks")
def drifting_tracks(spark, sf):
    best = R.largest_box(bind.detections(spark, sf)).select(*KEYS, (F.col("x") + F.col("w") / 2).alias("x"))
    return R.online_clusters(best, drift=0.1).select(*KEYS, "cluster")


@query("link_speakers")
def link_speakers(spark, sf):
    media = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("media_id"))
    turns = (media.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
             .select("media_id", F.concat(F.lit("S"), (F.col("k") % 3).cast("string")).alias("speaker_id"),
                     (F.col("k") * 1_000).cast(BIG).alias("start_ms"),
                     (F.col("k") * 1_000 + 400 + (F.col("media_id") * 7 + F.col("k") * 131) % 600).cast(BIG).alias("end_ms")))
    d = numbered_boxes(spark, sf)
    samples = d.select(*KEYS, F.floor(F.col("x") / 400).cast("int").alias("cluster"),
                       F.when(F.col("media_id") % 4 != 0, F.col("h")).otherwise(F.lit(7)).cast("double").alias("openness"))
    return R.link_speakers(turns, samples, 30.0)


@query("portrait_boxes")
def portrait_boxes(spark, sf):
    d = numbered_boxes(spark, sf)
    b = G.portrait_box(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 8, F.col("y") + F.col("h") / 4, WIDTH, HEIGHT, 1.125)
    return d.withColumn("b", b).select(*KEYS, "person", *[F.col("b")[c].alias(c) for c in "xywh"])


@query("panel_crops")
def panel_crops(spark, sf):
    d = numbered_boxes(spark, sf)
    left = (F.floor(F.col("x") / 640) * 640).cast("int")
    b = G.fit_in_panel(G.box("x", "y", F.col("w") * 3, F.col("h") * 3), left, left + 640, HEIGHT, F.col("y") + F.col("h") / 8)
    return d.withColumn("b", b).select(*KEYS, "person", *[F.col("b")[c].cast(BIG).alias(c) for c in "xywh"])


@query("box_overlaps")
def box_overlaps(spark, sf):
    """IoU of each box with the next one of its frame, and whether its face is visible in the other."""
    d = numbered_boxes(spark, sf)
    # The order of the numbers, by the columns that the boxes are sorted by already.
    b = d.withColumn("box", G.box("x", "y", "w", "h")).withColumn("other", F.lead("box").over(box_order())).filter("other IS NOT NULL")
    face = G.box(F.col("x") + F.floor(F.col("w") / 3), F.col("y") + 5, F.floor(F.col("w") / 4), F.floor(F.col("h") / 8))
    return b.select(*KEYS, "person", F.round(G.iou(F.col("box"), F.col("other")), 6).alias("iou"),
                    G.face_visible(face, F.col("other")).alias("visible"))


@query("layout_panels")
def layout_panels(spark, sf):
    best = R.prominent_panels(numbered_boxes(spark, sf), panels(spark, sf))
    layouts = bind.media_frames(spark, sf).withColumn("layout", F.floor(F.col("frame") / 60).cast(BIG))
    chosen = R.panels_per_layout(best, layouts)
    return chosen.select("media_id", "layout", "frame", F.array_join(F.transform("panels", lambda p: p.cast("string")), ",").alias("panels"))


@query("shot_samples")
def shot_samples(spark, sf):
    lengths = bind.signatures(spark, sf).groupBy("media_id").agg((F.max("frame") + 1).alias("frames"))
    tiles = R.shots_from_cuts(stage(cuts(spark, sf)), lengths)
    return R.inset_samples(tiles, 30.0, 3).select("media_id", "start_frame", "frame")
