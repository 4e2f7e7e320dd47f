"""Column functions on boxes. A box is four columns (x, y, w, h) or a struct with those fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(col(x).alias("x"), col(y).alias("y"), col(w).alias("w"), col(h).alias("h"))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection(a: Column, b: Column) -> Column:
    """Shared area of two boxes; 0 when they only touch."""
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((across > 0) & (down > 0), across * down).otherwise(F.lit(0))


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def face_person_score(face: Column, person: Column) -> Column:
    """Share of the face inside the person, or 0 when the face cannot belong to it."""
    centre = face["y"] + face["h"] / 2
    inside = F.try_divide(intersection(face, person), area(face))
    possible = ((person["w"] > 0) & (person["h"] > 0) & (face["w"] > 0) & (face["h"] > 0)
                & (centre >= person["y"]) & (centre <= person["y"] + person["h"] * 0.6)
                & (face["w"] >= person["w"] * 0.05))
    return F.when(possible & (inside >= 0.5), inside).otherwise(F.lit(0.0))


def face_visible(face: Column, crop: Column, share: float = 0.95) -> Column:
    return intersection(face, crop) / F.greatest(area(face), F.lit(1)) >= share


def crop_left(center: Column, source_width: int, crop_width: int) -> Column:
    """Left edge of a crop around `center`, kept inside the source. Halves round to even."""
    left = F.rint(center - crop_width / 2).cast("int")
    return F.greatest(F.lit(0), F.least(left, F.lit(source_width - crop_width)))


def fit_in_panel(b: Column, panel_left: Column, panel_right: Column, source_height: int,
                 focus_y: Column | None = None) -> Column:
    """Shrink a box to its panel keeping its shape, then move it inside."""
    width = panel_right - panel_left
    scale = F.least(F.lit(1.0), width / F.greatest(F.lit(1), b["w"]), source_height / F.greatest(F.lit(1), b["h"]))
    w = F.greatest(F.lit(1), F.least(width, F.rint(b["w"] * scale).cast("int")))
    h = F.greatest(F.lit(1), F.least(F.lit(source_height), F.rint(b["h"] * scale).cast("int")))
    x = F.greatest(panel_left, F.least(panel_right - w, F.rint(b["x"] + (b["w"] - w) / 2).cast("int")))
    y = b["y"] if focus_y is None else F.when(h < b["h"], F.rint(focus_y - h * 0.5)).otherwise(b["y"])
    y = F.greatest(F.lit(0), F.least(source_height - h, y.cast("int")))
    return box(x, y, w, h)


def portrait_box(nose_x: Column, nose_y: Column, shoulder_y: Column, source_width: int, source_height: int,
                 aspect: float, snap: int = 8) -> Column:
    """Crop from 1.5 head heights above the nose to 3.5 below, on a grid of `snap` pixels."""
    grid = lambda v: (F.rint(v / snap) * snap).cast("int")
    head = F.greatest(F.lit(8.0), F.abs(shoulder_y - nose_y))
    top = nose_y - head * 1.5
    height = F.least((nose_y + head * 3.5) - top, F.lit(float(source_height)), F.lit(source_width / aspect))
    h = F.greatest(F.lit(1), F.least(F.lit(source_height), grid(height)))
    w = F.greatest(F.lit(1), F.least(F.lit(source_width), grid(height * aspect)))
    x = F.greatest(F.lit(0), F.least(source_width - w, grid(nose_x - w / 2)))
    y = F.greatest(F.lit(0), F.least(source_height - h, grid(top)))
    return box(x, y, w, h)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null when a norm is zero or not finite."""
    add = lambda acc, v: acc + v
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), add)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (norm > 0) & (norm < F.lit(float("inf")))
    return F.when(usable, dot(a, b) / norm)


def distinct_faces(feature_a: Column, feature_b: Column, face_a: Column, face_b: Column,
                   threshold: float = 0.363, max_iou: float = 0.3) -> Column:
    """True when features are usable, unlike, and the boxes barely overlap."""
    likeness = cosine(feature_a, feature_b)
    return (iou(face_a, face_b) <= max_iou) & F.coalesce(likeness < threshold, F.lit(False))


def mean_abs_difference(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
