"""Polygons as arrays of struct(x, y): area, containment, boxes, transforms, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(polygon: Column) -> Column:
    return F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))


def area(polygon: Column) -> Column:
    cross = F.zip_with(polygon, _next(polygon), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda total, c: total + c)) / 2


def contains_point(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the border an odd number of times."""
    cross = F.zip_with(polygon, _next(polygon), lambda p, q: F.when((p["y"] > y) != (q["y"] > y), (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]).cast("int")).otherwise(0))
    return F.aggregate(cross, F.lit(0), lambda total, c: total + c) % 2 == 1


def box(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1) around a polygon."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def union_box(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; null if both are empty."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.try_divide(wide * high, size(a) + size(b) - wide * high)


def projected(polygon: Column, m: list[float]) -> Column:
    """A polygon under a 3 x 3 projective matrix, given row by row."""
    return F.transform(
        polygon,
        lambda p: F.struct(
            ((m[0] * p["x"] + m[1] * p["y"] + m[2]) / (m[6] * p["x"] + m[7] * p["y"] + m[8])).alias("x"),
            ((m[3] * p["x"] + m[4] * p["y"] + m[5]) / (m[6] * p["x"] + m[7] * p["y"] + m[8])).alias("y"),
        ),
    )
