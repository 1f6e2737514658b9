"""Functions of points and boxes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 if two intervals touch or overlap, else the space between."""
    return F.greatest(a0 - b1, b0 - a1, F.lit(0.0))


def box_gap(a: Column, b: Column) -> Column:
    """Distance of two boxes struct<min_x, min_y, max_x, max_y>."""
    dx = interval_gap(a["min_x"], a["max_x"], b["min_x"], b["max_x"])
    dy = interval_gap(a["min_y"], a["max_y"], b["min_y"], b["max_y"])
    return F.sqrt(dx * dx + dy * dy)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return dist(px, py, ax + t * dx, ay + t * dy)


def poly_length(points: Column) -> Column:
    """Length of array<struct<x, y>>; 0 for fewer than two points."""
    steps = F.zip_with(points, F.slice(points, 2, F.size(points)), lambda p, q: F.when(q.isNotNull(), dist(p["x"], p["y"], q["x"], q["y"])).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda a, d: a + d)


def signed_area(points: Column) -> Column:
    """Of the closed polygon through the points; positive if x turns towards y."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    crosses = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(crosses, F.lit(0.0), lambda a, c: a + c) / 2


def orientation(dx: Column, dy: Column) -> Column:
    """'horizontal' if |dx| is 8 |dy| or more, 'vertical' the other way round, else 'oblique'."""
    return F.when(F.abs(dx) >= 8 * F.abs(dy), "horizontal").when(F.abs(dy) >= 8 * F.abs(dx), "vertical").otherwise("oblique")
