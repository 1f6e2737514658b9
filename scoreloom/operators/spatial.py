"""Joins in the plane: containment, nearest neighbour within a distance, relational division. Grid cells turn each into
an equi-join whose rows grow with what is close, not with all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import materialize

#: So many items of a division have a bit each in one long.
BITS = 62


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def contain_join(points: DataFrame, boxes: DataFrame, by: Sequence[str], x: str, y: str, cell: float) -> DataFrame:
    """Points joined to the boxes (min_x, min_y, max_x, max_y) that hold them, edges included. Boxes are dealt to the
    grid cells they cover, points to their own, so no pair comes twice. Null coordinates match nothing."""
    dealt = boxes.withColumn("_cx", F.explode(_cells(F.col("min_x"), F.col("max_x"), cell))).withColumn("_cy", F.explode(_cells(F.col("min_y"), F.col("max_y"), cell)))
    located = points.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
    inside = (F.col(x) >= F.col("min_x")) & (F.col(x) <= F.col("max_x")) & (F.col(y) >= F.col("min_y")) & (F.col(y) <= F.col("max_y"))
    return located.join(dealt, [*by, "_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def nearest_within(points: DataFrame, anchors: DataFrame, by: Sequence[str], point_id: str, anchor_id: str, max_dist: float, distance: Column | None = None) -> DataFrame:
    """by, point_id, anchor_id, distance: each point's nearest anchor at most max_dist away, then the smaller id.

    points: by, point_id, x, y; anchors: by, anchor_id, ax, ay. Cells are max_dist wide; anchors go to their own and
    the eight around, so a point finds all it can reach in its own cell. A cheap box test comes before the distance.
    """
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    dealt = anchors.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    dealt = dealt.withColumns({"_cx": F.floor(F.col("ax") / max_dist) + F.col("_dx"), "_cy": F.floor(F.col("ay") / max_dist) + F.col("_dy")}).drop("_dx", "_dy")
    located = points.withColumns({"_cx": F.floor(F.col("x") / max_dist), "_cy": F.floor(F.col("y") / max_dist)})
    near = located.join(dealt, [*by, "_cx", "_cy"]).where((F.abs(F.col("x") - F.col("ax")) <= max_dist) & (F.abs(F.col("y") - F.col("ay")) <= max_dist))
    dist = distance if distance is not None else F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2))
    best = near.withColumn("distance", dist).where(F.col("distance") <= max_dist).groupBy(*by, point_id).agg(F.min(F.struct("distance", anchor_id)).alias("b"))
    return best.select(*by, point_id, F.col("b")[anchor_id].alias(anchor_id), F.col("b.distance").alias("distance"))


def divide(rows: DataFrame, keys: Sequence[str], item: str, required: DataFrame) -> DataFrame:
    """Keys that have every item of `required` (item): relational division. Up to BITS items are one long a key, in which each
    sets its bit, so that a task holds a number for each of its keys; more are counted as distinct ones."""
    wanted = materialize(required.select(item).where(F.col(item).isNotNull()).distinct(), "required")
    n = wanted.count()
    if n <= BITS:
        bits = wanted.select(item, F.call_function("shiftleft", F.lit(1).cast("long"), F.row_number().over(Window.orderBy(item)) - 1).alias("_bit"))
        held = rows.join(F.broadcast(bits), item).groupBy(*keys).agg(F.bit_or("_bit").alias("_held"))
        return held.where(F.col("_held") == (1 << n) - 1).select(*keys)
    return rows.join(wanted, item, "left_semi").groupBy(*keys).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") == n).select(*keys)
