"""Ledger lines of staffs, and the noteheads that hang on ladders of them.

A ledger counts only as part of a chain: those of the first step beside the staff, then those of each further step that
overlap one of the step before. Steps are at most twelve, so the chain is as many semi joins of one small table with
itself, each step written once and none after the first without a ledger. Which staff a head belongs to is a relational division: all steps up to its own must cross it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import materialize

#: Steps of a chain; the rest in staff spacings, shares of a length or half steps.
STEPS, LENGTHS, OFF_STEP, ON_LINE, SLACK = 12, (0.55, 4.5), 0.28, 0.18, 0.2
GRID_ERROR, LEAST_LEVELS, CROSSING = 0.30, 2, 0.15
_SIDE = ["score_id", "staff_id", "direction"]


def ledger_segments(staffs: DataFrame, lines: DataFrame, strokes: DataFrame) -> DataFrame:
    """score_id, staff_id, direction ('above', 'below'), step, stroke_id, y, x_start, x_end of the strokes that are
    ledgers.

    staffs: score_id, staff_id, spacing, min_x, min_y, max_x, max_y; lines: score_id, staff_id, stroke_id, y, x_start,
    x_end; strokes: score_id, stroke_id, y, x_start, x_end, horizontal ones. A ledger is of ledger length, overlaps its
    staff in x, lies near a step's height and not on the staff's own lines.
    """
    reach = (STEPS + OFF_STEP) * F.col("spacing")
    near = strokes.join(staffs, "score_id").where((F.col("y") >= F.col("min_y") - reach) & (F.col("y") <= F.col("max_y") + reach))
    length = F.col("x_end") - F.col("x_start")
    near = near.where((length >= LENGTHS[0] * F.col("spacing")) & (length <= LENGTHS[1] * F.col("spacing")) & (F.least("x_end", "max_x") > F.greatest("x_start", "min_x")))
    own = lines.select("score_id", "staff_id", F.col("stroke_id").alias("_id"), F.col("y").alias("_y"), F.col("x_start").alias("_a"), F.col("x_end").alias("_b"))
    on_line = (F.col("_id") == F.col("stroke_id")) | ((F.abs(F.col("y") - F.col("_y")) <= ON_LINE * F.col("spacing")) & (F.least("x_end", "_b") > F.greatest("x_start", "_a")))
    near = near.alias("n").join(own.alias("o"), (F.col("n.score_id") == F.col("o.score_id")) & (F.col("n.staff_id") == F.col("o.staff_id")) & on_line, "left_anti")
    sides = F.array(
        F.struct(F.lit("above").alias("direction"), ((F.col("min_y") - F.col("y")) / F.col("spacing")).alias("steps")), F.struct(F.lit("below").alias("direction"), ((F.col("y") - F.col("max_y")) / F.col("spacing")).alias("steps"))
    )
    rows = near.select("score_id", "staff_id", "stroke_id", "y", "x_start", "x_end", F.explode(sides).alias("s")).select("*", "s.direction", F.rint("s.steps").cast("int").alias("step"))
    rows = rows.where((F.abs(F.col("s.steps") - F.col("step")) <= OFF_STEP) & F.col("step").between(1, STEPS)).drop("s")
    rows = materialize(rows, "ledgers")
    share = SLACK * F.least(F.col("x_end") - F.col("x_start"), F.col("_b") - F.col("_a"))
    touches = (F.col("x_end") + share >= F.col("_a")) & (F.col("_b") + share >= F.col("x_start"))
    chain = [rows.where("step = 1")]
    for step in range(2, STEPS + 1):
        below = chain[-1].select(*(F.col(c).alias(f"_{c}") for c in _SIDE), F.col("x_start").alias("_a"), F.col("x_end").alias("_b"))
        same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in _SIDE))
        found = materialize(rows.where(F.col("step") == step).join(below, same & touches, "left_semi"), "chain")
        if found.isEmpty():  # nothing further can hang on it
            break
        chain.append(found)
    return reduce(DataFrame.unionByName, chain).select(*_SIDE, "step", "stroke_id", "y", "x_start", "x_end")


def ledger_levels(segments: DataFrame) -> DataFrame:
    """score_id, staff_id, direction, step, y (their mean), n: a row for each step that has ledgers."""
    return segments.groupBy(*_SIDE, "step").agg(F.avg("y").alias("y"), F.count("*").alias("n"))


def ledger_ladder(ellipses: DataFrame, staffs: DataFrame, measures: DataFrame, segments: DataFrame) -> DataFrame:
    """score_id, shape_id, staff_id, measure_id, direction, staff_step, levels of the ellipses that exactly one staff claims
    by its ledgers.

    ellipses: score_id, shape_id, x, y, major; measures: score_id, staff_id, measure_id, x_start, x_end, the first that
    holds x counts. An ellipse lies on the staff's grid (half steps, ties to even) beyond LEAST_LEVELS ledgers, and every
    step up to it has a ledger that crosses it.
    """
    half = F.col("spacing") / 2
    at = ellipses.join(staffs.where("spacing > 0"), "score_id").withColumn("_raw", (F.col("y") - F.col("min_y")) / half).withColumn("staff_step", F.rint("_raw").cast("int"))
    beyond = F.when(F.col("staff_step") < -1, F.floor(-F.col("staff_step") / 2)).when(F.col("staff_step") > 9, F.floor((F.col("staff_step") - 8) / 2)).otherwise(0).cast("int")
    at = at.withColumns({"levels": beyond, "direction": F.when(F.col("staff_step") < 0, "above").otherwise("below")})
    at = at.where((F.abs(F.col("_raw") - F.col("staff_step")) <= GRID_ERROR) & (F.col("levels") >= LEAST_LEVELS))
    held = measures.select("score_id", "staff_id", "measure_id", F.col("x_start").alias("_m0"), F.col("x_end").alias("_m1"))
    at = at.join(held, ["score_id", "staff_id"]).where(F.col("x").between(F.col("_m0"), F.col("_m1")))
    at = at.groupBy("score_id", "shape_id", "staff_id", "x", "major", "spacing", "staff_step", "levels", "direction").agg(F.min_by("measure_id", F.struct("_m0", "measure_id")).alias("measure_id"))
    room = CROSSING * F.col("spacing") + F.col("major")
    crossed = at.join(segments.select(*_SIDE, "step", "x_start", "x_end"), _SIDE).where((F.col("step") <= F.col("levels")) & (F.col("x_end") + room >= F.col("x")) & (F.col("x_start") - room <= F.col("x")))
    whole = crossed.groupBy("score_id", "shape_id", "staff_id", "measure_id", "direction", "staff_step", "levels").agg(F.count_distinct("step").alias("_n")).where("_n = levels").drop("_n")
    names = [c for c in whole.columns if c not in ("score_id", "shape_id")]
    one = whole.groupBy("score_id", "shape_id").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in names))
    return one.where("_n = 1").drop("_n")
