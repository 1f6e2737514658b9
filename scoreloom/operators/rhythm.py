"""Rhythm repairs and projections onto musical time, as joins and aggregates over measures.

Events: score_id, measure_no, staff, voice, id, x, at and duration (doubles, in whole notes), direction ('up', 'down')
where stems count. Bars: score_id, measure_no, bar (double, the bar's length).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences

_STAFF = ["score_id", "measure_no", "staff"]
TOLERANCE = 1e-6


def split_overfull(events: DataFrame, bars: DataFrame) -> DataFrame:
    """events whose single, overfull voice splits by stem direction: up is voice 1, down 2.

    A staff's measure splits if it has three events or more in one voice, all with a stem, in both directions; if
    together they exceed the bar, neither direction does alone, one of them fills it, and the two overlap in x.
    """
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    length = lambda c: F.sum(F.when(c, F.col("duration")).otherwise(0.0))
    edge = lambda f, c: f(F.when(c, F.col("x")))
    sums = events.groupBy(*_STAFF).agg(
        F.count("*").alias("n"), F.count_distinct("voice").alias("voices"), F.count_if(~(up | down) | F.col("direction").isNull()).alias("loose"),
        length(up).alias("up"), length(down).alias("down"), edge(F.min, up).alias("u0"), edge(F.max, up).alias("u1"), edge(F.min, down).alias("d0"), edge(F.max, down).alias("d1"),
    )
    bar = F.col("bar") + TOLERANCE
    fills = (F.abs(F.col("up") - F.col("bar")) <= TOLERANCE) | (F.abs(F.col("down") - F.col("bar")) <= TOLERANCE)
    split = (F.col("n") >= 3) & (F.col("voices") == 1) & (F.col("loose") == 0) & (F.col("up") + F.col("down") > bar) & (F.col("up") <= bar) & (F.col("down") <= bar) & fills & (F.col("u0") <= F.col("d1")) & (F.col("d0") <= F.col("u1"))
    chosen = sums.join(bars, ["score_id", "measure_no"]).where(split).select(*_STAFF, F.lit(True).alias("_split"))
    rows = events.join(chosen, _STAFF, "left")
    return rows.withColumn("voice", F.when(F.col("_split"), F.when(up, 1).otherwise(2)).otherwise(F.col("voice"))).drop("_split")


def shift_by_anchor(events: DataFrame, bars: DataFrame, tolerance: float) -> DataFrame:
    """events of voices that begin at 0 moved to the onset of the closest event of the other staff, at most tolerance
    away in x and later than 0, if the voice still ends inside the bar."""
    voice = [*_STAFF, "voice"]
    heads = events.groupBy(*voice).agg(F.min(F.struct("x", "id", "at")).alias("h"), F.max(F.col("at") + F.col("duration")).alias("end")).where(F.abs(F.col("h.at")) <= TOLERANCE)
    other = events.where(F.col("at") > TOLERANCE).select("score_id", "measure_no", F.col("staff").alias("_staff"), F.col("x").alias("_x"), F.col("at").alias("_at"))
    near = heads.join(other, ["score_id", "measure_no"]).where((F.col("_staff") != F.col("staff")) & (F.abs(F.col("_x") - F.col("h.x")) <= tolerance))
    best = near.groupBy(*voice, "end").agg(F.min(F.struct(F.abs(F.col("_x") - F.col("h.x")).alias("d"), "_at")).alias("b")).join(bars, ["score_id", "measure_no"])
    fits = best.where(F.col("end") + F.col("b._at") <= F.col("bar") + TOLERANCE).select(*voice, F.col("b._at").alias("_shift"))
    rows = events.join(fits, voice, "left")
    return rows.withColumn("at", F.col("at") + F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def continue_voice(events: DataFrame, rests: DataFrame) -> DataFrame:
    """events whose voice returns after a rest: a note in voice 2 that follows a rest of voice 1 without overlap, with
    the pitch of voice 1's last note before it, goes on in voice 1. events carry pitch; rests: the same without."""
    rest = rests.where("voice = 1").select(*_STAFF, F.col("x").alias("_rx"))
    closest = events.where("voice = 2").join(rest, _STAFF).where(F.col("_rx") < F.col("x")).groupBy(*_STAFF, "id", "pitch").agg(F.max("_rx").alias("_rx"))
    lead = events.where("voice = 1").select(*_STAFF, F.col("x").alias("_lx"), F.col("pitch").alias("_lp"))
    before = closest.join(lead, _STAFF).where(F.col("_lx") < F.col("_rx")).groupBy(*_STAFF, "id", "pitch").agg(F.max_by("_lp", "_lx").alias("_lp"))
    back = before.where("pitch = _lp").select(*_STAFF, "id", F.lit(1).alias("_voice"))
    return events.join(back, [*_STAFF, "id"], "left").withColumn("voice", F.coalesce("_voice", "voice")).drop("_voice")


def fit_to_end(events: DataFrame, bars: DataFrame, gain: float = 0.04) -> DataFrame:
    """events of voices above the first with one event only, moved so that it ends with the bar if that brings onset
    and x closer, by at least gain of the bar. events carry x_share: x as a share of the measure's width."""
    lone = F.count("*").over(Window.partitionBy(*_STAFF, "voice")) == 1
    rows = events.withColumn("_lone", lone).join(bars, ["score_id", "measure_no"], "left")
    late = F.col("bar") - F.col("duration")
    error = lambda at: F.abs(at / F.col("bar") - F.col("x_share"))
    better = F.col("_lone") & (F.col("voice") > 1) & (late >= 0) & (error(F.col("at")) - error(late) >= gain)
    return rows.withColumn("at", F.when(better, late).otherwise(F.col("at"))).drop("_lone", "bar")


def project_x(marks: DataFrame, measures: DataFrame, prefer_later: bool) -> DataFrame:
    """marks (score_id, system_id, x) with the measure_no their x lies in; on a boundary the later measure, or the
    earlier one. measures: score_id, system_id, measure_no, x_start, x_end."""
    by = ["score_id", "system_id"]
    found = sequences.asof_state(marks.withColumn("_x", F.col("x")), measures.withColumn("_x", F.col("x_start")), by, ["_x"], ["measure_no", "x_start", "x_end"]).drop("_x")
    inside = F.col("x") <= F.col("x_end")
    number = F.col("measure_no") if prefer_later else F.when((F.col("x") == F.col("x_start")) & (F.col("measure_no") > F.col("_first")), F.col("measure_no") - 1).otherwise(F.col("measure_no"))
    first = measures.groupBy(*by).agg(F.min("measure_no").alias("_first"))
    return found.join(first, by, "left").withColumn("measure_no", F.when(inside, number)).drop("_first", "x_start", "x_end")


def nearest_onset(marks: DataFrame, onsets: DataFrame, tolerance: float) -> DataFrame:
    """marks (mark_id, score_id, measure_no, x) with `at` of the closest onset of the measure at most tolerance away."""
    near = marks.join(onsets.select("score_id", "measure_no", F.col("x").alias("_x"), "at"), ["score_id", "measure_no"]).withColumn("_d", F.abs(F.col("x") - F.col("_x"))).where(F.col("_d") <= tolerance)
    best = near.groupBy("score_id", "mark_id").agg(F.min(F.struct("_d", "at")).alias("b")).select("score_id", "mark_id", F.col("b.at").alias("at"))
    return marks.join(best, ["score_id", "mark_id"], "left")


def classify_curves(starts: DataFrame, ends: DataFrame, lead: float = 0.80, alone: float = 5.0) -> DataFrame:
    """curve_id, kind ('tie-like', 'slur', 'rejected'), start_id, end_id, cost.

    starts and ends: score_id, curve_id, note_id, pitch, ordinal (place among the notes of its voice), cost. The best
    pair of equal pitch in neighbouring places is a tie if it costs at most `lead` more than the best pair of any
    notes, or at most `alone` without one; else the best pair is a slur.
    """
    side = lambda df, p: df.select("score_id", "curve_id", *(F.col(c).alias(f"{p}_{c}") for c in ("note_id", "pitch", "ordinal", "cost")))
    pairs = side(starts, "s").join(side(ends, "e"), ["score_id", "curve_id"]).where(F.col("s_ordinal") < F.col("e_ordinal")).withColumn("cost", F.col("s_cost") + F.col("e_cost"))
    best = F.struct("cost", "s_note_id", "e_note_id")
    tie = (F.col("s_pitch") == F.col("e_pitch")) & (F.col("e_ordinal") == F.col("s_ordinal") + 1)
    found = pairs.groupBy("score_id", "curve_id").agg(F.min(F.when(tie, best)).alias("t"), F.min(F.when(~tie, best)).alias("a"))
    curves = starts.select("score_id", "curve_id").union(ends.select("score_id", "curve_id")).distinct().join(found, ["score_id", "curve_id"], "left")
    is_tie = F.when(F.col("a").isNull(), F.col("t.cost") <= alone).otherwise(F.col("t.cost") <= F.col("a.cost") + lead)
    kind = F.when(is_tie, "tie-like").when(F.col("a").isNotNull(), "slur").otherwise("rejected")
    pick = F.when(is_tie, F.col("t")).otherwise(F.col("a"))
    return curves.select("score_id", "curve_id", kind.alias("kind"), pick["s_note_id"].alias("start_id"), pick["e_note_id"].alias("end_id"), pick["cost"].alias("cost"))


def octave_offset(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """notes (score_id, staff, place, octave) with the octaves of the shift that holds them: spans: score_id, staff,
    start, end (end exclusive), direction ('up', 'down'), size (8, 15). Spans of a staff don't overlap."""
    octaves = ((F.col("size") - 1) / 7).cast("int") * F.when(F.col("direction") == "down", -1).otherwise(1)
    inside = sequences.interval_join(notes, spans, ["score_id", "staff"], "place", "start", "end").select("score_id", "note_id", octaves.alias("_o"))
    return notes.join(inside, ["score_id", "note_id"], "left").withColumn("octave", F.col("octave") + F.coalesce("_o", F.lit(0))).drop("_o")


def principal_axis(points: DataFrame, by: list[str]) -> DataFrame:
    """by, cx, cy, angle, major, minor: centroid, direction and half extents of each shape's points (x, y) along its
    main axis and across. Two aggregations of the exploded points; no shape is gathered."""
    m = points.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    m = m.select(*by, "cx", "cy", (F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2).alias("angle"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = points.join(m, by).withColumns({"_u": dx * F.cos("angle") + dy * F.sin("angle"), "_v": dy * F.cos("angle") - dx * F.sin("angle")})
    half = lambda c: (F.max(c) - F.min(c)) / 2
    return rows.groupBy(*by, "cx", "cy", "angle").agg(half("_u").alias("major"), half("_v").alias("minor"))


def sample_variants(scores: DataFrame, dimensions: list[DataFrame], n: int, seed: int) -> DataFrame:
    """n combinations of the dimensions' rows for each score, without repeats, in an order that the seed fixes.
    Dimensions are small lists (factors, fonts, renderers); their product is made once and dealt by hash."""
    product = dimensions[0]
    for more in dimensions[1:]:
        product = product.join(more, F.lit(True))
    names = product.columns
    combos = product.agg(F.collect_list(F.struct(*names)).alias("all")).first()["all"]
    kind = product.select(F.struct(*names).alias("v")).schema["v"].dataType.simpleString()
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in combos])), f"array<{kind}>")
    rows = scores.select("score_id", F.explode(listed).alias("v"))
    order = F.xxhash64(F.lit(seed), "score_id", F.to_json("v"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("score_id").orderBy(order))).where(F.col("nth") <= n).select("score_id", "nth", "v.*")


def placement(y: Column, top: Column, bottom: Column) -> Column:
    """'above', 'below' or null inside, for y that grows downward."""
    return F.when(y < top, "above").when(y > bottom, "below")
