"""Curves that a system break cuts in two, and ties that no pass has claimed.

A curve is seen by its left and right end in staff spacings from notes. Fragments on both sides of a real break meet in a
join on the break; what each curve and note pair may be used for once is decided in order of cost, a score at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dist, point_segment
from .groupwise import Columns, each_group

#: Fixed values, in staff spacings.
LEAST_SPAN, NOTE_REACH, SYSTEM_END, SYSTEM_START, OPEN_END, OPEN_GAP = 0.75, 3.25, 2.50, 7.00, 0.65, 0.75
TIE_SPAN, TIE_CANDIDATES, TIE_PAIRS = 1.20, 18, 32
BREAK_REACH, BREAK_EDGE = 2.25, 2.50


def curve_ends(curves: DataFrame) -> DataFrame:
    """curves with left and right (struct<x, y>) and placement ('above', 'below' by the middle point against the chord,
    null where neither) instead of centerline (array<struct<x, y>>); curves of fewer than two points go."""
    first, last = F.element_at("centerline", 1), F.element_at("centerline", -1)
    forward = first["x"] <= last["x"]
    rows = curves.where(F.size("centerline") >= 2).withColumns({"left": F.when(forward, first).otherwise(last), "right": F.when(forward, last).otherwise(first)})
    middle = F.element_at("centerline", (F.floor(F.size("centerline") / 2) + 1).cast("int"))
    left, right = F.col("left"), F.col("right")
    dx = right["x"] - left["x"]
    t = F.when(F.abs(dx) < 1e-9, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle["x"] - left["x"]) / dx)))
    off = middle["y"] - (left["y"] + t * (right["y"] - left["y"]))
    placement = F.when((F.size("centerline") < 3) | (F.abs(off) < 1e-6), F.lit(None)).otherwise(F.when(off < 0, "above").otherwise("below"))
    return rows.withColumn("placement", placement.cast("string")).drop("centerline")


def note_distance(point: Column, anchor: Column) -> Column:
    """From a point to a notehead's edge, 0 inside."""
    return F.greatest(F.lit(0.0), dist(point["x"], point["y"], anchor["x"], anchor["y"]) - anchor["radius"])


def end_distance(point: Column, anchor: Column) -> Column:
    """To the head's edge or to its stem, whichever is closer. anchor: x, y, radius, stem (struct<x1, y1, x2, y2>, or
    null)."""
    s = anchor["stem"]
    head = note_distance(point, anchor)
    return F.when(s.isNull(), head).otherwise(F.least(head, point_segment(point["x"], point["y"], s["x1"], s["y1"], s["x2"], s["y2"])))


_ANCHOR = ["note_id", "x", "y", "radius", "stem", "pitch", "voice", "target_id"]


def _breaks(measures: DataFrame) -> DataFrame:
    """score_id, measure_no of the last measure before each break, next_no and the edges at the break; only breaks between
    measures whose numbers follow each other."""
    order = Window.partitionBy("score_id").orderBy("measure_no")
    rows = measures.select("score_id", "measure_no", F.lead("measure_no").over(order).alias("next_no"), F.lead("break_before").over(order).alias("_break"), "x_end", F.lead("x_start").over(order).alias("next_start"))
    return rows.where(F.col("_break") & (F.col("next_no") == F.col("measure_no") + 1)).drop("_break")


def _fragments(curves: DataFrame, anchors: DataFrame, breaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outgoing, incoming): one row a curve whose note end is closest to an anchor and whose open end is near no note."""
    rows = curve_ends(curves).where((F.col("right.x") - F.col("left.x")) / F.col("spacing") >= LEAST_SPAN)
    own = anchors.select("score_id", "measure_no", "staff", F.struct(*_ANCHOR).alias("a"))
    sides = []
    for kind, note, open_end, at, edge, reach in (
        ("to system end", "left", "right", breaks.select("score_id", "measure_no", F.col("measure_no").alias("break_no"), F.col("x_end").alias("edge")), "right", SYSTEM_END),
        ("from system start", "right", "left", breaks.select("score_id", F.col("next_no").alias("measure_no"), F.col("measure_no").alias("break_no"), F.col("next_start").alias("edge")), "left", SYSTEM_START),
    ):
        near = rows.join(at, ["score_id", "measure_no"]).withColumn("edge_distance", F.abs(F.col(edge)["x"] - F.col("edge")) / F.col("spacing")).where(F.col("edge_distance") <= reach)
        if edge == "left":
            near = near.where(F.col("left.x") >= F.col("edge") - F.col("spacing"))
        pairs = near.join(own, ["score_id", "measure_no", "staff"])
        d = end_distance(F.col(note), F.col("a")) / F.col("spacing")
        found = pairs.groupBy("score_id", "measure_no", "staff", "curve_id", "break_no", "edge_distance", "placement").agg(
            F.min(F.struct(d.alias("d"), F.col("a.note_id").alias("note_id"), F.col("a.pitch").alias("pitch"), F.col("a.voice").alias("voice"))).alias("n"), F.min(end_distance(F.col(open_end), F.col("a")) / F.col("spacing")).alias("open_distance")
        )
        found = found.where((F.col("n.d") <= NOTE_REACH) & (F.col("open_distance") > OPEN_END) & (F.col("open_distance") > F.col("n.d") + OPEN_GAP))
        score = F.col("n.d") + (F.least("edge_distance", F.lit(2.5)) if edge == "right" else 0.2 * F.least("edge_distance", F.lit(7.0)))
        sides.append(found.select("score_id", "measure_no", "staff", "curve_id", "break_no", F.lit(kind).alias("kind"), F.col("n.note_id").alias("note_id"), F.col("n.pitch").alias("pitch"), F.col("n.voice").alias("voice"), F.col("n.d").alias("note_distance"), "edge_distance", "placement", score.alias("score")))
    return sides[0], sides[1]


def _once(names: list[str], used: list[str]):
    """Of a group's rows in order those whose values in the columns of `used` no earlier chosen row has in any of them."""

    def solve(rows: Columns) -> list[tuple]:
        seen: set = set()
        out = []
        for i in range(len(rows[used[0]])):
            own = {rows[c][i] for c in used}
            if not own & seen:
                seen |= own
                out.append(tuple(rows[c][i] for c in names))
        return out

    return solve


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in df.dtypes)


def _agree(a: str, b: str) -> Column:
    """Equal, or one of them not known."""
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))


def stitch_fragments(curves: DataFrame, anchors: DataFrame, measures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments, stitched) of curves across system breaks.

    curves: score_id, measure_no, staff, curve_id, spacing, centerline; a curve owned by several measures has a row for
    each. anchors: score_id, measure_no, staff, note_id, x, y, radius, stem, pitch, voice, target_id. measures: score_id,
    measure_no, x_start, x_end, break_before. An outgoing fragment ends at a system's end, an incoming one begins in the
    band after the next system's start; their other ends are at notes, and the open ends clearly are not. Across one
    break the cheapest pairs of equal placement are stitched, each curve once in a score, earlier breaks first. fragments:
    each curve by its better kind; stitched: score_id, curve_id (out+in), both measures, staves and notes, placement,
    start and end distance, score, confidence.
    """
    outgoing, incoming = _fragments(curves, anchors, _breaks(measures))
    every = outgoing.unionByName(incoming)
    best = Window.partitionBy("score_id", "curve_id").orderBy("score", "break_no", F.desc("kind"))
    sure = F.greatest(F.lit(0.65), F.least(F.lit(0.98), 0.98 - 0.08 * F.col("note_distance") - 0.02 * F.least("edge_distance", F.lit(6.0))))
    fragments = every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("confidence", sure)
    side = lambda df, p: df.select("score_id", "break_no", *(F.col(c).alias(f"{p}_{c}") for c in ("curve_id", "measure_no", "staff", "note_id", "pitch", "voice", "note_distance", "edge_distance", "placement")))
    pairs = side(outgoing, "from").join(side(incoming, "to"), ["score_id", "break_no"]).where(_agree("from_placement", "to_placement"))
    bonus = lambda c, amount: F.when(c, amount).otherwise(0.0)
    score = F.col("from_note_distance") + F.col("to_note_distance") + 0.10 * F.col("from_edge_distance") + 0.05 * F.col("to_edge_distance")
    score = score + bonus(F.col("from_staff") != F.col("to_staff"), 0.50) - bonus(F.col("from_pitch") == F.col("to_pitch"), 0.50) - bonus(F.col("from_voice") == F.col("to_voice"), 0.25)
    pairs = pairs.withColumn("score", score)
    chosen = each_group(pairs, ["score_id"], ["break_no", "score", "from_curve_id", "to_curve_id"], _once(pairs.columns, ["from_curve_id", "to_curve_id"]), _schema(pairs))
    return fragments, chosen.select(
        "score_id", F.concat("from_curve_id", F.lit("+"), "to_curve_id").alias("curve_id"), F.col("from_curve_id").alias("outgoing_id"), F.col("to_curve_id").alias("incoming_id"),
        *(F.col(c) for c in ("from_measure_no", "to_measure_no", "from_staff", "to_staff", "from_note_id", "to_note_id", "from_pitch", "to_pitch", "from_voice", "to_voice")),
        F.coalesce("from_placement", "to_placement").alias("placement"), F.col("from_note_distance").alias("start_distance"), F.col("to_note_distance").alias("end_distance"), "score",
        F.greatest(F.lit(0.68), F.least(F.lit(0.98), 0.98 - 0.06 * F.col("score"))).alias("confidence"),
    )


def recover_ties(curves: DataFrame, anchors: DataFrame, claimed: DataFrame, ties: DataFrame) -> DataFrame:
    """score_id, curve_id, measures, staff, notes, pitch, placement, distances, confidence, other_staff of ties on curves
    that nothing has claimed, whichever staff owns the curve.

    curves and anchors as in stitch_fragments; claimed: score_id, curve_id; ties: score_id, start_measure, from_id,
    end_measure, to_id of known ties. A tie joins two notes of one staff, voice and pitch, the first not after the second
    and of another event, both within reach of the curve's ends in measures that own it; each end knows its closest
    TIE_CANDIDATES notes, each curve its cheapest TIE_PAIRS pairs. In order of the summed distances a curve and a pair of
    notes are used once. other_staff: the curve is owned by other staves only.
    """
    seen = curve_ends(curves).join(claimed.select("score_id", "curve_id").distinct(), ["score_id", "curve_id"], "left_anti")
    curve = seen.groupBy("score_id", "curve_id").agg(
        F.min_by(F.struct("left", "right", "placement", "spacing"), F.struct("measure_no", "staff")).alias("c"), F.array_distinct(F.collect_list("staff")).alias("staves"), F.collect_set("measure_no").alias("held")
    )
    curve = curve.where((F.col("c.right.x") - F.col("c.left.x")) / F.col("c.spacing") >= TIE_SPAN)
    own = anchors.select("score_id", "measure_no", F.struct("measure_no", "staff", *_ANCHOR).alias("a"))
    pairs = curve.withColumn("measure_no", F.explode("held")).join(own, ["score_id", "measure_no"])
    ends = []
    for name in ("left", "right"):
        d = end_distance(F.col(f"c.{name}"), F.col("a")) / F.col("c.spacing")
        near = Window.partitionBy("score_id", "curve_id").orderBy("d", "a.measure_no", "a.x", "a.y", "a.note_id")
        ends.append(pairs.withColumn("d", d).where(F.col("d") <= NOTE_REACH).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= TIE_CANDIDATES).select("score_id", "curve_id", F.col("a").alias(name), F.col("d").alias(f"{name}_d")))
    p, q = F.col("left"), F.col("right")
    later = (p["measure_no"] < q["measure_no"]) | ((p["measure_no"] == q["measure_no"]) & (p["x"] <= q["x"] + 1e-6) & (p["note_id"] != q["note_id"]))
    fits = later & (p["staff"] == q["staff"]) & (p["voice"] == q["voice"]) & (p["pitch"] == q["pitch"]) & ~p["target_id"].eqNullSafe(q["target_id"])
    names = {"start_measure": p["measure_no"], "from_id": p["note_id"], "end_measure": q["measure_no"], "to_id": q["note_id"], "staff": p["staff"], "pitch": p["pitch"]}
    both = ends[0].join(ends[1], ["score_id", "curve_id"]).where(fits).select("score_id", "curve_id", *(v.alias(k) for k, v in names.items()), "left_d", "right_d", (F.col("left_d") + F.col("right_d")).alias("score"))
    both = both.join(ties.select("score_id", "start_measure", "from_id", "end_measure", "to_id").distinct(), ["score_id", "start_measure", "from_id", "end_measure", "to_id"], "left_anti")
    pair = ["start_measure", "from_id", "end_measure", "to_id"]
    cheapest = Window.partitionBy("score_id", "curve_id").orderBy("score", *pair)
    both = both.withColumn("_n", F.row_number().over(cheapest)).where(F.col("_n") <= TIE_PAIRS).drop("_n")
    both = both.withColumns({"_curve": F.struct(F.lit("curve"), "curve_id").cast("string"), "_pair": F.struct(*pair).cast("string")})
    chosen = each_group(both, ["score_id"], ["score", "curve_id", *pair], _once(both.columns, ["_curve", "_pair"]), _schema(both)).drop("_curve", "_pair")
    sure = F.greatest(F.lit(0.58), F.least(F.lit(0.95), 0.96 - 0.10 * F.col("score")))
    return chosen.join(curve.select("score_id", "curve_id", "staves", F.col("c.placement").alias("placement")), ["score_id", "curve_id"]).select(
        "score_id", "curve_id", *pair, "staff", "pitch", "placement", F.col("left_d").alias("start_distance"), F.col("right_d").alias("end_distance"), sure.alias("confidence"), (~F.array_contains("staves", F.col("staff"))).alias("other_staff")
    )


def recover_break_ties(curves: DataFrame, anchors: DataFrame, measures: DataFrame, claimed: DataFrame, ties: DataFrame) -> DataFrame:
    """score_id, curve_id (out+in), start_measure, from_id, end_measure, to_id, staff, pitch, placement, distances,
    confidence: at most one tie a break and staff, from a note that ends with its bar to one that begins the next.

    As stitch_fragments with stricter reach; anchors also carry at and ends (doubles), measures bar (double). Voices and
    placements that are known must be equal. Curves of one tie serve no other; breaks go in order, staff 1 first.
    """
    breaks = _breaks(measures).join(measures.select("score_id", "measure_no", "bar"), ["score_id", "measure_no"])
    rows = curve_ends(curves).join(claimed.select("score_id", "curve_id").distinct(), ["score_id", "curve_id"], "left_anti").where((F.col("right.x") - F.col("left.x")) / F.col("spacing") >= LEAST_SPAN)
    own = anchors.select("score_id", "measure_no", "staff", F.struct(*_ANCHOR, "at", "ends").alias("a"))
    sides = []
    for note, edge, at, holds in (
        ("left", "right", breaks.select("score_id", "measure_no", F.col("measure_no").alias("break_no"), F.col("x_end").alias("edge"), "bar"), F.abs(F.col("a.ends") - F.col("bar")) <= 1e-9),
        ("right", "left", breaks.select("score_id", F.col("next_no").alias("measure_no"), F.col("measure_no").alias("break_no"), F.col("next_start").alias("edge"), "bar"), F.abs(F.col("a.at")) <= 1e-9),
    ):
        near = rows.join(at, ["score_id", "measure_no"]).withColumn("edge_distance", F.abs(F.col(edge)["x"] - F.col("edge")) / F.col("spacing")).where(F.col("edge_distance") <= BREAK_EDGE)
        pairs = near.join(own, ["score_id", "measure_no", "staff"]).where(holds).withColumn("d", note_distance(F.col(note), F.col("a")) / F.col("spacing")).where(F.col("d") <= BREAK_REACH)
        best = pairs.groupBy("score_id", "break_no", "staff", "measure_no", "curve_id", "edge_distance", "placement").agg(F.min(F.struct("d", F.col("a.note_id").alias("note_id"), F.col("a.pitch").alias("pitch"), F.col("a.voice").alias("voice"))).alias("n"))
        p = "from" if note == "left" else "to"
        sides.append(best.select("score_id", "break_no", "staff", F.col("measure_no").alias(f"{p}_measure"), F.col("curve_id").alias(f"{p}_curve"), F.col("n.note_id").alias(f"{p}_id"), F.col("n.pitch").alias(f"{p}_pitch"), F.col("n.voice").alias(f"{p}_voice"), F.col("placement").alias(f"{p}_placement"), F.col("n.d").alias(f"{p}_d"), (F.col("n.d") + F.col("edge_distance")).alias(f"{p}_score")))
    both = sides[0].join(sides[1], ["score_id", "break_no", "staff"]).where((F.col("from_pitch") == F.col("to_pitch")) & _agree("from_voice", "to_voice") & _agree("from_placement", "to_placement"))
    both = both.withColumn("score", F.col("from_score") + F.col("to_score"))
    known = ties.select("score_id", F.col("start_measure").alias("from_measure"), "from_id", F.col("end_measure").alias("to_measure"), "to_id").distinct()
    both = both.join(known, ["score_id", "from_measure", "from_id", "to_measure", "to_id"], "left_anti")
    both = both.withColumn("_place", F.concat_ws("/", F.lit("\u0000break"), F.col("break_no").cast("string"), F.col("staff").cast("string")))
    chosen = each_group(both, ["score_id"], ["break_no", "staff", "score", "from_curve", "to_curve"], _once(both.columns, ["from_curve", "to_curve", "_place"]), _schema(both))
    return chosen.select(
        "score_id", F.concat("from_curve", F.lit("+"), "to_curve").alias("curve_id"), F.col("from_measure").alias("start_measure"), "from_id", F.col("to_measure").alias("end_measure"), "to_id", "staff",
        F.col("from_pitch").alias("pitch"), F.coalesce("from_placement", "to_placement").alias("placement"), F.col("from_d").alias("start_distance"), F.col("to_d").alias("end_distance"),
        F.greatest(F.lit(0.72), F.least(F.lit(0.97), 0.97 - 0.08 * F.col("score"))).alias("confidence"),
    )
