"""Voices of a staff's measure, and rests between the staves of a pair.

Whether a measure has two voices is an exists join of its events with themselves. Most have one and need no more; only
the others walk through the ordered rules, a measure at a time. Rests between staves move one after the other, as each
move changes what the next one sees; only measures with such rests are looked at.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import materialize
from .groupwise import Columns, each_group

_STAFF = ["score_id", "measure_no", "staff"]
#: Fixed values, in staff spacings.
OPPOSITE_STEMS, REST_PAIR, REST_APART, NOTE_REST, DISPLACED, OUTSIDE, STEMLESS, CENTRE, ORDERED = 0.72, 0.68, 0.52, 0.58, 0.52, 0.12, 0.72, 0.16, 0.20
#: Fixed value: the gain, in bars, for which a rest moves to the other staff.
GAIN = 0.12


def voice_events(heads: DataFrame, stems: DataFrame, chords: DataFrame, rests: DataFrame) -> DataFrame:
    """score_id, measure_no, staff, kind (chord, note, rest), id, x, top, bottom, direction, stem_x, confidence: one event
    for a chord, for a head of no chord, and for a rest.

    heads: score_id, measure_no, staff, shape_id, x, y, confidence; stems: score_id, measure_no, stem_id, direction (Up,
    Down, Ambiguous), start_x, end_x, confidence, head_ids; chords: score_id, measure_no, chord_id, head_ids, stem_id, x,
    confidence; rests as heads. A chord is at home on the staff of most of its heads, then the smaller; a chord without
    heads is no event. A head takes the surest stem, then the first by id.
    """
    key = ["score_id", "measure_no"]
    axis = ((F.col("start_x") + F.col("end_x")) / 2).alias("stem_x")
    # Chords: their heads, counted by staff.
    members = chords.select(*key, "chord_id", F.explode(F.array_distinct("head_ids")).alias("shape_id")).join(heads.select(*key, "shape_id", "staff", "y"), [*key, "shape_id"])
    by_staff = members.groupBy(*key, "chord_id", "staff").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    home = by_staff.groupBy(*key, "chord_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "staff", "top", "bottom")).alias("h"))
    of_chord = stems.select(*key, "stem_id", "direction", axis)
    chord = chords.join(home, [*key, "chord_id"]).join(of_chord, [*key, "stem_id"], "left").select(
        *key, F.col("h.staff").alias("staff"), F.lit("chord").alias("kind"), F.col("chord_id").alias("id"), "x", F.col("h.top").alias("top"), F.col("h.bottom").alias("bottom"), "direction", "stem_x", "confidence"
    )
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "stem_id", "direction", axis)).alias("s")
    of_head = stems.select(*key, "stem_id", "direction", "start_x", "end_x", "confidence", F.explode("head_ids").alias("shape_id")).groupBy(*key, "shape_id").agg(best)
    note = heads.join(members.select(*key, "shape_id").distinct(), [*key, "shape_id"], "left_anti").join(of_head, [*key, "shape_id"], "left").select(
        *key, "staff", F.lit("note").alias("kind"), F.col("shape_id").alias("id"), "x", F.col("y").alias("top"), F.col("y").alias("bottom"), F.col("s.direction").alias("direction"), F.col("s.stem_x").alias("stem_x"),
        F.least("confidence", -F.col("s.c")).alias("confidence"),
    )
    empty = F.lit(None)
    rest = rests.select(*key, "staff", F.lit("rest").alias("kind"), F.col("shape_id").alias("id"), "x", F.col("y").alias("top"), F.col("y").alias("bottom"), empty.cast("string").alias("direction"), empty.cast("double").alias("stem_x"), "confidence")
    return chord.unionByName(note).unionByName(rest)


def _middle(row: Column | None = None) -> Column:
    of = (lambda c: F.col(c)) if row is None else (lambda c: row[c])
    return (of("top") + of("bottom")) / 2


def polyphonic_staves(events: DataFrame, staves: DataFrame) -> DataFrame:
    """score_id, measure_no, staff of the measures with evidence of two voices: opposite stems at one x of heads or stems,
    two rests above each other, or a displaced rest above or below a note. staves: score_id, measure_no, staff, spacing,
    centre_y."""
    rows = events.join(staves.select(*_STAFF, F.greatest("spacing", F.lit(0.001)).alias("spacing"), "centre_y"), _STAFF).withColumn("y", _middle())
    names = ["id", "kind", "x", "y", "top", "bottom", "direction", "stem_x"]
    a = rows.select(*_STAFF, "spacing", "centre_y", F.struct(*names).alias("a"))
    b = rows.select(*_STAFF, F.struct(*names).alias("b"))
    near = lambda p, q, reach: F.abs(p - q) <= F.col("spacing") * reach
    a_, b_ = F.col("a"), F.col("b")
    stems = (a_["kind"] != "rest") & (b_["kind"] != "rest") & (a_["direction"] == "Up") & (b_["direction"] == "Down")
    stems &= near(a_["x"], b_["x"], OPPOSITE_STEMS) | F.coalesce(near(a_["stem_x"], b_["stem_x"], OPPOSITE_STEMS), F.lit(False))
    rests = (a_["kind"] == "rest") & (b_["kind"] == "rest") & (a_["id"] < b_["id"]) & near(a_["x"], b_["x"], REST_PAIR) & (F.abs(a_["y"] - b_["y"]) >= F.col("spacing") * REST_APART)
    mixed = (a_["kind"] == "rest") & (b_["kind"] != "rest") & near(a_["x"], b_["x"], NOTE_REST) & (F.abs(a_["y"] - F.col("centre_y")) >= F.col("spacing") * DISPLACED)
    mixed &= (a_["y"] < b_["top"] - F.col("spacing") * OUTSIDE) | (a_["y"] > b_["bottom"] + F.col("spacing") * OUTSIDE)
    return a.join(b, _STAFF).where(stems | rests | mixed).select(*_STAFF).distinct()


def _assign(rows: Columns) -> list[tuple]:
    """The ordered rules for one polyphonic staff's measure; rows come by x, y and id."""
    n, s = len(rows["id"]), max(rows["spacing"][0], 0.001)
    x, y, top, bottom, direction = (rows[c] for c in ("x", "y", "top", "bottom", "direction"))
    rests = [i for i in range(n) if rows["kind"][i] == "rest"]
    notes = [i for i in range(n) if rows["kind"][i] != "rest"]
    found: dict[int, tuple[int, float, str]] = {i: (1, 0.99, "up stem") if direction[i] == "Up" else (2, 0.99, "down stem") for i in notes if direction[i] in ("Up", "Down")}

    def closest(i: int, others: list[int], reach: float) -> int | None:
        """Of others within reach of i in x the closest in x, then in y, then the first."""
        return min((j for j in others if j != i and abs(x[j] - x[i]) <= s * reach), key=lambda j: (abs(x[j] - x[i]), abs(y[j] - y[i])), default=None)

    for i in notes:
        if i in found:
            continue
        peer = closest(i, [j for j in notes if j in found], STEMLESS)
        rest = min((j for j in rests if abs(x[j] - x[i]) <= s * STEMLESS), key=lambda j: abs(x[j] - x[i]), default=None)
        if peer is not None:
            voice = (1 if y[i] < y[peer] else 2) if abs(y[i] - y[peer]) >= s * ORDERED else found[peer][0]
            found[i] = (voice, 0.78, "aligned with a note")
        elif rest is not None and abs(y[i] - y[rest]) >= s * ORDERED:
            found[i] = (1 if y[i] < y[rest] else 2, 0.74, "aligned with a rest")
        else:
            found[i] = (1, 0.45, "no evidence")
    for i in rests:
        if i in found:
            continue
        open_rests = [j for j in rests if j not in found and abs(y[j] - y[i]) >= s * REST_APART]
        peer = closest(i, open_rests, REST_PAIR)
        if peer is not None:
            upper, lower = (i, peer) if y[i] <= y[peer] else (peer, i)
            found[upper], found[lower] = (1, 0.98, "upper of paired rests"), (2, 0.98, "lower of paired rests")
    for i in rests:
        if i in found:
            continue
        around = [j for j in notes if abs(x[j] - x[i]) <= s * NOTE_REST]
        voices = {found[j][0] for j in around}
        near = closest(i, around, NOTE_REST)
        off = y[i] - rows["centre_y"][i]
        if len(voices) == 1 and (y[i] < top[near] - s * OUTSIDE or y[i] > bottom[near] + s * OUTSIDE):
            found[i] = (3 - voices.pop(), 0.91, "beside a note of the other voice")
        elif abs(off) > s * CENTRE:
            found[i] = (1 if off < 0 else 2, 0.76, "above the centre" if off < 0 else "below the centre")
        else:
            found[i] = (1, 0.42, "no evidence")
    sure = rows["confidence"]
    return [(rows["score_id"][i], rows["measure_no"][i], rows["staff"][i], rows["kind"][i], rows["id"][i], voice, True, max(0.0, min(c, 1.0 if sure[i] is None else sure[i], 1.0)), why) for i, (voice, c, why) in sorted(found.items())]


def assign_voices(events: DataFrame, staves: DataFrame) -> DataFrame:
    """score_id, measure_no, staff, kind, id, voice, polyphonic, confidence, reason of every event of voice_events whose
    staff is in staves.

    Without evidence of two voices all are in voice 1, whatever their stems. Else stems up are voice 1 and down 2; heads
    without one follow an aligned note, then a rest; rests pair, stand beside a note, or go by the staff's centre. Rules
    see what earlier ones, and earlier events by x, y and id, have got. An event has its own id in its measure and kind.
    """
    double = materialize(polyphonic_staves(events, staves), "polyphonic")
    rows = events.join(staves.select(*_STAFF, "spacing", "centre_y"), _STAFF).withColumn("y", _middle())
    schema = f"score_id {dict(events.dtypes)['score_id']}, measure_no {dict(events.dtypes)['measure_no']}, staff {dict(events.dtypes)['staff']}, kind string, id {dict(events.dtypes)['id']}, voice int, polyphonic boolean, confidence double, reason string"
    single = rows.join(double, _STAFF, "left_anti").select(
        *_STAFF, "kind", "id", F.lit(1).alias("voice"), F.lit(False).alias("polyphonic"), F.greatest(F.least(F.lit(0.99), "confidence"), F.lit(0.0)).alias("confidence"), F.lit("one voice").alias("reason")
    )
    return single.unionByName(each_group(rows.join(double, _STAFF, "left_semi"), _STAFF, ["x", "y", "id"], _assign, schema))


def fit_error(total: Fraction, bar: Fraction) -> Fraction:
    """How far a staff's total is off the nearest whole number of bars, of 1 or more; halves go up. 0 for nothing."""
    if total <= 0 or bar <= 0:
        return Fraction(0)
    return abs(total - bar * max(1, int(total / bar + Fraction(1, 2))))


def move_interstaff_rests(rests: DataFrame, totals: DataFrame, pairs: DataFrame, gain: float = GAIN) -> DataFrame:
    """rests with staff and confidence as they are after moving, and moved (the gain in bars, null if it stays).

    rests: score_id, measure_no, staff (1, 2), id, seq, y, ticks (dots included), confidence; totals: score_id,
    measure_no, staff, ticks, the rests' own included; pairs: score_id, measure_no, bar (ticks), upper_bottom, lower_top.
    A rest between the staves goes to the other staff if that brings both staves' totals closer to whole bars, by gain of
    a bar or more; the next one, by seq and id, sees the new totals. A measure that is not in pairs stays as it is.
    """
    key = ["score_id", "measure_no"]
    kinds = dict(rests.dtypes)
    placed = rests.join(pairs.select(*key, "bar", "upper_bottom", "lower_top"), key, "left")
    between = F.coalesce((F.col("y") > F.col("upper_bottom")) & (F.col("y") < F.col("lower_top")), F.lit(False))
    of = lambda staff: F.coalesce(F.sum(F.when(F.col("staff") == staff, F.col("ticks"))), F.lit(0))
    sums = totals.groupBy(*key).agg(of(1).alias("_one"), of(2).alias("_two"))
    candidates = placed.where(between & F.col("staff").isin(1, 2)).select(*key, "staff", "id", "seq", "ticks", "bar").join(sums, key, "left")

    def solve(rows: Columns) -> list[tuple]:
        now = {1: Fraction(rows["_one"][0] or 0), 2: Fraction(rows["_two"][0] or 0)}
        bar, out = Fraction(rows["bar"][0] or 0), []
        for i, staff in enumerate(rows["staff"]):
            other, ticks = 3 - staff, rows["ticks"][i] or 0
            then = {staff: now[staff] - ticks, other: now[other] + ticks}
            better = sum(fit_error(now[k], bar) - fit_error(then[k], bar) for k in (1, 2))
            share = float(better) / max(float(bar), 1e-9)
            if share >= gain:
                now = then
                out.append((*(rows[k][0] for k in key), rows["id"][i], staff, other, share))
        return out

    schema = f"score_id {kinds['score_id']}, measure_no {kinds['measure_no']}, id {kinds['id']}, staff {kinds['staff']}, _to {kinds['staff']}, moved double"
    moves = each_group(candidates, key, ["seq", "id"], solve, schema)
    found = rests.join(moves, [*key, "id", "staff"], "left")
    sure = F.when(F.col("moved").isNotNull(), F.least("confidence", F.lit(0.94))).otherwise(F.col("confidence"))
    return found.withColumns({"staff": F.coalesce("_to", "staff"), "confidence": sure}).drop("_to")
