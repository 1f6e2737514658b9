"""Steps from notation facts to sounding events: pitch, duration, chords, onsets, and what symbols attach to.

Facts are rows keyed by score_id, measure_no and staff; x is horizontal, y grows downward, distances are in staff
spacings where a limit says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fractions, text
from . import ranking, sequences

STAFF = ["score_id", "staff"]
_ALTER = {"sharp": 1, "flat": -1, "natural": 0, "double-sharp": 2, "flat-flat": -2}


def accidental_alters(accidentals: DataFrame, notes: DataFrame, reach: float = 0.45) -> DataFrame:
    """note_id and alter of the notes each accidental holds for: the first note to its right on about its step (at most
    reach steps away) is its target, and it holds for that step from there to the step's next accidental in the
    measure."""
    by = ["score_id", "measure_no", "staff"]
    pairs = accidentals.join(notes.select(*by, "note_id", F.col("x").alias("note_x"), "staff_step"), by)
    pairs = pairs.where((F.col("note_x") >= F.col("x")) & (F.abs(F.col("staff_step") - F.col("step")) <= reach))
    target = pairs.groupBy(*by, "accidental_id", "kind").agg(F.min(F.struct("note_x", "note_id", "staff_step")).alias("t"))
    table = F.create_map(*(F.lit(x) for kv in _ALTER.items() for x in kv))
    states = target.select(*by, F.col("t.staff_step").alias("staff_step"), F.col("t.note_x").alias("x"), table[F.col("kind")].alias("alter"))
    held = sequences.asof_state(notes.select(*by, "staff_step", "x", "note_id"), states, [*by, "staff_step"], ["x"], ["alter"])
    return held.where("alter IS NOT NULL").select("score_id", "note_id", "alter")


def pitches(notes: DataFrame, clefs: DataFrame, keys: DataFrame, accidentals: DataFrame) -> DataFrame:
    """note_id, step, octave, alter, pitch, midi, is_explicit: the last clef at or before a note on its staff, the last
    key signature up to its measure, accidentals over both. A note without a clef, or with one other than G and F, has
    a null pitch, which callers report."""
    order = ["measure_no", "x"]
    rows = sequences.asof_state(notes, clefs, STAFF, order, ["sign", "line"])
    rows = sequences.asof_state(rows, keys, STAFF, ["measure_no"], ["fifths"])
    rows = rows.join(accidental_alters(accidentals, notes), ["score_id", "note_id"], "left")
    plain = text.diatonic(F.col("staff_step"), F.col("sign"), F.col("line"))
    rows = rows.withColumn("d", plain).withColumn("is_explicit", F.col("alter").isNotNull())
    rows = rows.withColumn("alter", F.coalesce("alter", text.key_alter(F.col("d.step"), F.coalesce("fifths", F.lit(0)))))
    pitch = text.pitch_text(F.col("d.step"), F.col("alter"), F.col("d.octave"))
    return rows.select("score_id", "measure_no", "staff", "note_id", "d.step", "d.octave", "alter", pitch.alias("pitch"), text.midi(pitch).alias("midi"), "is_explicit")


def written_duration(hollow: Column, has_stem: Column, level: Column) -> Column:
    """struct<num, den>: whole without stem if hollow, half, quarter, then halved by each flag or beam level."""
    den = F.when(hollow & ~has_stem, 1).when(hollow, 2).otherwise(4 * F.pow(F.lit(2), F.greatest(level, F.lit(0))))
    return fractions.frac(F.lit(1).cast("long"), den.cast("long"))


def effective_durations(heads: DataFrame, stems: DataFrame, levels: DataFrame, dots: DataFrame, tuplets: DataFrame, grace: DataFrame | None = None) -> DataFrame:
    """note_id, duration (struct), confidence: the written duration, dots and tuplet ratio applied.

    heads: note_id, hollow, confidence; stems: note_id, stem_id; levels (flags and beams): stem_id, level; dots:
    note_id, n; tuplets: note_id, actual, normal; grace: note_id of notes that last nothing. All carry score_id. A filled
    head without stem keeps 0.65 of its confidence, a hollow head under a flag 0.60.
    """
    level = levels.groupBy("score_id", "stem_id").agg(F.max("level").alias("level"))
    rows = heads.join(stems.select("score_id", "note_id", "stem_id"), ["score_id", "note_id"], "left").join(level, ["score_id", "stem_id"], "left")
    rows = rows.join(dots.groupBy("score_id", "note_id").agg(F.max("n").alias("dots")), ["score_id", "note_id"], "left")
    rows = rows.join(tuplets.groupBy("score_id", "note_id").agg(F.min_by(F.struct("actual", "normal"), "actual").alias("t")), ["score_id", "note_id"], "left")
    written = written_duration(F.col("hollow"), F.col("stem_id").isNotNull(), F.coalesce("level", F.lit(0)))
    rows = rows.withColumn("w", written)
    rows = rows.withColumn("w", fractions.dotted(F.col("w.num"), F.col("w.den"), F.least(F.coalesce("dots", F.lit(0)), F.lit(12))))
    rows = rows.withColumn("w", F.when(F.col("t").isNotNull(), fractions.tuplet(F.col("w.num"), F.col("w.den"), F.col("t.actual"), F.col("t.normal"))).otherwise(F.col("w")))
    if grace is not None:
        marked = grace.select("score_id", "note_id").distinct().withColumn("_grace", F.lit(True))
        nothing = fractions.frac(F.lit(0).cast("long"), F.lit(1).cast("long"))
        rows = rows.join(marked, ["score_id", "note_id"], "left").withColumn("w", F.when(F.col("_grace"), nothing).otherwise(F.col("w")))
    factor = F.when(~F.col("hollow") & F.col("stem_id").isNull(), 0.65).when(F.col("hollow") & (F.col("level") > 0), 0.60).otherwise(1.0)
    return rows.select("score_id", "note_id", F.col("w").alias("duration"), (F.col("confidence") * factor).alias("confidence"))


def build_chords(heads: DataFrame) -> DataFrame:
    """chord_id, note_ids, anchor_x: two heads or more of one stem and fill; stemless ones by overlapping columns.

    heads: score_id, measure_no, staff, note_id, stem_id, hollow, min_x, max_x.
    """
    stemmed = heads.where("stem_id IS NOT NULL").select("*", F.concat(F.lit("s:"), "stem_id").alias("group"))
    loose = sequences.overlap_islands(heads.where("stem_id IS NULL"), ["score_id", "measure_no", "staff", "hollow"], "min_x", "max_x", ["note_id"], "column")
    loose = loose.select(*heads.columns, F.concat_ws(":", F.lit("c"), "measure_no", "staff", "column").alias("group"))
    rows = stemmed.unionByName(loose).groupBy("score_id", "measure_no", "hollow", "group")
    found = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("note_id")).alias("note_ids"), F.avg((F.col("min_x") + F.col("max_x")) / 2).alias("anchor_x")).where("n >= 2")
    return found.select("score_id", "measure_no", F.concat_ws("/", "group", F.col("hollow").cast("string")).alias("chord_id"), "hollow", "note_ids", "anchor_x")


def normalize_chord_dots(rows: DataFrame) -> DataFrame:
    """rows: score_id, chord_id, note_id, base, dots. Members that agree before dots all take the most dots."""
    over = Window.partitionBy("score_id", "chord_id")
    agree = F.min("base").over(over) == F.max("base").over(over)
    return rows.withColumn("dots", F.when(agree, F.max("dots").over(over)).otherwise(F.col("dots")))


def sequential_onsets(events: DataFrame) -> DataFrame:
    """events: score_id, measure_no, staff, voice, x, id, duration (struct). Adds at: the durations before it in its
    voice, exactly, in ticks of the least common denominator of its measure."""
    by = ["score_id", "measure_no", "staff", "voice"]
    base = fractions.lcm_of(F.collect_set("duration.den").over(Window.partitionBy("score_id", "measure_no")))
    rows = events.withColumn("_base", base).withColumn("_ticks", (F.col("duration.num") * F.col("_base") / F.col("duration.den")).cast("long"))
    rows = sequences.running_cursor(rows, by, ["x", "id"], "_ticks", "_at")
    return rows.withColumn("at", fractions.frac(F.col("_at"), F.col("_base"))).drop("_base", "_ticks", "_at")


def measure_fit(events: DataFrame, bars: DataFrame) -> DataFrame:
    """score_id, measure_no, staff, total, error: how far a staff's summed durations are from a whole number of bars.

    events: duration (double); bars: score_id, measure_no, bar (double), the bar's length in whole notes.
    """
    totals = events.groupBy("score_id", "measure_no", "staff").agg(F.sum("duration").alias("total")).join(bars, ["score_id", "measure_no"])
    ratio = F.col("total") / F.col("bar")
    return totals.select("score_id", "measure_no", "staff", "total", F.abs(ratio - F.greatest(F.round(ratio), F.lit(1.0))).alias("error"))


def attach(items: DataFrame, anchors: DataFrame, by: Sequence[str], item: str, anchor: str, limit: Column, cost: Column, ambiguous: float | None = None) -> DataFrame:
    """items joined to their cheapest anchor inside the limit: by, item, anchor, cost, accepted, decision.

    limit and cost are columns of both sides. Every item has a row: 'attached', 'no-candidate', or 'ambiguous' if the
    second-best costs less than `ambiguous` more.
    """
    near = items.join(anchors, list(by)).where(limit).select(*by, item, anchor, cost.cast("double").alias("cost"))
    over = Window.partitionBy(*by, item).orderBy("cost", anchor)
    ranked = near.withColumns({"_r": F.row_number().over(over), "_next": F.lead("cost").over(over)}).where("_r = 1")
    rows = items.select(*by, item).join(ranked.drop("_r"), [*by, item], "left")
    close = F.lit(False) if ambiguous is None else F.coalesce(F.col("_next") - F.col("cost") < ambiguous, F.lit(False))
    decision = F.when(F.col(anchor).isNull(), "no-candidate").when(close, "ambiguous").otherwise("attached")
    return rows.select(*by, item, anchor, "cost", decision.alias("decision")).withColumn("accepted", F.col("decision") == "attached")


def gate(instances: DataFrame, labels: DataFrame, role: str) -> DataFrame:
    """Instances whose label has the role with its least confidence. labels: label, role, value, min_confidence."""
    wanted = labels.where(F.col("role") == role)
    return instances.join(wanted, "label").where(F.col("confidence") >= F.col("min_confidence"))


def exclude_consumed(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates whose shape no accepted fact cites. sources: score_id, source_shape_ids."""
    used = sources.select("score_id", F.explode("source_shape_ids").alias("shape_id")).distinct()
    return candidates.join(used, ["score_id", "shape_id"], "left_anti")


def dedup_dynamics(facts: DataFrame) -> DataFrame:
    """One dynamic per (measure, staff, at, value): the most confident, then the first to arrive."""
    return ranking.top_k(facts, ["score_id", "measure_no", "staff", "at", "value"], [F.desc("confidence"), "seq"], 1).drop("rank")


def fit_grid(heads: DataFrame) -> DataFrame:
    """Adds staff_step (nearest half spacing below the top line, half to even) and staff_step_error. heads: center_y,
    top, spacing."""
    steps = (F.col("center_y") - F.col("top")) * 2 / F.col("spacing")
    return heads.withColumn("staff_step", F.rint(steps).cast("int")).withColumn("staff_step_error", F.abs(steps - F.rint(steps)))


def measures_from_boundaries(boundaries: DataFrame) -> DataFrame:
    """score_id, system_id, measure_no, x_start, x_end, break_before: between neighbouring boundaries of each system,
    numbered over all systems. boundaries: score_id, system_id, x, and style if they have one; then right_barline is
    'final' where the last boundary of a score is."""
    over = Window.partitionBy("score_id", "system_id").orderBy("x")
    if "style" in boundaries.columns:
        boundaries = boundaries.withColumn("_style", F.lead("style").over(over))
    rows = boundaries.withColumns({"x_end": F.lead("x").over(over), "_first": F.row_number().over(over) == 1}).where("x_end IS NOT NULL")
    all_ = Window.partitionBy("score_id").orderBy("system_id", "x")
    later = F.col("system_id") > F.min("system_id").over(Window.partitionBy("score_id"))
    found = rows.select("*", F.row_number().over(all_).alias("measure_no"), F.col("x").alias("x_start"), F.when(F.col("_first") & later, "system").alias("break_before"))
    columns = ["score_id", "system_id", "measure_no", "x_start", "x_end", "break_before"]
    if "style" not in boundaries.columns:
        return found.select(*columns)
    last = F.col("measure_no") == F.max("measure_no").over(Window.partitionBy("score_id"))
    return found.select(*columns, F.when(last & (F.col("_style") == "final"), "final").alias("right_barline"))
