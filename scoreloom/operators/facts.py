"""Gates, attachments and decisions on the shapes of engraved pages: from strokes and labels to facts.

Every operator keeps the rows it rejects, with a decision that says why, unless it is named a gate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEM = ["score_id", "measure_no", "stem_id"]
_BEAM = ["score_id", "measure_no", "beam_id"]

#: Rest labels, note types and durations.
RESTS = (
    ("LONG_REST", "long", "4"), ("BREVE_REST", "breve", "2"), ("WHOLE_REST", "whole", "1"), ("HALF_REST", "half", "1/2"), ("QUARTER_REST", "quarter", "1/4"),
    ("EIGHTH_REST", "eighth", "1/8"), ("GEOMETRIC_EIGHTH_REST", "eighth", "1/8"), ("ONE_16TH_REST", "16th", "1/16"), ("ONE_32ND_REST", "32nd", "1/32"),
    ("ONE_64TH_REST", "64th", "1/64"), ("ONE_128TH_REST", "128th", "1/128"),
)
#: Where in its box an accidental points, as shares of width and height.
ANCHORS = (("flat", 0.86, 0.68), ("double-flat", 0.90, 0.68), ("sharp", 0.86, 0.5), ("natural", 0.86, 0.5), ("double-sharp", 0.86, 0.5))


# --- gates ---------------------------------------------------------------------------------------------------------


def stem_candidates(strokes: DataFrame, max_ratio: float = 0.18, min_length: float = 1.25, max_width: float = 0.38) -> DataFrame:
    """Strokes (x0, y0, x1, y1, width, spacing) that may be stems, with length and vertical_ratio (dx over dy)."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    rows = strokes.withColumns({"length": F.hypot(dx, dy), "vertical_ratio": F.when(dy > 0.001, dx / dy)})
    return rows.where((F.col("spacing") > 0) & (F.col("length") >= min_length * F.col("spacing")) & (F.col("vertical_ratio") <= max_ratio) & (F.col("width") <= max_width * F.col("spacing")))


def beam_candidates(strokes: DataFrame, min_length: float = 0.55, min_width: float = 0.22, max_width: float = 0.80, max_slope: float = 0.75) -> DataFrame:
    """Strokes (x0, y0, x1, y1, width, spacing) that may be beams, with length and slope."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = strokes.withColumns({"length": F.hypot(dx, dy), "slope": F.when(F.abs(dx) > 0.001, dy / dx)})
    thick = F.col("width") / F.col("spacing")
    return rows.where((F.col("spacing") > 0) & (F.col("length") >= min_length * F.col("spacing")) & thick.between(min_width, max_width) & (F.abs("slope") <= max_slope))


def recover_beam_boxes(boxes: DataFrame, min_length: float = 0.85, max_length: float = 4.50, min_thick: float = 0.22, max_thick: float = 0.80, min_aspect: float = 1.75) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y, spacing) that may be short beams, as strokes along their middle."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    fits = (F.col("spacing") > 0) & (w / F.col("spacing")).between(min_length, max_length) & (h / F.col("spacing")).between(min_thick, max_thick) & (w >= min_aspect * h)
    middle = (F.col("min_y") + F.col("max_y")) / 2
    return boxes.where(fits).withColumns({"x0": F.col("min_x"), "x1": F.col("max_x"), "y0": middle, "y1": middle, "width": h})


def drop_oversized(elements: DataFrame, measures: DataFrame, staffs: DataFrame) -> DataFrame:
    """Elements (score_id, min_x, min_y, max_x, max_y) but those both wider than the widest measure (x_start, x_end) and
    higher than the highest staff (top, bottom, spacing) with a spacing on either side. Without measures or staffs
    nothing is too large."""
    width = measures.groupBy("score_id").agg(F.max(F.col("x_end") - F.col("x_start")).alias("_w"))
    height = staffs.groupBy("score_id").agg(F.max(F.col("bottom") - F.col("top") + 2 * F.col("spacing")).alias("_h"))
    rows = elements.join(width, "score_id", "left").join(height, "score_id", "left")
    large = (F.col("max_x") - F.col("min_x") > F.col("_w")) & (F.col("max_y") - F.col("min_y") > F.col("_h"))
    return rows.where(~F.coalesce(large, F.lit(False))).drop("_w", "_h")


def text_atoms(shapes: DataFrame, max_width: float = 8.0, max_height: float = 5.0) -> DataFrame:
    """Shapes (min_x, min_y, max_x, max_y, spacing) small enough to be part of a text."""
    small = (F.col("max_x") - F.col("min_x") <= max_width * F.col("spacing")) & (F.col("max_y") - F.col("min_y") <= max_height * F.col("spacing"))
    return shapes.where((F.col("spacing") > 0) & small)


def uncertain(text: Column, confidence: Column, least: float = 0.90) -> Column:
    """Whether a reading is empty or below the least confidence."""
    return F.coalesce(F.trim(text), F.lit("")).eqNullSafe("") | (F.coalesce(confidence, F.lit(0.0)) < least)


def accept_runs(members: DataFrame, by: Sequence[str], max_width: float = 18.0) -> DataFrame:
    """by, n, min_x, max_x of the text runs worth another reading: two members at least, one of them uncertain, and not
    wider than max_width spacings. members: text, confidence, min_x, max_x, spacing."""
    found = members.groupBy(*by).agg(
        F.count("*").alias("n"), F.bool_or(uncertain(F.col("text"), F.col("confidence"))).alias("_u"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.max("spacing").alias("_s")
    )
    return found.where((F.col("n") >= 2) & F.col("_u") & (F.col("max_x") - F.col("min_x") <= max_width * F.col("_s"))).drop("_u", "_s")


def whole_alternatives(shapes: DataFrame, max_width: float = 5.0, max_height: float = 4.0) -> DataFrame:
    """shapes (score_id, shape_id, bounds, spacing) and, for parts X.1, X.2 ... of a glyph that together are small, X.whole."""
    base = F.regexp_extract("shape_id", r"^(.*)\.\d+$", 1)
    parts = shapes.withColumn("_base", base).where("_base <> ''")
    whole = parts.groupBy("score_id", "_base").agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in ("min_x", "min_y")), *(F.max(c).alias(c) for c in ("max_x", "max_y", "spacing")))
    fits = (F.col("_n") >= 2) & (F.col("max_x") - F.col("min_x") <= max_width * F.col("spacing")) & (F.col("max_y") - F.col("min_y") <= max_height * F.col("spacing"))
    whole = whole.where(fits).withColumn("shape_id", F.concat("_base", F.lit(".whole"))).drop("_n", "_base")
    return shapes.unionByName(whole, allowMissingColumns=True)


def prefer_whole(readings: DataFrame) -> DataFrame:
    """readings (score_id, shape_id) without the parts of glyphs that are there as a whole."""
    whole = readings.where(F.col("shape_id").endswith(".whole")).select("score_id", F.regexp_replace("shape_id", r"\.whole$", "").alias("_base")).distinct()
    rows = readings.withColumn("_base", F.regexp_extract("shape_id", r"^(.*)\.\d+$", 1))
    return rows.join(whole, ["score_id", "_base"], "left_anti").select(*readings.columns)


# --- stems and beams -----------------------------------------------------------------------------------------------


def stem_direction(matches: DataFrame, least: float = 0.35, max_ratio: float = 0.18, max_edge: float = 0.34) -> DataFrame:
    """score_id, measure_no, stem_id, note_ids, direction, cross_staff, confidence of each stem with heads.

    matches: a row for each head of a stem with note_id, staff, center_y, score, edge_distance, and y0, y1, spacing,
    vertical_ratio of the stem. The direction is where the stem sticks out further by `least` spacings.
    """
    above = F.greatest(F.min("center_y") - F.min(F.least("y0", "y1")), F.lit(0.0))
    below = F.greatest(F.max(F.greatest("y0", "y1")) - F.max("center_y"), F.lit(0.0))
    best = F.max_by(F.struct("score", "edge_distance"), F.struct("score", (-F.col("edge_distance")).alias("near")))
    found = matches.groupBy(*_STEM).agg(
        F.array_sort(F.collect_set("note_id")).alias("note_ids"), above.alias("_above"), below.alias("_below"), F.max("spacing").alias("_s"), F.max("vertical_ratio").alias("_v"), best.alias("_b"), (F.count_distinct("staff") > 1).alias("cross_staff")
    )
    margin = F.col("_s") * least
    direction = F.when(F.col("_above") >= F.col("_below") + margin, "up").when(F.col("_below") >= F.col("_above") + margin, "down").otherwise("ambiguous")
    unit = lambda c: F.least(F.greatest(1.0 - c, F.lit(0.0)), F.lit(1.0))
    confidence = 0.45 * F.col("_b.score") + 0.30 * unit(F.col("_v") / max_ratio) + 0.25 * unit(F.col("_b.edge_distance") / max_edge)
    return found.select(*_STEM, "note_ids", direction.alias("direction"), "cross_staff", confidence.alias("confidence"))


def resolve_winners(matches: DataFrame, **limits: float) -> tuple[DataFrame, DataFrame]:
    """(stems, conflicts): each head keeps its best stem by score, edge distance, the stem's confidence and its id, and
    stems are judged anew by what they keep. conflicts: score_id, measure_no, note_id, stem_ids (the winner first).

    matches: as for stem_direction. A stem that keeps no head is rejected as 'lost-notehead-competition'.
    """
    first = stem_direction(matches, **limits).select(*_STEM, F.col("confidence").alias("_c"))
    order = [F.desc("score"), "edge_distance", F.desc("_c"), "stem_id"]
    ranked = matches.join(first, _STEM).withColumn("_r", F.row_number().over(Window.partitionBy("score_id", "measure_no", "note_id").orderBy(*order)))
    kept = stem_direction(ranked.where("_r = 1").drop("_r", "_c"), **limits)
    nothing = F.array().cast(dict(kept.dtypes)["note_ids"])
    rows = first.select(*_STEM).join(kept, _STEM, "left").withColumn("accepted", F.col("note_ids").isNotNull())
    stems = rows.select(
        *_STEM, F.coalesce("note_ids", nothing).alias("note_ids"), F.coalesce("direction", F.lit("ambiguous")).alias("direction"), F.coalesce("cross_staff", F.lit(False)).alias("cross_staff"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "accepted", F.when(F.col("accepted"), "attached").otherwise("lost-notehead-competition").alias("decision"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", "stem_id"))), lambda x: x["stem_id"])
    conflicts = ranked.groupBy("score_id", "measure_no", "note_id").agg(ordered.alias("stem_ids")).where(F.size("stem_ids") > 1)
    return stems, conflicts


def rank_beams(matches: DataFrame) -> DataFrame:
    """matches (beam_id, stem_id, tip_distance) with rank: 1 for the beam nearest to the stem's free tip."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(*_STEM).orderBy("tip_distance", "beam_id")))


def beam_levels(matches: DataFrame, least: float = 0.60) -> DataFrame:
    """score_id, measure_no, beam_id, n_stems, level, agreement: the rank that most of a beam's stems give it, then the
    smaller; null where fewer than `least` of them agree."""
    votes = rank_beams(matches).groupBy(*_BEAM, "rank").agg(F.count("*").alias("n"))
    found = votes.groupBy(*_BEAM).agg(F.sum("n").alias("n_stems"), F.max_by("rank", F.struct("n", (-F.col("rank")).alias("low"))).alias("level"), F.max("n").alias("_most"))
    agreement = F.col("_most") / F.col("n_stems")
    return found.select(*_BEAM, "n_stems", F.when(agreement >= least, F.col("level")).alias("level"), agreement.alias("agreement"))


def validate_beams(beams: DataFrame) -> DataFrame:
    """beams (n_stems, level, left_supported, right_supported) with accepted, hook and decision: a first level joins two
    stems and ends at stems on both sides, a further one ends at one stem at least and is a hook if at one only."""
    left, right, primary = F.col("left_supported"), F.col("right_supported"), F.col("level") == 1
    decision = (
        F.when(F.col("level").isNull(), "ambiguous-beam-level")
        .when(primary & (F.col("n_stems") < 2), "primary-beam-needs-two-stems")
        .when(primary & ~(left & right), "primary-beam-needs-both-ends-supported")
        .when(primary, "attached-primary-beam")
        .when(~left & ~right, "secondary-beam-needs-supported-end")
        .when(left & right, "attached-secondary-beam")
        .otherwise("attached-beam-hook")
    )
    rows = beams.withColumn("decision", decision)
    return rows.withColumns({"accepted": F.col("decision").startswith("attached"), "hook": F.col("decision") == "attached-beam-hook"})


# --- rests, accidentals, ties --------------------------------------------------------------------------------------


def rest_facts(candidates: DataFrame) -> DataFrame:
    """candidates (label, confidence, center_y, top, spacing, touches_stem) with rest_type, duration, confidence,
    accepted and decision. The label HW_REST_set is a whole or half rest by the side of the staff line it sits on."""
    known = F.map_from_entries(F.array(*(F.struct(F.lit(label), F.struct(F.lit(kind).alias("type"), F.lit(d).alias("duration"))) for label, kind, d in RESTS)))
    pitch = 2.0 * (F.col("center_y") - F.col("top")) / F.col("spacing") - 4.0
    phase = F.pmod(F.round(pitch * 2.0), F.lit(4)).cast("int")
    either = F.col("label") == "HW_REST_set"
    flat = F.col("spacing") > 0
    decision = (
        F.when(either & F.coalesce("touches_stem", F.lit(False)), "half-whole-rest-touches-stem")
        .when(either & ~flat, "invalid-staff-spacing")
        .when(either & ~phase.isin(1, 3), "ambiguous-half-whole-rest-position")
        .when(~either & F.try_element_at(known, F.col("label")).isNull(), "unsupported-rest-label")
        .otherwise("accepted")
    )
    rows = candidates.withColumn("decision", decision).withColumn("accepted", F.col("decision") == "accepted")
    found = F.when(either, F.when(phase == 1, F.try_element_at(known, F.lit("WHOLE_REST"))).otherwise(F.try_element_at(known, F.lit("HALF_REST")))).otherwise(F.try_element_at(known, F.col("label")))
    rows = rows.withColumn("_f", F.when(F.col("accepted"), found))
    confidence = F.when(~F.col("accepted"), 0.0).when(either, F.col("confidence") * 0.98).otherwise(F.col("confidence"))
    return rows.withColumns({"rest_type": F.col("_f.type"), "duration": F.col("_f.duration"), "confidence": confidence}).drop("_f")


def accidental_anchor(rows: DataFrame) -> DataFrame:
    """rows (kind, min_x, min_y, max_x, max_y) with anchor_x, anchor_y; null for another kind."""
    x = y = F.lit(None).cast("double")
    for kind, across, down in ANCHORS:
        hit = F.col("kind") == kind
        x = F.when(hit, F.col("min_x") + (F.col("max_x") - F.col("min_x")) * across).otherwise(x)
        y = F.when(hit, F.col("min_y") + (F.col("max_y") - F.col("min_y")) * down).otherwise(y)
    return rows.withColumns({"anchor_x": x, "anchor_y": y})


def exclude_key_symbols(accidentals: DataFrame, key_symbols: DataFrame) -> DataFrame:
    """accidentals without the shapes that a key signature uses. Both: score_id, shape_id."""
    return accidentals.join(key_symbols.select("score_id", "shape_id").distinct(), ["score_id", "shape_id"], "left_anti")


def accept_ties(curves: DataFrame, slurs: DataFrame, matches: DataFrame) -> DataFrame:
    """score_id, curve_id, left_id, right_id, accepted, decision of the tie-like curves that no slur uses.

    curves: score_id, curve_id, stitched (over a break); matches: curve_id, left_id, right_id of a one-to-one matching.
    """
    rows = curves.join(slurs.select("score_id", "curve_id").distinct(), ["score_id", "curve_id"], "left_anti").join(matches, ["score_id", "curve_id"], "left")
    decision = F.when(F.coalesce("stitched", F.lit(False)), "stitched").when(F.col("left_id").isNotNull(), "matched").otherwise("no-unique-pair")
    return rows.select("score_id", "curve_id", "left_id", "right_id", (decision != "no-unique-pair").alias("accepted"), decision.alias("decision"))


def nearest_of_two(items: DataFrame, staffs: DataFrame, least: float = 0.35) -> DataFrame:
    """items (score_id, item_id, center_y, staff) with the nearer of the staffs above and below them where it is nearer
    by more than `least` spacings; else as they are. staffs: score_id, staff, top, bottom, spacing."""
    y = F.col("center_y")
    distance = F.greatest(F.col("top") - y, y - F.col("bottom"), F.lit(0.0))
    near = items.select("score_id", "item_id", "center_y").join(staffs.withColumnRenamed("staff", "_staff"), "score_id")
    both = near.groupBy("score_id", "item_id").agg(
        F.min(F.when(F.col("bottom") <= y, F.struct(distance.alias("d"), "_staff", "spacing"))).alias("a"), F.min(F.when(F.col("top") >= y, F.struct(distance.alias("d"), "_staff", "spacing"))).alias("b")
    )
    margin = F.greatest("a.spacing", "b.spacing") * least
    pick = F.when(F.col("a.d") + margin < F.col("b.d"), F.col("a._staff")).when(F.col("b.d") + margin < F.col("a.d"), F.col("b._staff"))
    return items.join(both.select("score_id", "item_id", pick.alias("_to")), ["score_id", "item_id"], "left").withColumn("staff", F.coalesce("_to", "staff")).drop("_to")


# --- layout and headers --------------------------------------------------------------------------------------------


def pair_staffs(staffs: DataFrame) -> DataFrame:
    """score_id, system_id, upper, lower: neighbours in the order of their tops, two by two, numbered from 1; a last
    staff without partner has no lower one. staffs: score_id, staff_id, top."""
    rows = staffs.withColumn("_r", F.row_number().over(Window.partitionBy("score_id").orderBy("top", "staff_id")) - 1)
    side = lambda odd: F.max(F.when(F.col("_r") % 2 == odd, F.col("staff_id")))
    pairs = rows.groupBy("score_id", (F.floor(F.col("_r") / 2) + 1).cast("int").alias("system_id"))
    return pairs.agg(side(0).alias("upper"), side(1).alias("lower"))


def header_roles(texts: DataFrame) -> DataFrame:
    """texts (score_id, text_id, center_y, min_x) with role: of a header the first is its title, the last its composer,
    those between subtitles."""
    down = Window.partitionBy("score_id").orderBy("center_y", "min_x", "text_id")
    rank, n = F.row_number().over(down), F.count("*").over(Window.partitionBy("score_id"))
    return texts.withColumn("role", F.when(rank == 1, "title").when(rank == n, "composer").otherwise("subtitle"))


def clef_changes(clefs: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Of clefs (score_id, staff, measure_no, sign, line, octave_change) those that differ from the one in force.

    measures (score_id, measure_no, break_before, x_start, x_end): clefs count at measure 1 and after breaks only, in the
    first 0.35 of the measure, and of a staff's the leftmost (x), then the surest (confidence). Without measures all count;
    of several in one measure the order is that of sign, line and octave.
    """
    names, what = clefs.columns, F.struct("sign", "line", "octave_change")
    if measures is not None:
        begins = measures.where((F.col("measure_no") == 1) | F.col("break_before").isNotNull())
        limit = F.col("_a") + 0.35 * (F.col("_b") - F.col("_a"))
        held = clefs.join(begins.select("score_id", "measure_no", F.col("x_start").alias("_a"), F.col("x_end").alias("_b")), ["score_id", "measure_no"]).where(F.col("x") <= limit)
        first = Window.partitionBy("score_id", "staff", "measure_no").orderBy("x", F.desc("confidence"), what)
        clefs = held.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*names)
    over = Window.partitionBy("score_id", "staff").orderBy("measure_no", what)
    return clefs.withColumn("_before", F.lag(what).over(over)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(what)).drop("_before")


def inherit_flag(facts: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """facts with the value in force where none is printed, and inherited: whether it is taken from before."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return facts.withColumn("inherited", F.col(value).isNull() & before.isNotNull()).withColumn(value, F.coalesce(F.col(value), before))


def union_bounds(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, the box of all members, and mean_x, mean_y, mean_width of theirs."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("min_x", "min_y")), *(F.max(c).alias(c) for c in ("max_x", "max_y")),
        F.avg((F.col("min_x") + F.col("max_x")) / 2).alias("mean_x"), F.avg((F.col("min_y") + F.col("max_y")) / 2).alias("mean_y"), F.avg(F.col("max_x") - F.col("min_x")).alias("mean_width"),
    )


def layout_counters(staffs: DataFrame, measures: DataFrame, elements: DataFrame) -> DataFrame:
    """score_id, counter, n: staffs, systems and measures of a score, and its elements by how they came to their owner
    (generation; null: none)."""
    count = lambda df, name: df.groupBy("score_id").agg(F.count("*").alias("n")).select("score_id", F.lit(name).alias("counter"), "n")
    found = count(staffs, "staffs").unionByName(count(measures.select("score_id", "system_id").distinct(), "systems")).unionByName(count(measures, "measures"))
    name = F.concat(F.lit("owned:"), F.coalesce(F.col("generation").cast("string"), F.lit("none")))
    return found.unionByName(elements.groupBy("score_id", name.alias("counter")).agg(F.count("*").alias("n")).select("score_id", "counter", "n"))


# --- decisions -----------------------------------------------------------------------------------------------------


def facts_from_decisions(decisions: DataFrame, columns: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """score_id, the columns, confidence and source_shape_ids of the accepted decisions; sources: columns of ids, or of
    arrays of them, that a fact cites, each id once and in order."""
    kinds = dict(decisions.dtypes)
    cited = [F.col(c) if kinds[c].startswith("array") else F.array(c) for c in sources]
    ids = F.array_sort(F.array_distinct(F.array_compact(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in cited)))))
    return decisions.where("accepted").select("score_id", *columns, "confidence", ids.alias("source_shape_ids"))


def run_counters(decisions: DataFrame, step: str) -> DataFrame:
    """score_id, step, decision, accepted, n: how often each decision was made."""
    return decisions.groupBy("score_id", F.lit(step).alias("step"), "decision", "accepted").agg(F.count("*").alias("n"))


def write_decisions(decisions: DataFrame, path: str, step: str) -> None:
    """Append the decisions of a step to a Parquet table that is partitioned by step."""
    decisions.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)


def order_events(events: DataFrame) -> DataFrame:
    """events with place from 1 in each measure: by time, staff, voice and id, nulls first."""
    when = F.col("at_num") / F.col("at_den")
    over = Window.partitionBy("score_id", "part_idx", "measure_no").orderBy(when, "staff", "voice", "event_id")
    return events.withColumn("place", F.row_number().over(over))


def measure_end(onsets: DataFrame) -> DataFrame:
    """score_id, measure_no, ticks: where the last event ends. onsets: at and duration in whole ticks."""
    return onsets.groupBy("score_id", "measure_no").agg(F.max(F.col("at") + F.col("duration")).alias("ticks"))


def measure_totals(events: DataFrame, bars: DataFrame) -> DataFrame:
    """score_id, measure_no, staff, ticks, bars, off: a staff's summed durations, the nearest whole number of bars of 1
    or more, and how many ticks it is off. events: ticks (whole); bars: score_id, measure_no, bar (ticks)."""
    rows = events.groupBy("score_id", "measure_no", "staff").agg(F.sum("ticks").alias("ticks")).join(bars, ["score_id", "measure_no"])
    whole = F.greatest(F.floor((2 * F.col("ticks") + F.col("bar")) / (2 * F.col("bar"))), F.lit(1))
    return rows.select("score_id", "measure_no", "staff", "ticks", whole.alias("bars"), F.abs(F.col("ticks") - whole * F.col("bar")).alias("off"))


def first_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of an order: a listing, so Spark keeps n rows a task."""
    return df.orderBy(*order).limit(n)
