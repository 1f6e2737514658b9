"""Gates and decisions on shapes, each on a few rows with the expected outcome worked out by hand or by plain Python."""

import random

import pytest

from scoreloom.operators import facts as f


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stroke_gates(spark):
    strokes = [("stem", 0.0, 0.0, 1.0, 40.0, 2.0, 10.0), ("slanted", 0.0, 0.0, 9.0, 40.0, 2.0, 10.0), ("short", 0.0, 0.0, 0.0, 12.0, 2.0, 10.0), ("beam", 0.0, 0.0, 30.0, 9.0, 5.0, 10.0), ("steep", 0.0, 0.0, 10.0, 9.0, 5.0, 10.0), ("flat", 0.0, 0.0, 9.0, 0.0, 5.0, 0.0)]
    df = spark.createDataFrame(strokes, "id string, x0 double, y0 double, x1 double, y1 double, width double, spacing double")
    assert rows(f.stem_candidates(df), "id") == [("stem",)] and rows(f.beam_candidates(df), "id") == [("beam",)]
    boxes = spark.createDataFrame([("ok", 0.0, 0.0, 20.0, 5.0, 10.0), ("thin", 0.0, 0.0, 20.0, 1.0, 10.0), ("square", 0.0, 0.0, 9.0, 8.0, 10.0)], "id string, min_x double, min_y double, max_x double, max_y double, spacing double")
    assert rows(f.recover_beam_boxes(boxes), "id", "x1", "y0", "width") == [("ok", 20.0, 2.5, 5.0)] and f.text_atoms(boxes).count() == 3
    box = spark.createDataFrame([("s", "large", 0.0, 0.0, 90.0, 90.0), ("s", "wide", 0.0, 0.0, 90.0, 5.0), ("t", "any", 0.0, 0.0, 900.0, 900.0)], "score_id string, id string, min_x double, min_y double, max_x double, max_y double")
    measures, staffs = spark.createDataFrame([("s", 0.0, 50.0)], "score_id string, x_start double, x_end double"), spark.createDataFrame([("s", 0.0, 40.0, 10.0)], "score_id string, top double, bottom double, spacing double")
    assert rows(f.drop_oversized(box, measures, staffs), "id") == [("any",), ("wide",)]


MATCHES = "score_id string, measure_no int, stem_id string, note_id string, staff int, center_y double, score double, edge_distance double, y0 double, y1 double, spacing double, vertical_ratio double"


def test_stems_take_their_heads_and_the_best_stem_wins(spark):
    df = spark.createDataFrame(
        [("s", 1, "a", "n1", 1, 50.0, 0.9, 0.1, 20.0, 52.0, 10.0, 0.0), ("s", 1, "a", "n2", 2, 40.0, 0.8, 0.1, 20.0, 52.0, 10.0, 0.0), ("s", 1, "b", "n1", 1, 50.0, 0.5, 0.0, 49.0, 90.0, 10.0, 0.09), ("s", 1, "c", "n3", 1, 50.0, 0.5, 0.34, 48.0, 52.0, 10.0, 0.0)], MATCHES
    )
    stems, conflicts = f.resolve_winners(df)
    found = {r.stem_id: r for r in stems.collect()}
    assert (found["a"].direction, found["a"].note_ids, found["a"].cross_staff) == ("up", ["n1", "n2"], True)
    assert found["a"].confidence == pytest.approx(0.45 * 0.9 + 0.30 + 0.25 * (1 - 0.1 / 0.34))
    assert (found["b"].accepted, found["b"].decision, found["b"].note_ids) == (False, "lost-notehead-competition", [])
    assert found["c"].direction == "ambiguous" and rows(conflicts, "note_id", "stem_ids") == [("n1", ["a", "b"])]
    assert f.resolve_winners(df.limit(0))[0].count() == 0


def test_beam_levels_and_rules(spark):
    matches = [("s", 1, "b1", f"t{i}", 0.1) for i in range(3)] + [("s", 1, "b2", f"t{i}", 0.9) for i in range(2)] + [("s", 1, "x", "t2", 0.5), ("s", 1, "x", "u", 0.5)]
    df = spark.createDataFrame(matches, "score_id string, measure_no int, beam_id string, stem_id string, tip_distance double")
    assert rows(f.beam_levels(df), "beam_id", "n_stems", "level") == sorted([("b1", 3, 1), ("b2", 2, 2), ("x", 2, None)], key=str)
    beams = [(1, 3, True, True), (1, 1, True, True), (1, 2, True, False), (2, 1, True, False), (2, 2, True, True), (3, 0, False, False), (None, 2, True, True)]
    df = spark.createDataFrame(beams, "level int, n_stems int, left_supported boolean, right_supported boolean")
    assert [(r.decision, r.accepted, r.hook) for r in f.validate_beams(df).collect()] == [
        ("attached-primary-beam", True, False), ("primary-beam-needs-two-stems", False, False), ("primary-beam-needs-both-ends-supported", False, False), ("attached-beam-hook", True, True),
        ("attached-secondary-beam", True, False), ("secondary-beam-needs-supported-end", False, False), ("ambiguous-beam-level", False, False),
    ]


def test_rests_accidentals_and_ties(spark):
    df = spark.createDataFrame(
        [("QUARTER_REST", 0.9, 20.0, 0.0, 10.0, False), ("HW_REST_set", 0.5, 12.5, 0.0, 10.0, False), ("HW_REST_set", 0.5, 17.5, 0.0, 10.0, None), ("HW_REST_set", 0.5, 15.0, 0.0, 10.0, False), ("HW_REST_set", 0.5, 12.5, 0.0, 10.0, True), ("HW_REST_set", 0.5, 1.0, 0.0, 0.0, False), ("CLEF", 0.9, 0.0, 0.0, 10.0, False)],
        "label string, confidence double, center_y double, top double, spacing double, touches_stem boolean",
    )
    assert [(r.rest_type, r.duration, r.decision) for r in f.rest_facts(df).collect()] == [
        ("quarter", "1/4", "accepted"), ("whole", "1", "accepted"), ("half", "1/2", "accepted"), (None, None, "ambiguous-half-whole-rest-position"), (None, None, "half-whole-rest-touches-stem"), (None, None, "invalid-staff-spacing"), (None, None, "unsupported-rest-label"),
    ]
    df = spark.createDataFrame([("flat", 0.0, 0.0, 10.0, 20.0), ("sharp", 0.0, 0.0, 10.0, 20.0), ("other", 0.0, 0.0, 1.0, 1.0)], "kind string, min_x double, min_y double, max_x double, max_y double")
    assert [(r.anchor_x, r.anchor_y) for r in f.accidental_anchor(df).collect()] == [(8.6, pytest.approx(13.6)), (8.6, 10.0), (None, None)]
    two = "score_id string, shape_id string"
    assert rows(f.exclude_key_symbols(spark.createDataFrame([("s", "a"), ("s", "b")], two), spark.createDataFrame([("s", "a"), ("s", "a")], two)), "shape_id") == [("b",)]
    curves = spark.createDataFrame([("s", "c1", False), ("s", "c2", True), ("s", "c3", None), ("s", "c4", False)], "score_id string, curve_id string, stitched boolean")
    found = f.accept_ties(curves, spark.createDataFrame([("s", "c4")], "score_id string, curve_id string"), spark.createDataFrame([("s", "c1", "l", "r")], "score_id string, curve_id string, left_id string, right_id string"))
    assert rows(found, "curve_id", "decision", "accepted") == [("c1", "matched", True), ("c2", "stitched", True), ("c3", "no-unique-pair", False)]
    staffs = spark.createDataFrame([("s", 1, 0.0, 40.0, 10.0), ("s", 2, 100.0, 140.0, 10.0)], "score_id string, staff int, top double, bottom double, spacing double")
    items = spark.createDataFrame([("s", "r", 55.0, 2), ("s", "m", 70.0, 1), ("s", "in", 20.0, 1)], "score_id string, item_id string, center_y double, staff int")
    assert rows(f.nearest_of_two(items, staffs), "item_id", "staff") == [("in", 1), ("m", 1), ("r", 1)]


def test_layout_headers_and_changes(spark):
    staffs = spark.createDataFrame([("s", f"f{i}", float(100 * i)) for i in (2, 0, 1, 3, 4)], "score_id string, staff_id string, top double")
    assert rows(f.pair_staffs(staffs).na.fill("-"), "system_id", "upper", "lower") == [(1, "f0", "f1"), (2, "f2", "f3"), (3, "f4", "-")]
    texts = spark.createDataFrame([("s", "a", 1.0, 0.0), ("s", "b", 2.0, 0.0), ("s", "c", 3.0, 9.0), ("s", "d", 3.0, 1.0), ("t", "x", 1.0, 1.0)], "score_id string, text_id string, center_y double, min_x double")
    assert rows(f.header_roles(texts), "text_id", "role") == [("a", "title"), ("b", "subtitle"), ("c", "composer"), ("d", "subtitle"), ("x", "title")]
    clefs = spark.createDataFrame([("s", 1, 1, "G", 2, None), ("s", 1, 5, "G", 2, None), ("s", 1, 9, "F", 4, None), ("s", 2, 9, "F", 4, 0)], "score_id string, staff int, measure_no int, sign string, line int, octave_change int")
    assert rows(f.clef_changes(clefs), "staff", "measure_no") == [(1, 1), (1, 9), (2, 9)]
    times = spark.createDataFrame([("s", 1, None), ("s", 2, "4/4"), ("s", 3, None)], "score_id string, system_id int, time string")
    assert [(r.time, r.inherited) for r in f.inherit_flag(times, ["score_id"], ["system_id"], "time").orderBy("system_id").collect()] == [(None, False), ("4/4", False), ("4/4", True)]
    measures = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "score_id string, system_id int")
    elements = spark.createDataFrame([("s", 1), ("s", None)], "score_id string, generation int")
    assert rows(f.layout_counters(staffs, measures, elements), "counter", "n") == [("measures", 3), ("owned:1", 1), ("owned:none", 1), ("staffs", 5), ("systems", 2)]


def test_glyph_parts_runs_and_boxes(spark):
    shapes = spark.createDataFrame([("s", "x.1", 0.0, 0.0, 10.0, 9.0, 10.0), ("s", "x.2", 12.0, 0.0, 20.0, 9.0, 10.0), ("s", "y.1", 0.0, 0.0, 1.0, 1.0, 10.0), ("s", "z", 0.0, 0.0, 1.0, 1.0, 10.0)], "score_id string, shape_id string, min_x double, min_y double, max_x double, max_y double, spacing double")
    both = f.whole_alternatives(shapes)
    assert rows(both.where("shape_id = 'x.whole'"), "min_x", "max_x") == [(0.0, 20.0)] and both.count() == 5
    assert rows(f.prefer_whole(both), "shape_id") == [("x.whole",), ("y.1",), ("z",)]
    runs = spark.createDataFrame([(1, "a", 0.99, 0.0, 10.0, 10.0), (1, "", 0.99, 12.0, 20.0, 10.0), (2, "a", 0.99, 0.0, 9.0, 10.0), (2, "b", 0.95, 0.0, 9.0, 10.0), (3, None, 0.1, 0.0, 9.0, 10.0)], "run int, text string, confidence double, min_x double, max_x double, spacing double")
    assert rows(f.accept_runs(runs, ["run"]), "run", "n", "max_x") == [(1, 2, 20.0)]
    assert rows(f.union_bounds(shapes, ["score_id"]), "n", "max_x", "mean_x", "mean_width") == [(4, 20.0, (5 + 16 + 0.5 + 0.5) / 4, (10 + 8 + 1 + 1) / 4)]


def test_decisions_orders_and_sums(spark, tmp_path):
    df = spark.createDataFrame([("s", "p", True, 0.5, "b", ["c", "a", "b"], "ok"), ("s", "q", False, 0.1, "x", None, "no"), ("s", "r", True, 0.9, None, None, "ok")], "score_id string, pitch string, accepted boolean, confidence double, head string, others array<string>, decision string")
    assert rows(f.facts_from_decisions(df, ["pitch"], ["head", "others"]), "pitch", "source_shape_ids") == [("p", ["a", "b", "c"]), ("r", [])]
    assert rows(f.run_counters(df, "heads"), "step", "decision", "n") == [("heads", "no", 1), ("heads", "ok", 2)]
    f.write_decisions(df, f"{tmp_path}/d", "heads")
    f.write_decisions(df.limit(1), f"{tmp_path}/d", "stems")
    assert rows(spark.read.parquet(f"{tmp_path}/d").groupBy("step").count(), "step", "count") == [("heads", 3), ("stems", 1)]
    rng = random.Random(2)
    events = [("s", 0, rng.randrange(3), rng.randrange(8), 4, rng.choice([None, 1, 2]), 1, f"e{i}") for i in range(60)]
    df = spark.createDataFrame(events, "score_id string, part_idx int, measure_no int, at_num int, at_den int, staff int, voice int, event_id string")
    found = [r.event_id for r in f.order_events(df).orderBy("measure_no", "place").collect()]
    assert found == [e[-1] for e in sorted(events, key=lambda e: (e[2], e[3], e[5] or 0, e[6], e[7]))]
    assert [r.event_id for r in f.first_n(df, ["event_id"], 2).collect()] == ["e0", "e1"]
    ticks = [(rng.randrange(3), rng.randrange(2), rng.randrange(1, 40)) for _ in range(40)]
    df = spark.createDataFrame([("s", *t) for t in ticks], "score_id string, measure_no int, staff int, ticks long")
    bars = spark.createDataFrame([("s", m, 48) for m in range(3)], "score_id string, measure_no int, bar long")
    for m, staff, total, n, off in (tuple(r)[1:] for r in f.measure_totals(df, bars).collect()):
        assert total == sum(t for a, b, t in ticks if (a, b) == (m, staff)) and off == min(abs(total - 48 * k) for k in range(1, 60)) and off == abs(total - 48 * n)
    ends = spark.createDataFrame([("s", 1, 0, 3), ("s", 1, 2, 2), ("s", 2, 5, 1)], "score_id string, measure_no int, at long, duration long")
    assert rows(f.measure_end(ends), "measure_no", "ticks") == [(1, 4), (2, 6)]
