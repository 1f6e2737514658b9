"""Notation, rhythm and ranking steps on a few rows each."""

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import notation as n
from scoreloom.operators import ranking, rhythm
from scoreloom.plans import score_diff, score_jobs


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_durations_from_heads_stems_flags_dots_and_tuplets(spark):
    ids = "score_id string, note_id string"
    heads = spark.createDataFrame([("s", "a", False, 1.0), ("s", "b", True, 1.0), ("s", "c", False, 1.0), ("s", "d", True, 0.5), ("s", "e", False, 1.0)], f"{ids}, hollow boolean, confidence double")
    stems = spark.createDataFrame([("s", "a", "t1"), ("s", "d", "t2"), ("s", "e", "t1")], f"{ids}, stem_id string")
    levels = spark.createDataFrame([("s", "t1", 1), ("s", "t1", 2), ("s", "t2", 1)], "score_id string, stem_id string, level int")
    dots, tuplets = spark.createDataFrame([("s", "a", 1)], f"{ids}, n int"), spark.createDataFrame([("s", "c", 3, 2)], f"{ids}, actual int, normal int")
    found = {r.note_id: (r.duration.num, r.duration.den, r.confidence) for r in n.effective_durations(heads, stems, levels, dots, tuplets, spark.createDataFrame([("s", "e")], ids)).collect()}
    assert found == {"a": (3, 32, 1.0), "b": (1, 1, 1.0), "c": (1, 6, 0.65), "d": (1, 2, pytest.approx(0.3)), "e": (0, 1, 1.0)}


def test_chords_dots_gates_and_consumed_shapes(spark):
    heads = [("s", 1, 1, "a", "t", False, 0.0, 9.0), ("s", 1, 1, "b", "t", False, 0.0, 9.0), ("s", 1, 1, "c", None, True, 20.0, 30.0), ("s", 1, 1, "d", None, True, 28.0, 40.0), ("s", 1, 1, "e", None, True, 50.0, 60.0), ("s", 1, 1, "f", "u", True, 0.0, 9.0)]
    df = spark.createDataFrame(heads, "score_id string, measure_no int, staff int, note_id string, stem_id string, hollow boolean, min_x double, max_x double")
    assert rows(n.build_chords(df), "note_ids", "anchor_x") == [(["a", "b"], 4.5), (["c", "d"], 29.5)]
    dots = spark.createDataFrame([("s", "k", "a", "1/4", 0), ("s", "k", "b", "1/4", 1), ("s", "m", "c", "1/4", 1), ("s", "m", "d", "1/2", 0)], "score_id string, chord_id string, note_id string, base string, dots int")
    assert rows(n.normalize_chord_dots(dots), "note_id", "dots") == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]
    labels = spark.createDataFrame([("SHARP", "accidental", "sharp", 0.8), ("G_CLEF", "clef", "G", 0.5)], "label string, role string, value string, min_confidence double")
    shapes = spark.createDataFrame([("SHARP", 0.8), ("SHARP", 0.7), ("G_CLEF", 0.9), ("X", 1.0)], "label string, confidence double")
    assert rows(n.gate(shapes, labels, "accidental"), "value", "confidence") == [("sharp", 0.8)]
    shape = spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "x")], "score_id string, shape_id string")
    cited = spark.createDataFrame([("s", ["x", "z"]), ("s", None)], "score_id string, source_shape_ids array<string>")
    assert rows(n.exclude_consumed(shape, cited), "score_id", "shape_id") == [("s", "y"), ("t", "x")]
    dynamics = spark.createDataFrame([("s", 1, 1, "0", "p", 0.5, 1), ("s", 1, 1, "0", "p", 0.9, 2), ("s", 1, 1, "0", "p", 0.9, 3), ("s", 1, 1, "0", "f", 0.1, 4)], "score_id string, measure_no int, staff int, at string, value string, confidence double, seq int")
    assert rows(n.dedup_dynamics(dynamics), "value", "seq") == [("f", 4), ("p", 2)]


def test_grid_and_measures_of_systems(spark):
    heads = spark.createDataFrame([(0.0, 0.0, 10.0), (12.0, 0.0, 10.0), (-5.0, 0.0, 10.0)], "center_y double, top double, spacing double")
    assert [(r.staff_step, round(r.staff_step_error, 9)) for r in n.fit_grid(heads).collect()] == [(0, 0.0), (2, 0.4), (-1, 0.0)]
    bounds = [("s", 1, 0.0, None), ("s", 1, 10.0, "final"), ("s", 1, 20.0, None), ("s", 2, 0.0, None), ("s", 2, 15.0, "final")]
    df = spark.createDataFrame(bounds, "score_id string, system_id int, x double, style string")
    assert rows(n.measures_from_boundaries(df), "measure_no", "system_id", "x_start", "x_end", "break_before", "right_barline") == sorted([(1, 1, 0.0, 10.0, None, None), (2, 1, 10.0, 20.0, None, None), (3, 2, 0.0, 15.0, "system", "final")], key=str)
    assert "right_barline" not in n.measures_from_boundaries(df.drop("style")).columns


def test_agreement_spread_onsets_and_octaves(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (3, None), (4, 0.0)], "k int, v double")
    assert rows(ranking.agree_or_flag(df, ["k"], "v"), "k", "v", "agrees") == sorted([(1, 2.0, True), (2, 1.0, False), (3, None, None), (4, 0.0, True)], key=str)
    assert rows(ranking.coef_variation(df, ["k"], "v"), "k", "cv") == sorted([(1, 0.0), (2, 0.5), (3, None), (4, None)], key=str)
    marks = spark.createDataFrame([("s", 1, "m", 10.0), ("s", 1, "far", 99.0)], "score_id string, measure_no int, mark_id string, x double")
    onsets = spark.createDataFrame([("s", 1, 8.0, "0"), ("s", 1, 11.0, "1/4"), ("s", 2, 10.0, "1/2")], "score_id string, measure_no int, x double, at string")
    assert rows(rhythm.nearest_onset(marks, onsets, 5.0), "mark_id", "at") == sorted([("m", "1/4"), ("far", None)], key=str)
    notes = spark.createDataFrame([("s", "a", 1, 3.0, 4), ("s", "b", 1, 9.0, 4), ("s", "c", 2, 3.0, 4)], "score_id string, note_id string, staff int, place double, octave int")
    spans = spark.createDataFrame([("s", 1, 0.0, 5.0, "up", 8), ("s", 2, 0.0, 5.0, "down", 15)], "score_id string, staff int, start double, end double, direction string, size int")
    assert rows(rhythm.octave_offset(notes, spans), "note_id", "octave") == [("a", 5), ("b", 4), ("c", 2)]
    assert [r.p for r in spark.createDataFrame([(0.0,), (5.0,), (20.0,)], "y double").select(rhythm.placement(F.col("y"), F.lit(1.0), F.lit(9.0)).alias("p")).collect()] == ["above", None, "below"]


def test_voices_that_return_and_lone_late_events(spark):
    schema = "score_id string, measure_no int, staff int, voice int, id string, x double, at double, duration double, pitch string, x_share double"
    events = spark.createDataFrame([("s", 1, 1, 1, "a", 1.0, 0.0, 0.25, "C4", 0.1), ("s", 1, 1, 2, "b", 9.0, 0.0, 0.25, "C4", 0.7), ("s", 1, 1, 2, "c", 9.5, 0.25, 0.25, "D4", 0.8)], schema)
    rests = spark.createDataFrame([("s", 1, 1, 1, 5.0)], "score_id string, measure_no int, staff int, voice int, x double")
    assert rows(rhythm.continue_voice(events, rests), "id", "voice") == [("a", 1), ("b", 1), ("c", 2)]
    bars = spark.createDataFrame([("s", 1, 1.0)], "score_id string, measure_no int, bar double")
    lone = events.where("id <> 'c'")
    assert rows(rhythm.fit_to_end(lone, bars), "id", "at") == [("a", 0.0), ("b", 0.75)]


def test_limits_and_orders_of_issues(spark):
    measures = [("s", p, i, "system" if i == 2 else None) for p in (0, 1) for i in range(5)]
    df = spark.createDataFrame(measures, "score_id string, part_idx int, measure_idx int, break_before string")
    assert rows(score_jobs.limit_scope(df, 1, 9), "part_idx", "measure_idx") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert score_jobs.limit_scope(df, 9, 3).count() == 6
    issues = spark.createDataFrame([("c", "Pitch", 0, 1, at, 1, "note.pitch", "a", "b", "Critical") for at in ("1/4", "1/16", "0", "3/2", "12")], "case_id string, category string, part_idx int, measure_no int, at string, event_staff int, code string, expected string, actual string, severity string")
    in_order = lambda by_value: [r["at"] for r in score_diff.order_issues(issues, by_value).orderBy("seq").collect()]
    assert in_order(True) == ["0", "1/16", "1/4", "3/2", "12"] and in_order(False) == sorted(["1/4", "1/16", "0", "3/2", "12"])
    cases = spark.createDataFrame([("c", None), ("d", None), ("e", "unreadable")], "case_id string, error string")
    summary = score_diff.corpus_summary(cases, issues)
    assert rows(summary, "case_id", "status", "n") == [("c", "differences", 5), ("d", "clean", 0), ("e", "FAILED", 0)]
    total = score_diff.corpus_totals(summary).first()
    assert (total.cases, total.failed, total.clean, total.differences, total.critical) == (3, 1, 1, 1, 5)
