import math

from scoreloom.operators import rhythm

EVENTS = "score_id string, measure_no int, staff int, voice int, id string, x double, at double, duration double, direction string"


def events(spark, rows):
    return spark.createDataFrame([("s", 1, *r) for r in rows], EVENTS)


def bars(spark):
    return spark.createDataFrame([("s", 1, 1.0)], "score_id string, measure_no int, bar double")


def test_overfull_voice_splits(spark):
    rows = [(1, 1, "a", 0.2, 0.0, 1.0, "up"), (1, 1, "b", 0.1, 0.0, 0.5, "down"), (1, 1, "c", 5.0, 0.5, 0.5, "down"), (2, 1, "d", 0.0, 0.0, 0.5, "up"), (2, 1, "e", 3.0, 0.0, 0.5, "down"), (2, 1, "f", 4.0, 0.0, 0.5, None)]
    found = {r.id: r.voice for r in rhythm.split_overfull(events(spark, rows), bars(spark)).collect()}
    assert found == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1}


def test_anchor_of_the_other_staff(spark):
    rows = [(1, 1, "a", 4.0, 0.0, 0.5, None), (2, 1, "b", 0.0, 0.0, 0.5, None), (2, 1, "c", 4.2, 0.5, 0.5, None)]
    found = {r.id: r.at for r in rhythm.shift_by_anchor(events(spark, rows), bars(spark), 0.9).collect()}
    assert found == {"a": 0.5, "b": 0.0, "c": 0.5}


def test_curves(spark):
    kind = "score_id string, curve_id int, note_id string, pitch string, ordinal int, cost double"
    starts = spark.createDataFrame([("s", 1, "a", "C4", 1, 0.1), ("s", 2, "a", "C4", 1, 0.1), ("s", 3, "a", "C4", 1, 0.1)], kind)
    ends = spark.createDataFrame([("s", 1, "b", "C4", 2, 0.2), ("s", 1, "c", "D4", 3, 0.1), ("s", 2, "c", "D4", 3, 0.1), ("s", 4, "z", "C4", 1, 0.0)], kind)
    found = {r.curve_id: (r.kind, r.end_id) for r in rhythm.classify_curves(starts, ends).collect()}
    assert found == {1: ("tie-like", "b"), 2: ("slur", "c"), 3: ("rejected", None), 4: ("rejected", None)}


def test_axis_and_projection(spark):
    points = spark.createDataFrame([(1, float(i), 0.5 * (i % 2)) for i in range(11)] + [(2, 0.0, float(i)) for i in range(5)], "shape int, x double, y double")
    found = {r["shape"]: r for r in rhythm.principal_axis(points, ["shape"]).collect()}
    assert abs(found[1].angle) < 0.1 and abs(found[1].major - 5) < 0.1 and abs(abs(found[2].angle) - math.pi / 2) < 1e-9
    measures = spark.createDataFrame([("s", 1, 1, 0.0, 10.0), ("s", 1, 2, 10.0, 20.0)], "score_id string, system_id int, measure_no int, x_start double, x_end double")
    marks = spark.createDataFrame([("s", 1, 10.0), ("s", 1, 0.0), ("s", 1, 25.0)], "score_id string, system_id int, x double")
    number = lambda later: {r.x: r.measure_no for r in rhythm.project_x(marks, measures, later).collect()}
    assert number(True) == {10.0: 2, 0.0: 1, 25.0: None} and number(False) == {10.0: 1, 0.0: 1, 25.0: None}


def test_variants_do_not_repeat(spark):
    scores = spark.createDataFrame([("a",), ("b",)], "score_id string")
    dims = [spark.createDataFrame([(i,) for i in range(3)], f"{c} int") for c in ("f", "g")]
    found = rhythm.sample_variants(scores, dims, 5, 7)
    assert found.count() == found.select("score_id", "f", "g").distinct().count() == 10
    assert found.collect() == rhythm.sample_variants(scores, dims, 5, 7).collect()
