from scoreloom.operators import ledgers

STAFF = "score_id string, staff_id int, spacing double, min_x double, min_y double, max_x double, max_y double"
LINE = "score_id string, staff_id int, stroke_id string, y double, x_start double, x_end double"
STROKE = "score_id string, stroke_id string, y double, x_start double, x_end double"
HEAD = "score_id string, shape_id string, x double, y double, major double"
MEASURE = "score_id string, staff_id int, measure_id string, x_start double, x_end double"


def page(spark, strokes, heads=(), second=None):
    """A staff from y 100 to 140 with spacing 10, and perhaps a second one."""
    tops = [100.0] + ([second] if second else [])
    staffs = spark.createDataFrame([("s", i, 10.0, 0.0, t, 500.0, t + 40) for i, t in enumerate(tops)], STAFF)
    lines = spark.createDataFrame([("s", i, f"line{i}{k}", t + 10 * k, 0.0, 500.0) for i, t in enumerate(tops) for k in range(5)], LINE)
    segments = ledgers.ledger_segments(staffs, lines, spark.createDataFrame([("s", n, float(y), float(a), float(b)) for n, y, a, b in strokes], STROKE))
    measures = spark.createDataFrame([("s", i, m, a, a + 250) for i in range(len(tops)) for m, a in (("m1", 0.0), ("m2", 250.0))], MEASURE)
    found = ledgers.ledger_ladder(spark.createDataFrame([("s", n, float(x), float(y), 6.0) for n, x, y in heads], HEAD), staffs, measures, segments)
    return segments, {r["shape_id"]: (r["staff_id"], r["measure_id"], r["direction"], r["staff_step"], r["levels"]) for r in found.collect()}


def test_a_chain_ends_where_a_step_is_missing_or_away(spark):
    strokes = [("a1", 90, 50, 70), ("a2", 81, 52, 72), ("a3", 70, 100, 120), ("a5", 50, 50, 70), ("b1", 150, 10, 30), ("long", 90, 0, 60), ("short", 90, 0, 3), ("on", 101, 50, 70), ("off", 94, 50, 70), ("far", -100, 5, 20)]
    segments, _ = page(spark, strokes)
    assert sorted((r["direction"], r["step"], r["stroke_id"]) for r in segments.collect()) == [("above", 1, "a1"), ("above", 2, "a2"), ("below", 1, "b1")]
    assert sorted((r["direction"], r["step"], r["y"], r["n"]) for r in ledgers.ledger_levels(segments).collect()) == [("above", 1, 90.0, 1), ("above", 2, 81.0, 1), ("below", 1, 150.0, 1)]


def test_a_head_needs_every_ledger_up_to_its_own(spark):
    strokes = [("a1", 90, 50, 70), ("a2", 80, 50, 70), ("a1x", 90, 300, 320), ("b1", 150, 50, 70), ("b2", 160, 52, 72), ("b3", 170, 54, 74)]
    heads = [("two", 60, 80), ("space", 60, 75), ("one", 60, 90), ("missing", 310, 80), ("three", 62, 170), ("between", 60, 77.5), ("aside", 90, 80)]
    assert page(spark, strokes, heads)[1] == {"two": (0, "m1", "above", -4, 2), "space": (0, "m1", "above", -5, 2), "three": (0, "m1", "below", 14, 3)}


def test_two_staffs_with_a_claim_are_none(spark):
    """Four steps between the staffs: the middle one is the second of both."""
    strokes = [(f"k{y}", y, 50, 70) for y in (150, 160, 170)]
    assert page(spark, strokes, [("h", 60, 160)], second=180.0)[1] == {}
    assert page(spark, strokes, [("h", 60, 160)], second=195.0)[1] == {"h": (0, "m1", "below", 12, 2)}


def test_nothing(spark):
    segments, found = page(spark, [])
    assert segments.count() == 0 and found == {}
