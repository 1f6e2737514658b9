"""Curves across breaks and ties without a claim: the contract's cases, and random pages against plain Python."""

import math
import random

import pytest

from scoreloom.operators import curves as cv

CURVE = "score_id string, measure_no int, staff int, curve_id string, spacing double, centerline array<struct<x:double,y:double>>"
ANCHOR = "score_id string, measure_no int, staff int, note_id string, x double, y double, radius double, stem struct<x1:double,y1:double,x2:double,y2:double>, pitch string, voice int, target_id string, at double, ends double"
MEASURE = "score_id string, measure_no int, x_start double, x_end double, break_before boolean, bar double"
CLAIM, TIE = "score_id string, curve_id string", "score_id string, start_measure int, from_id string, end_measure int, to_id string"


def tables(spark, curves, anchors, measures, claimed=(), ties=()):
    return (
        spark.createDataFrame([("s", m, s, c, sp, [{"x": float(x), "y": float(y)} for x, y in pts]) for m, s, c, sp, pts in curves], CURVE),
        spark.createDataFrame([("s", *a) for a in anchors], ANCHOR),
        spark.createDataFrame([("s", *m) for m in measures], MEASURE),
        spark.createDataFrame([("s", c) for c in claimed], CLAIM),
        spark.createDataFrame([("s", *t) for t in ties], TIE),
    )


def split_page(spark, breaks=True, second="F4", **more):
    """A long arc to a system's end and a short one 4.5 spacings after the next system's start."""
    sp = 27.72
    curves = [(1, 1, "out", sp, [(2296.38, 2340.56), (2601.36, 2370.0), (2906.35, 2340.56)]), (2, 1, "in", sp, [(270.232, 3283.43), (298.146, 3296.0), (326.06, 3283.43)])]
    anchors = [(1, 1, "n1", 2294.52, 2320.16, 15.0, None, "F4", 1, "n1", 0.0, 0.75), (2, 1, "n2", 329.75, 3263.03, 15.0, None, second, 1, "n2", 0.0, 0.75)]
    measures = [(1, 2238.06, 2915.77, False, 0.75), (2, 144.227, 1556.47, breaks, 0.75)]
    return tables(spark, curves, anchors, measures, **more)


def test_fragments_across_a_break_are_stitched(spark):
    curves, anchors, measures, *_ = split_page(spark)
    fragments, stitched = cv.stitch_fragments(curves, anchors, measures)
    found = {r["curve_id"]: r for r in fragments.collect()}
    assert (found["out"]["kind"], found["in"]["kind"]) == ("to system end", "from system start") and 4 < found["in"]["edge_distance"] < 5
    (r,) = stitched.collect()
    assert (r["curve_id"], r["from_note_id"], r["to_note_id"], r["placement"]) == ("out+in", "n1", "n2", "below") and r["from_pitch"] == r["to_pitch"]


def test_other_pitches_are_stitched_too_but_not_without_a_break(spark):
    curves, anchors, measures, *_ = split_page(spark, second="G4")
    (r,) = cv.stitch_fragments(curves, anchors, measures)[1].collect()
    assert (r["from_pitch"], r["to_pitch"]) == ("F4", "G4")
    curves, anchors, measures, *_ = split_page(spark, breaks=False)
    fragments, stitched = cv.stitch_fragments(curves, anchors, measures)
    assert fragments.count() == stitched.count() == 0


def test_a_curve_with_notes_at_both_ends_is_whole(spark):
    curves, anchors, measures, *_ = split_page(spark)
    more = spark.createDataFrame([("s", 1, 1, "n0", 2906.0, 2345.0, 5.0, None, "F4", 1, "n0", 0.0, 0.75)], ANCHOR)
    assert cv.stitch_fragments(curves, anchors.union(more), measures)[1].count() == 0


def test_ties_over_a_break_need_onsets(spark):
    def page(breaks=True, ends=1.0, at=0.0, second="F4", **more):
        curves = [(1, 1, "out", 10.0, [(70, 100), (85, 106), (99, 101)]), (2, 1, "in", 10.0, [(3, 101), (10, 106), (20, 100)])]
        anchors = [(1, 1, "n1", 66.0, 98.0, 4.0, None, "F4", 1, "n1", 0.5, ends), (2, 1, "n2", 24.0, 98.0, 4.0, None, second, None, "n2", at, 1.0)]
        return cv.recover_break_ties(*tables(spark, curves, anchors, [(1, 0.0, 100.0, False, 1.0), (2, 0.0, 100.0, breaks, 1.0)], **more)).collect()

    (r,) = page()
    assert (r["curve_id"], r["start_measure"], r["from_id"], r["end_measure"], r["to_id"], r["pitch"]) == ("out+in", 1, "n1", 2, "n2", "F4")
    assert not page(breaks=False) and not page(ends=0.75) and not page(at=0.25) and not page(second="G4")
    assert not page(claimed=["in"]) and not page(ties=[(1, "n1", 2, "n2")])


def end_distance(p, a):
    d = max(0.0, math.hypot(p[0] - a[3], p[1] - a[4]) - a[5])
    if a[6] is None:
        return d
    x1, y1, x2, y2 = a[6]
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = min(1, max(0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / n)) if n else 0
    return min(d, math.hypot(p[0] - x1 - t * (x2 - x1), p[1] - y1 - t * (y2 - y1)))


@pytest.mark.parametrize("seed", [1, 2])
def test_recovered_ties_against_plain_python(spark, seed):
    rng = random.Random(seed)
    anchors = []
    for i in range(60):
        m, x, y = rng.randint(1, 3), rng.uniform(0, 100), rng.uniform(90, 120)
        anchors.append((m, rng.randint(1, 2), f"n{i}", x, y, 4.0, (x + 4, y, x + 4, y - 30) if rng.random() < 0.5 else None, rng.choice(["C4", "D4"]), rng.randint(1, 2), f"t{i // 2}", 0.0, 0.0))
    curves = []
    for i in range(25):
        x, y = rng.uniform(0, 80), rng.uniform(90, 120)
        points = [(x, y), (x + 10, y + rng.choice([-5, 5])), (x + rng.uniform(5, 30), y + rng.uniform(-3, 3))]
        curves += [(m, s, f"c{i:02}", 10.0, points) for m in range(1, rng.randint(2, 4)) for s in {rng.randint(1, 2)}]
    claimed, ties = ["c03", "c07"], [(anchors[0][0], "n0", anchors[5][0], "n5")]
    expected = []
    for c in sorted({x[2] for x in curves} - set(claimed)):
        own = [x for x in curves if x[2] == c]
        points = min(own)[4]
        left, right = (points[0], points[-1]) if points[0][0] <= points[-1][0] else (points[-1], points[0])
        if (right[0] - left[0]) / 10 < 1.2:
            continue
        near = lambda p: sorted((d, a[0], a[3], a[4], a) for a in anchors if a[0] in {x[0] for x in own} and (d := end_distance(p, a) / 10) <= 3.25)[:18]  # noqa: B023, E731
        pairs = []
        for d, *_, a in near(left):
            for e, *_, b in near(right):
                if (a[0] < b[0] or (a[0] == b[0] and a[3] <= b[3] + 1e-6 and a[2] != b[2])) and a[1] == b[1] and a[8] == b[8] and a[7] == b[7] and a[9] != b[9]:
                    pairs.append((d + e, c, a[0], a[2], b[0], b[2]))
        expected += sorted(p for p in pairs if p[2:] not in ties)[:32]
    used, chosen = set(), set()
    for _, c, *pair in sorted(expected):
        if c not in used and tuple(pair) not in used:
            used |= {c, tuple(pair)}
            chosen.add((c, *pair))
    frames = tables(spark, curves, anchors, [(1, 0.0, 1.0, False, 1.0)], claimed, ties)
    found = cv.recover_ties(frames[0], frames[1], frames[3], frames[4]).collect()
    assert {(r["curve_id"], r["start_measure"], r["from_id"], r["end_measure"], r["to_id"]) for r in found} == chosen and chosen
    for r in found:
        assert r["other_staff"] == (r["staff"] not in {x[1] for x in curves if x[2] == r["curve_id"]})


def test_no_curves(spark):
    curves, anchors, measures, claimed, ties = tables(spark, [], [], [])
    assert cv.stitch_fragments(curves, anchors, measures)[1].count() == cv.recover_ties(curves, anchors, claimed, ties).count() == cv.recover_break_ties(curves, anchors, measures, claimed, ties).count() == 0
