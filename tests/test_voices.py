"""Voices and rests between staves: the contract's cases, and whole derived tables against plain Python."""

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from scoreloom.operators import voices
from scoreloom.plans import fact_queries

SF = "/root/testdata/sf0.001"
HEADS = "score_id string, measure_no int, staff int, shape_id string, x double, y double, confidence double"
STEMS = "score_id string, measure_no int, stem_id string, direction string, start_x double, end_x double, confidence double, head_ids array<string>"
CHORDS = "score_id string, measure_no int, chord_id string, head_ids array<string>, stem_id string, x double, confidence double"


def assigned(spark, heads=(), stems=(), chords=(), rests=()):
    note = lambda n: ("s", 1, n[3] if len(n) > 3 else 1, n[0], float(n[1]), float(n[2]), 0.98)
    frames = (
        spark.createDataFrame([note(h) for h in heads], HEADS),
        spark.createDataFrame([("s", 1, f"stem-{h[0]}", d, float(x), float(x), 0.98, list(h)) for d, x, *h in stems], STEMS),
        spark.createDataFrame([("s", 1, c, list(h), stem, float(x), 0.98) for c, stem, x, *h in chords], CHORDS),
        spark.createDataFrame([note(r) for r in rests], HEADS),
    )
    staves = spark.createDataFrame([("s", 1, 1, 10.0, 100.0), ("s", 1, 2, 10.0, 220.0)], "score_id string, measure_no int, staff int, spacing double, centre_y double")
    return {r["id"]: r for r in voices.assign_voices(voices.voice_events(*frames), staves).collect()}


def numbers(found):
    return {k: v["voice"] for k, v in found.items()}


def test_stems_alone_make_no_voices(spark):
    found = assigned(spark, [("up", 100, 95), ("down", 150, 105)], [("Up", 100, "up"), ("Down", 150, "down")])
    assert numbers(found) == {"up": 1, "down": 1} and not any(r["polyphonic"] for r in found.values())


def test_aligned_opposite_stems(spark):
    assert numbers(assigned(spark, [("a", 100, 92), ("b", 104, 108)], [("Up", 100, "a"), ("Down", 104, "b")])) == {"a": 1, "b": 2}
    assert numbers(assigned(spark, [("a", 90, 92), ("b", 110, 108)], [("Up", 100, "a"), ("Down", 100, "b")])) == {"a": 1, "b": 2}
    assert numbers(assigned(spark, [("a", 100, 212, 2), ("b", 104, 228, 2)], [("Up", 100, "a"), ("Down", 104, "b")])) == {"a": 1, "b": 2}


def test_rests(spark):
    found = assigned(spark, [("note", 100, 90)], [("Up", 100, "note")], rests=[("rest", 103, 112)])
    assert numbers(found) == {"note": 1, "rest": 2} and found["rest"]["reason"] == "beside a note of the other voice"
    assert numbers(assigned(spark, rests=[("u", 100, 92), ("l", 102, 108)])) == {"u": 1, "l": 2}
    # Three in a column: the first takes the closest partner, the third goes by the staff's centre.
    assert numbers(assigned(spark, rests=[("a", 100, 90), ("b", 101, 97), ("c", 102, 113)])) == {"a": 1, "b": 2, "c": 2}


def test_a_chord_is_one_event(spark):
    found = assigned(spark, [("c1", 100, 90), ("c2", 101, 100), ("other", 104, 112)], [("Up", 100, "c1", "c2"), ("Down", 104, "other")], [("chord", "stem-c1", 100.5, "c1", "c2")])
    assert numbers(found) == {"chord": 1, "other": 2}
    home = assigned(spark, [("a", 100, 90), ("b", 100, 210, 2), ("c", 100, 215, 2)], chords=[("k", None, 100, "a", "b", "c"), ("none", None, 5, "x")])
    assert [(k, r["staff"]) for k, r in home.items()] == [("k", 2)]


def test_heads_without_stems_follow_what_is_known(spark):
    heads = [("a", 100, 92), ("b", 104, 108), ("c", 105, 115), ("d", 150, 90), ("e", 152, 95), ("f", 153, 96)]
    found = assigned(spark, heads, [("Up", 100, "a"), ("Down", 104, "b")])
    assert numbers(found) == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2, "f": 2}
    assert [found[k]["confidence"] for k in "cde"] == [0.78, 0.45, 0.78]


def test_no_events(spark):
    assert assigned(spark) == {}


def test_derived_events_against_plain_python(spark):
    groups = defaultdict(list)
    for r in fact_queries.line_events(spark, SF).collect():
        groups[(r["score_id"], r["measure_no"], r["staff"])].append(r)

    def double(own):
        for p in own:
            for q in own:
                y = p["top"]
                if p["direction"] == "Up" and q["direction"] == "Down" and (abs(p["x"] - q["x"]) <= 7.2 or abs(p["stem_x"] - q["stem_x"]) <= 7.2):
                    return True
                if p["kind"] == "rest" and q["kind"] == "rest" and p is not q and abs(p["x"] - q["x"]) <= 6.8 and abs(y - q["top"]) >= 5.2:
                    return True
                if p["kind"] == "rest" != q["kind"] and abs(p["x"] - q["x"]) <= 5.8 and abs(y - 30) >= 5.2 and not q["top"] - 1.2 <= y <= q["bottom"] + 1.2:
                    return True
        return False

    expected = {k for k, own in groups.items() if double(own)}
    assert {tuple(r) for r in fact_queries.q_polyphony(spark, SF).collect()} == expected and expected
    found = fact_queries.q_voices(spark, SF).collect()
    assert len(found) == sum(map(len, groups.values()))
    events = {(r["measure_no"], r["staff"], r["kind"], r["id"]): r for own in groups.values() for r in own}
    for r in found:
        assert r["polyphonic"] == ((r["score_id"], r["measure_no"], r["staff"]) in expected)
        direction = events[(r["measure_no"], r["staff"], r["kind"], r["id"])]["direction"]
        assert r["voice"] == (1 if not r["polyphonic"] or direction == "Up" else 2 if direction == "Down" else r["voice"])


def test_interstaff_rests_against_plain_python(spark):
    rests, totals, pairs = fact_queries.line_rests(spark, SF)
    sums = {(r["measure_no"], r["staff"]): r["ticks"] for r in totals.collect()}
    expected, moves = {}, 0
    for r in sorted(rests.collect(), key=lambda r: (r["measure_no"], r["seq"], r["id"])):
        m, s, o = r["measure_no"], r["staff"], 3 - r["staff"]
        expected[(m, r["id"])] = s
        if not 20 < r["y"] < 40:
            continue
        off = lambda t: 0 if t <= 0 else abs(t - 50 * max(1, (t + 25) // 50))
        a, b = sums.get((m, s), 0), sums.get((m, o), 0)
        if Fraction(off(a) + off(b) - off(a - r["ticks"]) - off(b + r["ticks"]), 50) >= Fraction(12, 100):
            sums[(m, s)], sums[(m, o)] = a - r["ticks"], b + r["ticks"]
            expected[(m, r["id"])] = o
            moves += 1
    found = {(r["measure_no"], r["id"]): r["staff"] for r in fact_queries.q_interstaff_rests(spark, SF).collect()}
    assert found == expected and moves > 5


def test_a_rest_moves_where_both_staves_then_fit(spark):
    """3/4 in eighths: staff 1 has 11 of 12, staff 2 one too many."""
    rest = "score_id string, measure_no int, staff int, id string, seq int, y double, ticks long, confidence double"
    rests = spark.createDataFrame([("s", 1, 2, "r", 0, 160.0, 1, 0.99), ("s", 1, 2, "inside", 1, 210.0, 1, 0.99), ("t", 1, 2, "no pair", 0, 160.0, 1, None)], rest)
    totals = spark.createDataFrame([("s", 1, 1, 11), ("s", 1, 2, 7)], "score_id string, measure_no int, staff int, ticks long")
    pairs = spark.createDataFrame([("s", 1, 6, 120.0, 200.0)], "score_id string, measure_no int, bar long, upper_bottom double, lower_top double")
    found = {r["id"]: (r["staff"], r["confidence"], r["moved"]) for r in voices.move_interstaff_rests(rests, totals, pairs).collect()}
    assert found == {"r": (1, 0.94, 2 / 6), "inside": (2, 0.99, None), "no pair": (2, None, None)}
    assert voices.move_interstaff_rests(rests.where(F.lit(False)), totals, pairs).count() == 0
