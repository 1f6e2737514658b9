"""Dots against exhaustive search, onsets against plain Python."""

import itertools
import math
import random
from collections import defaultdict
from fractions import Fraction

from scoreloom.operators import columns, onsets

DOT = "score_id string, measure_no int, staff int, dot_id string, x double, y double, radius double, spacing double"
HEAD = "score_id string, measure_no int, staff int, note_id string, x double, y double, radius double, step int, fill string"
EVENT = "score_id string, measure_no int, staff int, voice int, id string, x double, duration struct<num:bigint,den:bigint>, confidence double, spacing double"


def test_alignment_equals_exhaustive_search():
    rng = random.Random(1)
    for _ in range(400):
        n, m = rng.randint(0, 5), rng.randint(0, 5)
        table = {(i, j): (round(rng.random(), 1), round(rng.random(), 1), round(rng.random(), 1)) for i in range(n) for j in range(m) if rng.random() < 0.6}
        value, pairs = columns.monotone_alignment(n, m, lambda i, j: table.get((i, j)))  # noqa: B023
        best = max(
            (len(a), round(sum(table[p][0] for p in zip(a, b, strict=True)), 9), -round(sum(table[p][1] for p in zip(a, b, strict=True)), 9), -round(sum(table[p][2] for p in zip(a, b, strict=True)), 9))
            for k in range(min(n, m) + 1) for a in itertools.combinations(range(n), k) for b in itertools.combinations(range(m), k) if all(p in table for p in zip(a, b, strict=True))
        )
        assert (value[0], round(value[1], 9), -round(value[2], 9), -round(value[3], 9)) == best
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs)) and math.isclose(sum(table[p][0] for p in pairs), value[1], abs_tol=1e-9)


def attached(spark, dots, heads):
    d = spark.createDataFrame([("s", 1, 1, i, float(x), float(y), 2.0, 10.0) for i, x, y in dots], DOT)
    h = spark.createDataFrame([("s", 1, 1, i, float(x), float(y), 5.0, step, fill) for i, x, y, step, fill in heads], HEAD)
    return {r["dot_id"]: (r["note_id"], r["how"]) for r in columns.attach_dots(d, h).collect()}


def test_dots(spark):
    heads = [("a", 100, 100, 0, "filled"), ("b", 100, 110, 2, "filled"), ("c", 100, 120, 4, "filled")]
    # Dots of heads on lines stand in the spaces above; one by one, the second could belong to either neighbour.
    assert attached(spark, [("p", 112, 95), ("q", 112, 105), ("r", 112, 115)], heads) == {"p": ("a", "column"), "q": ("b", "column"), "r": ("c", "column")}
    assert attached(spark, [("p", 112, 105)], heads) == {"p": ("a", "single")}
    assert attached(spark, [("p", 112, 300), ("q", 80, 95)], heads) == {"p": (None, "no head"), "q": (None, "no head")}
    # Two columns of heads, the second shifted; each layer takes its own dots.
    layers = [("a", 100, 100, 0, "filled"), ("b", 100, 110, 2, "filled"), ("h", 101, 135, 5, "hollow"), ("i", 101, 145, 7, "hollow")]
    found = attached(spark, [("p", 112, 95), ("q", 112, 105), ("r", 112, 135), ("s", 112, 145)], layers)
    assert found == {"p": ("a", "column"), "q": ("b", "column"), "r": ("h", "column"), "s": ("i", "column")}
    # A double dot: both go to their head by themselves.
    assert attached(spark, [("p", 109, 105), ("q", 114, 105)], [("n", 100, 105, 1, "filled")]) == {"p": ("n", "single"), "q": ("n", "single")}
    assert attached(spark, [], heads) == {} and attached(spark, [("p", 1, 1)], []) == {"p": (None, "no head")}


def plain_onsets(rows):
    """The contract for one staff's measure in fractions."""
    voices = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[5], r[4])):
        voices[r[3]].append(r)
    if len(voices) == 1:
        order = [(None, next(iter(voices.values())))]
    else:
        main = max(voices, key=lambda v: (len(voices[v]), -v))
        order = [(main, voices[main])] + [(v, voices[v]) for v in sorted(voices) if v != main]
    out, spine = {}, []
    for k, (_, own) in enumerate(order):
        if k == 0:
            now = Fraction(0)
            for r in own:
                out[r[4]] = (now, "one voice" if len(voices) == 1 else "backbone")
                spine.append((r[5], now))
                now += Fraction(*r[6])
            continue
        anchor, least = {}, 0
        for i, r in enumerate(own):
            near = sorted((abs(x - r[5]), j) for j, (x, _) in enumerate(spine) if j >= least and abs(x - r[5]) <= 7.2)
            if near:
                least = near[0][1]
                anchor[i] = spine[least][1]
        now = max(Fraction(0), anchor[min(anchor)] - sum((Fraction(*r[6]) for r in own[: min(anchor)]), Fraction(0))) if anchor else Fraction(0)
        for i, r in enumerate(own):
            how = "carried on" if anchor else "from the start"
            if i in anchor:
                how = "conflict" if anchor[i] < now else "aligned" if anchor[i] == now else "aligned after a gap"
                now = max(now, anchor[i])
            out[r[4]] = (now, how)
            now += Fraction(*r[6])
    return out


def test_onsets_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for m in range(60):
        for k in range(rng.randint(1, 12)):
            rows.append(("s", m, rng.randint(1, 2), rng.choice([1, 1, 2, 3][: rng.randint(1, 4)]), f"e{k:02}", rng.uniform(0, 80), rng.choice([(1, 4), (1, 8), (1, 6), (3, 8), (0, 1)]), rng.choice([0.3, 0.9, None]), 10.0))
    found = {(r["measure_no"], r["staff"], r["id"]): (Fraction(r["at"]["num"], r["at"]["den"]), r["how"]) for r in onsets.anchored_onsets(spark.createDataFrame(rows, EVENT)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1], r[2])].append(r)
    expected = {(*k, i): v for k, own in groups.items() for i, v in plain_onsets(own).items()}
    assert found == expected
    assert {how for _, how in expected.values()} == {"one voice", "backbone", "carried on", "from the start", "conflict", "aligned", "aligned after a gap"}


def test_a_second_voice_begins_at_its_anchor(spark):
    rows = [("s", 1, 1, 1, i, float(x), d, 0.9, 10.0) for i, x, d in (("a", 10, (1, 4)), ("b", 40, (1, 4)), ("c", 70, (1, 4)))] + [("s", 1, 1, 2, "z", 71.0, (1, 4), 0.99, 10.0)]
    found = {r["id"]: (r["at"]["num"], r["at"]["den"], r["how"], round(r["confidence"], 3)) for r in onsets.anchored_onsets(spark.createDataFrame(rows, EVENT)).collect()}
    assert found["z"] == (1, 2, "aligned", 0.955) and found["c"] == (1, 2, "backbone", 0.9)
    assert onsets.anchored_onsets(spark.createDataFrame([], EVENT)).count() == 0
