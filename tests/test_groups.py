"""Order-dependent matchings and clusterings in groups against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import grouped, leaders, matching


def scan(rows, threshold, distance):
    """Leaders of (group, item, value) by one scan in order."""
    first, expected = [], {}
    for g, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        near = min(((distance(v, w), k) for k, (h, _, w) in enumerate(first) if h == g), default=(math.inf, 0))
        if near[0] > threshold:
            first.append((g, i, v))
            near = (0.0, len(first) - 1)
        expected[(g, i)] = (first[near[1]][1], round(near[0], 9))
    return expected


def test_leaders_of_small_groups(spark):
    rng = random.Random(1)
    rows = [(i % 2, i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, i long, v array<double>")
    found = {(r.g, r.i): (r.leader, round(r.distance, 9)) for r in grouped.leader_cluster(df, ["g"], "i", "v", 0.6).collect()}
    assert found == scan(rows, 0.6, math.dist)


@pytest.mark.parametrize("first", [8, 10_000])
def test_leaders_of_a_corpus_are_those_of_one_scan(spark, first):
    """Near each other across cells and signs, in a dense place whose items come last, equal ones and repeated rows."""
    rng = random.Random(4)
    rows = [(i % 2, i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(150)]
    rows += [(0, 200 + i, [3 + rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), 0.0]) for i in range(60)] + [(1, 300 + i, [0.5, 0.5, 0.5]) for i in range(5)]
    df = spark.createDataFrame([*rows, rows[7], (0, None, [0.0] * 3), (0, 999, None)], "g int, i long, v array<double>").withColumn("leader", F.lit("clash"))
    cells = [(F.element_at("v", 1), 0.6), (F.element_at("v", 2), 0.6)]
    found = {(r.g, r.i): (r.leader, round(r.distance, 9)) for r in leaders.leader_scan(df, ["g"], "i", "v", cells, leaders.euclidean, 0.6, first).collect()}
    assert found == scan(rows, 0.6, math.dist)
    assert leaders.leader_scan(df.limit(0), ["g"], "i", "v", cells, leaders.euclidean, 0.6).count() == 0


def test_prototypes_of_shapes_are_those_of_one_scan(spark):
    rng = random.Random(6)

    def describe(points):
        x, y = [p[0] for p in points], [p[1] for p in points]
        w, h = max(max(x) - min(x), 1e-9), max(max(y) - min(y), 1e-9)
        scaled = [((a - min(x)) / w, (b - min(y)) / h) for a, b in points]
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(scaled, scaled[1:] + scaled[:1], strict=True))) / 2 if len(points) > 2 else 0.0
        return w / h, area, scaled

    def distance(a, b):
        n = min(len(a[2]), len(b[2]))

        def sample(points, i):
            place = 0.0 if n <= 1 or len(points) == 1 else i * (len(points) - 1) / (n - 1)
            low = int(place)
            p, q = points[low], points[min(low + 1, len(points) - 1)]
            return p[0] + (q[0] - p[0]) * (place - low), p[1] + (q[1] - p[1]) * (place - low)

        rms = math.sqrt(sum(math.dist(sample(a[2], i), sample(b[2], i)) ** 2 for i in range(n)) / n)
        return rms + 0.25 * abs(math.log(a[0] / b[0])) + 0.15 * abs(a[1] - b[1])

    kinds = [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    shapes = [(0, i, [(x * s + rng.uniform(-0.1, 0.1), y * s + 5) for x, y in kinds[i % 12]]) for i in range(90) for s in [rng.uniform(1, 3)]]
    df = spark.createDataFrame([(g, i, [{"x": x, "y": y} for x, y in p]) for g, i, p in shapes] + [(0, 500, [])], "g int, i long, p array<struct<x:double,y:double>>")
    found = {(r.g, r.i): (r.leader, round(r.distance, 9)) for r in leaders.shape_prototypes(df, ["g"], "i", "p").collect()}
    expected = scan([(g, i, describe(p)) for g, i, p in shapes], 0.035, distance)
    assert found == expected and 12 <= len({v[0] for v in expected.values()}) < 80


def test_greedy_assignment_is_a_sorted_scan(spark):
    rng = random.Random(2)
    rows = list({(rng.randrange(12), rng.randrange(12)): rng.randrange(5) for _ in range(70)}.items())
    df = spark.createDataFrame([(a, b, c) for (a, b), c in rows], "l int, r int, cost int")
    left, right, expected = set(), set(), set()
    for c, a, b in sorted((c, a, b) for (a, b), c in rows):
        if a not in left and b not in right:
            expected.add((a, b))
            left.add(a)
            right.add(b)
    assert {(r.l, r.r) for r in matching.greedy_assignment(df, "l", "r", ["cost"]).collect()} == expected


def test_max_assignment_is_largest_and_goes_deep(spark):
    rng = random.Random(3)
    groups = {g: {(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(1, 9))} for g in range(30)}
    df = spark.createDataFrame([(g, a, b, 1) for g, pairs in groups.items() for a, b in pairs], "g int, l int, r int, cost int")
    found = {}
    for r in matching.max_assignment(df, ["g"], "l", "r", "cost").collect():
        found.setdefault(r.g, []).append((r.l, r.r))
    for g, pairs in groups.items():
        most = max(sum((a, b) in pairs for a, b in enumerate(p)) for p in itertools.permutations(range(5)))
        assert len(found[g]) == most and set(found[g]) <= pairs and len({a for a, _ in found[g]}) == len({b for _, b in found[g]}) == most
    n = 3000  # one path through all pairs
    chain = [(0, i, i, 0) for i in range(n)] + [(0, i, i + 1, 1) for i in range(n)] + [(0, n, 0, 0)]
    assert matching.max_assignment(spark.createDataFrame(chain, df.schema), ["g"], "l", "r", "cost").count() == n + 1


def test_lanes_hold_what_fits(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randrange(1, 9)) for g in range(25) for i in range(rng.randrange(1, 9))]
    found = {}
    for r in grouped.capacity_lanes(spark.createDataFrame(rows, "g int, i int, n int"), ["g"], ["i"], "n", 8).collect():
        found.setdefault(r.g, []).append((r.i, r.n, r.lane, r["at"]))
    for g in range(25):
        items = [(i, n) for h, i, n in rows if h == g]
        lanes = min(max(1, -(-sum(n for _, n in items) // 8)), 4)
        fill, last, expected = [0] * lanes, None, []
        for i, n in sorted(items, key=lambda x: (x[1] != 8, x[0])):
            open_ = [k for k in range(lanes) if fill[k] + n <= 8]
            pick = max(open_, key=lambda k: (4 * (k == last) + fill[k] / 8, -k), default=None)  # noqa: B023
            expected.append((i, n, None if pick is None else pick + 1, None if pick is None else fill[pick]))
            if pick is not None:
                fill[pick] += n
                last = pick
        assert sorted(found[g]) == sorted(expected)


def test_tiers_take_the_best_unused_partner(spark):
    rng = random.Random(5)
    side = lambda: [(g, i, rng.choice("ab"), float(rng.randrange(4)), rng.sample("wxyz", rng.randrange(1, 4))) for g in range(20) for i in range(rng.randrange(4))]
    e, a = side(), side()
    schema = "g int, id int, kind string, at double, content array<string>"
    found = {tuple(r) for r in matching.tiered_match(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema), ["g"], "kind", "at", "content").collect()}
    jaccard = lambda p, q: len(set(p) & set(q)) / len(set(p) | set(q))
    expected, used = set(), set()
    for g, i, kind, at, content in sorted(e, key=lambda x: (x[0], x[3], x[1])):
        free = [x for x in a if x[0] == g and x[2] == kind and (g, x[1]) not in used]
        here = [x for x in free if x[3] == at]
        close = [x for x in free if jaccard(content, x[4]) >= 0.72]
        if here:
            tier, pick = 1, min(here, key=lambda x: (-jaccard(content, x[4]), x[1]))
        elif close:
            tier, pick = 3, min(close, key=lambda x: (abs(x[3] - at), -jaccard(content, x[4]), x[1]))
        else:
            tier, pick = 0, None
        if pick:
            used.add((g, pick[1]))
        expected.add((g, i, pick[1] if pick else None, tier))
    expected |= {(g, None, i, 0) for g, i, *_ in a if (g, i) not in used}
    assert found == expected
