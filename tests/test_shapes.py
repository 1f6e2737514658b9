"""Shapes from SVG and their typing, against plain Python for one shape at a time."""

import math
import random

import numpy as np
import pytest

from scoreloom.operators import shapes as sh
from scoreloom.sources import svg

SCHEMA = f"shape_id string, contours {sh.CONTOURS}, stroke_width double, kind string"


def rows(spark, shapes, widths=None):
    made = [(str(i), [{"points": [{"x": float(x), "y": float(y)} for x, y in pts], "is_closed": closed} for pts, closed in contours], (widths or {}).get(i, 0.0), "clash") for i, contours in enumerate(shapes)]
    return spark.createDataFrame(made, SCHEMA)


def dist(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


def line_off(p, a, b):
    n = dist(a, b)
    return ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / n if n > 1e-12 else 0.0


def plain_stroke(contours, width):
    contours = [c for c in contours if c[0]]
    if len(contours) != 1:
        return False
    pts, closed = contours[0]
    if len(pts) < 2:
        return False
    if not closed and len(pts) == 2 and dist(*pts) > 1e-9:
        return True
    p = np.array(pts) - np.mean(pts, axis=0)
    values, vectors = np.linalg.eigh(p.T @ p / len(p))
    along, across = np.ptp(p @ vectors[:, 1]), np.ptp(p @ vectors[:, 0])
    thick = max(across, width)
    if along <= 1e-9 or thick <= 1e-9:
        return False
    if closed:
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True))) / 2 if len(pts) > 2 else 0
        return along / thick >= 5 and area / (along * max(across, 1e-9)) >= 0.55
    if along / thick >= 5 and across <= max(2 * width, 0.04 * along):
        return True
    chord = dist(pts[0], pts[-1])
    if len(pts) < 3 or chord <= 1e-9:
        return False
    path = sum(dist(a, b) for a, b in zip(pts, pts[1:], strict=False))
    return path / chord <= 1.08 and max(abs(line_off(q, pts[0], pts[-1])) for q in pts) / chord <= 0.15


def resample(pts, n=33):
    cum = [0.0]
    for a, b in zip(pts, pts[1:], strict=False):
        cum.append(cum[-1] + dist(a, b))
    if cum[-1] <= 1e-9:
        return None
    return [(float(np.interp(cum[-1] * k / (n - 1), cum, [p[0] for p in pts])), float(np.interp(cum[-1] * k / (n - 1), cum, [p[1] for p in pts]))) for k in range(n)]


def plain_curve(contours):
    contours = [c for c in contours if c[0]]
    if len(contours) != 1:
        return None
    pts, closed = contours[0]
    width = None
    if closed:
        if len(pts) < 8:
            return None
        pts = pts[:-1] if dist(pts[0], pts[-1]) < 1e-6 else pts
        if len(pts) < 7:
            return None
        best, pair = -1, None
        for i in range(len(pts)):
            for j in range(i + 1, len(pts)):
                if (d := (pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) > best:
                    best, pair = d, (i, j)
        i, j = pair
        a, b = resample(pts[i : j + 1]), resample((pts[j:] + pts[: i + 1])[::-1])
        if a is None or b is None:
            return None
        line = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in zip(a, b, strict=True)]
        width = sorted(dist(p, q) for p, q in list(zip(a, b, strict=True))[3:-3])[13]
    else:
        line = resample(pts) if len(pts) >= 4 else None
        if line is None:
            return None
    chord = dist(line[0], line[-1])
    if chord <= 1e-6 or (width is not None and width / chord > 0.35):
        return None
    d = [line_off(p, line[0], line[-1]) for p in line]
    h = [abs(v) for v in d]
    bend = max(h[1:-1]) / chord
    if not 0.025 <= bend <= 1.25:
        return None
    sign = 1 if d[h.index(max(h))] >= 0 else -1
    tells = [v for v in d[2:-2] if abs(v) > chord * 0.005]
    if not tells or sum(v * sign > 0 for v in tells) / len(tells) < 0.82:
        return None
    peak = h.index(max(h))
    if peak < 3 or peak > 29:
        return None
    good = lambda lo, hi, up: [abs(h[k] - h[k - 1]) <= 0.04 * max(h) or (h[k] > h[k - 1]) == up and h[k] != h[k - 1] for k in range(lo + 1, hi + 1)]
    if min(np.mean(good(0, peak, True)), np.mean(good(peak, 32, False))) < 0.70:
        return None
    t = np.arange(33) / 32
    p = np.array(line)
    base = np.outer((1 - t) ** 2, p[0]) + np.outer(t**2, p[-1])
    k = (2 * (1 - t) * t)[1:-1]
    control = (k[:, None] * (p - base)[1:-1]).sum(axis=0) / (k * k).sum()
    off = p - base - np.outer(2 * (1 - t) * t, control)
    return bend if math.sqrt((off**2).sum(axis=1).mean()) / chord <= 0.075 else None


def plain_fit(pts):
    pts = pts[:-1] if len(pts) > 1 and dist(pts[0], pts[-1]) < 1e-7 else pts
    if len(pts) < 6:
        return None
    c = np.mean(pts, axis=0)
    p = np.array(pts) - c
    xx, xy, yy = (p[:, 0] ** 2).mean(), (p[:, 0] * p[:, 1]).mean(), (p[:, 1] ** 2).mean()
    g = 0.5 * math.atan2(2 * xy, xx - yy)
    r = [np.ptp(p @ [math.cos(g), math.sin(g)]) / 2, np.ptp(p @ [-math.sin(g), math.cos(g)]) / 2]
    if min(r) <= 1e-6:
        return None
    if r[1] > r[0]:
        r, g = r[::-1], g + math.pi / 2
    u, v = p @ [math.cos(g), math.sin(g)], p @ [-math.sin(g), math.cos(g)]
    return c, r[0], r[1], g, math.sqrt(((np.hypot(u / r[0], v / r[1]) - 1) ** 2).mean())


def plain_ellipse(contours):
    fits = [f for pts, closed in contours if closed and len(pts) >= 8 and (f := plain_fit(pts))]
    fits.sort(key=lambda f: -f[1] * f[2])
    good = lambda f: f[4] <= 0.18 and f[1] / f[2] <= 4
    if not fits or not good(fits[0]):
        return None
    c, major, minor, g, _ = fits[0]
    for f in fits[1:]:
        d = f[0] - c
        u, v = d @ [math.cos(g), math.sin(g)], d @ [-math.sin(g), math.cos(g)]
        if good(f) and (u / major) ** 2 + (v / minor) ** 2 < 1 and math.hypot(*d) / major <= 0.3 and f[1] < 0.92 * major and f[2] < 0.92 * minor:
            return major, True
    return major, False


def plain_kind(contours, width):
    if plain_stroke(contours, width):
        return "stroke"
    if plain_curve(contours) is not None:
        return "curve"
    return "ellipse" if plain_ellipse(contours) else "residual"


def ring(rng, n, a, b, cx=0.0, cy=0.0, turn=0.0, noise=0.0):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 1 + rng.uniform(-noise, noise, n)
    x, y = a * r * np.cos(t), b * r * np.sin(t)
    return [(float(cx + u * math.cos(turn) - v * math.sin(turn)), float(cy + u * math.sin(turn) + v * math.cos(turn))) for u, v in zip(x, y, strict=True)]


def arch(rng, n, bend, thick, noise=0.0):
    t = np.linspace(0, 1, n)
    top = [(float(100 * s), float(400 * bend * s * (1 - s) + thick * math.sin(math.pi * s) + rng.uniform(-noise, noise))) for s in t]
    low = [(float(100 * s), float(400 * bend * s * (1 - s) - thick * math.sin(math.pi * s))) for s in t[::-1]]
    return top, low


def many(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        kind = k % 8
        if kind == 0:
            out.append([(ring(rng, int(rng.integers(6, 40)), 10, rng.uniform(1, 10), turn=rng.uniform(0, 3), noise=rng.uniform(0, 0.5)), True)])
        elif kind == 1:
            top, low = arch(rng, int(rng.integers(5, 30)), rng.uniform(0, 0.5), rng.uniform(0.5, 30))
            out.append([(top + low, True)])
        elif kind == 2:
            out.append([(arch(rng, int(rng.integers(3, 40)), rng.uniform(0, 1.5), 0, noise=rng.uniform(0, 10))[0], False)])
        elif kind == 3:
            w = rng.uniform(0.1, 8)
            out.append([([(0, 0), (30, 0), (30, w), (0, w)], True)])
        elif kind == 4:
            out.append([(ring(rng, 24, 10, 8), True), (ring(rng, 16, rng.uniform(2, 12), rng.uniform(1, 9), cx=rng.uniform(0, 5)), True)])
        elif kind == 5:
            out.append([([tuple(map(float, p)) for p in rng.uniform(0, 10, (int(rng.integers(1, 12)), 2))], bool(rng.integers(2)))])
        elif kind == 6:
            out.append([([(0.0, 0.0), (float(rng.uniform(0, 50)), float(rng.uniform(0, 3)))], False)])
        else:
            x = np.cumsum(rng.uniform(0, 2, 12))
            out.append([([(float(v), float(rng.uniform(0, 0.4))) for v in x], False)])
    return out


EDGES = [[], [([], True)], [([(1.0, 1.0)], False)], [([(1.0, 1.0)] * 9, True)], [([(0.0, 0.0), (0.0, 0.0)], False)], [([(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)], False)]]


def test_kinds_against_plain_python(spark):
    shapes = many(1, 600) + EDGES
    widths = {i: float(i % 3) / 2 for i in range(len(shapes))}
    found = {r["shape_id"]: r for r in sh.type_primitives(rows(spark, shapes, widths).repartition(3), ["shape_id"]).collect()}
    kinds = [plain_kind(c, widths[i]) for i, c in enumerate(shapes)]
    assert [found[str(i)]["kind"] for i in range(len(shapes))] == kinds
    assert all(kinds.count(k) > 20 for k in ("stroke", "curve", "ellipse", "residual"))
    for i, k in enumerate(kinds):
        r = found[str(i)]
        assert [r["stroke"] is not None, r["curve"] is not None, r["ellipse"] is not None] == [k == "stroke", k == "curve", k == "ellipse"]
        if k == "curve":
            assert len(r["curve"]["centerline"]) == len(r["curve"]["widths"]) == 33
            assert math.isclose(r["curve"]["bend"], plain_curve(shapes[i]), rel_tol=1e-9)
        if k == "ellipse":
            major, hollow = plain_ellipse(shapes[i])
            assert math.isclose(r["ellipse"]["major"], major) and r["ellipse"]["is_hollow"] == hollow == (r["ellipse"]["hole_ratio"] is not None)


def test_reasons(spark):
    shapes = [[([(0, 0), (9, 0)], False)], [([(9, 2), (0, 1)], False)], [([(0, 0), (30, 0), (30, 1), (0, 1)], True)], [([(0, 0), (1, 0), (1, 1)], True)]]
    found = {r["shape_id"]: r for r in sh.type_primitives(rows(spark, shapes + EDGES[:2]), ["shape_id"]).collect()}
    assert [found[str(i)]["stroke_reason"] for i in range(6)] == ["two-point open contour", "two-point open contour", "elongated filled contour", "elongation too low", "multiple contours", "multiple contours"]
    assert tuple(found["1"]["stroke"]) == (0.0, 1.0, 9.0, 2.0, 1.0) and found["3"]["curve_reason"] == "not a sufficiently sampled closed contour"
    assert tuple(round(v, 9) for v in found["2"]["stroke"]) == (0.0, 0.5, 30.0, 0.5, 1.0)


def test_large_contours_use_the_hull():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pts = np.round(rng.normal(0, 10, (700, 2)), 1)
        c = sh.Contours(pts[:, 0], pts[:, 1], np.array([700]), np.array([0]), np.array([True]))
        i, j = c.farthest()
        a, b = sh._farthest(pts[None, :, 0], pts[None, :, 1])
        assert (pts[i[0]] - pts[j[0]]) @ (pts[i[0]] - pts[j[0]]) == (pts[a[0]] - pts[b[0]]) @ (pts[a[0]] - pts[b[0]])


def test_tables_of_kinds_and_counts(spark):
    typed = sh.type_primitives(rows(spark, many(2, 80)), ["shape_id"])
    n = {k: sh.of_kind(typed, k, ["shape_id"]).count() for k in ("stroke", "curve", "ellipse", "residual")}
    assert sum(n.values()) == 80 and sh.of_kind(typed, "ellipse", ["shape_id"]).columns[:3] == ["shape_id", "cx", "cy"]
    counts = {(r["rule"], r["reason"]): r["n"] for r in sh.reject_counts(typed).collect()}
    assert sum(v for (rule, _), v in counts.items() if rule == "stroke") == 80 - n["stroke"]
    assert sh.type_primitives(rows(spark, []), ["shape_id"]).count() == 0


HEAD = "M 1.0 3.9 C 1.0 1.6 3.2 0.2 5.8 0.2 C 8.2 0.2 9.8 1.5 9.8 3.3 C 9.8 5.5 7.7 6.8 5.0 6.8 C 2.5 6.8 1.0 5.6 1.0 3.9 Z"


def page(body):
    return f'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink">{body}</svg>'


def shapes_of(spark, *bodies):
    pages = spark.createDataFrame([(i, b if b is None or b.startswith("!") else page(b)) for i, b in enumerate(bodies)], "page long, svg string")
    shapes, errors = svg.svg_shapes(pages, ["page"])
    return sorted(shapes.collect(), key=lambda r: (r["page"], int(r["shape_id"][6:]))), errors.collect()


def test_a_hundred_heads_are_a_hundred_ellipses(spark):
    """25 references, 25 translated, 25 by matrix, 25 with moved points."""
    body = f'<defs><path id="h" d="{HEAD}"/></defs>'
    for i in range(100):
        x, y = 18 + i % 10 * 22, 18 + i // 10 * 18
        rng = random.Random(i)
        moved = "".join(c if not c[0].isdigit() else f"{float(c) + rng.uniform(-0.12, 0.12):.3f}" for c in __import__("re").split(r"([\d.]+)", HEAD) if c)
        body += [f'<use href="#h" x="{x}" y="{y}"/>', f'<path d="{HEAD}" transform="translate({x} {y})"/>', f'<path d="{HEAD}" transform="matrix(1 0 0 1 {x} {y})"/>', f'<path d="{moved}" transform="translate({x},{y})"/>'][i // 25]
    pages = spark.createDataFrame([("p", page(body))], "page string, svg string")
    shapes, errors = svg.svg_shapes(pages, ["page"])
    typed = sh.type_primitives(shapes, ["page", "shape_id"])
    assert {r["kind"]: r["count"] for r in typed.groupBy("kind").count().collect()} == {"ellipse": 100} and errors.count() == 0


def test_transforms_scale_points_and_stroke_widths(spark):
    found, _ = shapes_of(
        spark,
        '<path d="M 0 0 L 100 0" fill="none" stroke="black" stroke-width="10" transform="matrix(0.06, 0, 0, 0.06, 5, 7)"/>',
        '<g stroke="black" stroke-width="8" fill="none" transform="matrix(0.125, 0, 0, 0.125, 3, 4)"><path d="M 0 0 L 40 0"/></g>',
        '<g transform="translate(1 1)"><g id="g"><rect width="2" height="1" transform="translate(5)"/></g></g><use xlink:href="#g" x="10" style="Fill: none; stroke : red"/>',
    )
    ends = [[(round(p["x"], 6), round(p["y"], 6)) for p in r["contours"][0]["points"]] for r in found]
    assert ends[:2] == [[(5, 7), (11, 7)], [(3, 4), (8, 4)]] and [round(r["stroke_width"], 6) for r in found[:2]] == [0.6, 1.0]
    assert ends[2][0] == (6, 1) and ends[3][0] == (15, 0) and found[3]["source_id"] == "g" and not found[3]["has_fill"] and found[2]["has_fill"]
    assert tuple(found[2]["bounds"]) == (6.0, 1.0, 8.0, 2.0) and found[2]["is_closed"]


def test_path_grammar():
    def ends(d):
        p = svg.flatten(d)[-1][0][-1]
        return [round(p.real, 6), round(p.imag, 6)]

    assert ends("m1,1 2 2h3v-1H9V4") == [9, 4] and ends("M0 0l1 1 1 1zm5 5l1 0") == [6, 5]
    points, closed = svg.flatten("M0 0C0 1 1 2 2 2s2-1 2-2")[0]
    assert len(points) == 25 and not closed and abs(points[18] - (3.375 + 1.375j)) < 1e-9
    smooth, plain = svg.flatten("M0 0C0 1 1 2 2 2S4 1 4 0")[0][0], svg.flatten("M0 0C0 1 1 2 2 2C3 2 4 1 4 0")[0][0]
    assert smooth == plain and svg.flatten("M0 0Q1 1 2 0T4 0") == svg.flatten("M0 0Q1 1 2 0Q3 -1 4 0")
    half = svg.flatten("M1 0A1 1 0 0 1 -1 0")[0][0]
    assert len(half) == 25 and all(abs(abs(p) - 1) < 1e-9 for p in half) and half[12].imag > 0.99
    assert svg.flatten("M1 0A1 1 0 0 0 -1 0")[0][0][12].imag < -0.99 and len(svg.flatten("M1 0A2 1 30 1 1 0 1")[0][0]) > 30
    assert [c for _, c in svg.flatten("M0 0L1 0 1 1", filled=True)] == [True] and svg.flatten("M0 0L1 0 2 0", filled=True)[0][1] is False
    assert svg.flatten("M0 0M5 5") == [] and svg.flatten("") == []
    for bad in ("1 2", "M0 0A1 1 0 2 0 1 1", "M0 0L1", "M0 0X1"):
        with pytest.raises((ValueError, IndexError)):
            svg.flatten(bad)


def test_errors_keep_the_other_pages(spark):
    found, errors = shapes_of(spark, '<line x1="1" x2="2"/>', "!no xml", '<path d="M 0 0 X"/><polyline points="0 0 1 1 2"/><polygon points="0,0 1,0 1,1"/><polyline points="1"/>', '<path transform="matrix(1 2)"/>', None)
    assert [(r["page"], r["shape_id"]) for r in found] == [(0, "shape-1"), (2, "shape-1"), (2, "shape-2")]
    assert sorted(e["page"] for e in errors) == [1, 2, 3, 4] and len(found[2]["contours"][0]["points"]) == 4


def test_query_on_embeddings_against_plain_python(spark):
    from scoreloom.plans import shape_queries

    sf = "/root/testdata/sf0.001"
    made = {r["vec_id"]: [([tuple(p) for p in c["points"]], c["is_closed"]) for c in r["contours"]] for r in shape_queries.embedding_shapes(spark, sf).collect()}
    found = {r["vec_id"]: r["kind"] for r in shape_queries.q_primitives(spark, sf).collect()}
    kinds = {k: plain_kind(c, 0.5) for k, c in made.items()}
    assert found == kinds and set(kinds.values()) == {"stroke", "curve", "ellipse", "residual"}


def box(x, y, size, closed=True):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)], closed


def test_compounds_split_but_for_holes(spark):
    hub = [box(0, 0, 100), box(10, 10, 10), box(50, 50, 10), box(52, 52, 2)]
    shapes = [
        hub, [box(0, 0, 5), box(20, 0, 5), box(21, 1, 2)], [box(0, 0, 9, False), box(1, 1, 2)], [box(0, 0, 9)], [], [([(0, 0)], True), box(1, 1, 2)],
        [box(0, 0, 5), ([(1, 1)], True), box(50, 0, 5)], [box(0, 0, 10), box(10, 0, 10)], [([(0, 0), (9, 9)], False), ([(9, 0), (0, 9)], False)],
    ]
    split = sh.split_compounds(rows(spark, shapes).withColumn("is_closed", __import__("pyspark").sql.functions.lit(False)))
    found = {r["shape_id"]: (len(r["contours"]), r["is_closed"]) for r in split.collect()}
    assert found == {
        "0": (4, False), "1.1": (1, True), "1.2": (2, False), "2.1": (1, False), "2.2": (1, True), "3": (1, False), "4": (0, False), "5": (2, False), "6.1": (1, True), "6.2": (1, True),
        "7": (2, False), "8.1": (1, False), "8.2": (1, False),
    }


def test_points_in_polygons_against_plain_python():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(3, 9))
        px, py = rng.integers(0, 8, (2, n)).astype(float)
        x, y = rng.integers(0, 8, 2).astype(float)

        def plain():
            inside = False
            for i in range(n):
                ax, ay, bx, by = px[i], py[i], px[i - 1], py[i - 1]
                if abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) < 1e-9 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    return True
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    inside = not inside
            return inside

        assert sh._inside(np.array([x]), np.array([y]), px, py) == plain()
