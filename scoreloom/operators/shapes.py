"""Typing of vector shapes: strokes, curves, ellipses and what is left, in one pass over a table of shapes.

A shape has contours of points. The rules are tried in the order stroke, curve, ellipse; each rejection has a reason. All
shapes of an Arrow batch are judged together: sums over the points of a contour are segmented reductions, and curves are
rows of a matrix of equally spaced samples. No shape meets another, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTOURS = "array<struct<points:array<struct<x:double,y:double>>,is_closed:boolean>>"
STROKE = "struct<x1:double,y1:double,x2:double,y2:double,width:double>"
CURVE = (
    "struct<centerline:array<struct<x:double,y:double>>,widths:array<double>,bend:double,same_side:double,"
    "control_x:double,control_y:double,fit_error:double>"
)
ELLIPSE = "struct<cx:double,cy:double,major:double,minor:double,rotation:double,is_hollow:boolean,hole_ratio:double,fit_error:double>"


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the rules, all of which can be set anew."""

    elongation: float = 5.0
    fill: float = 0.55
    straight: float = 0.04
    detour: float = 1.08
    deviation: float = 0.15
    samples: int = 33
    least_bend: float = 0.025
    most_bend: float = 1.25
    same_side: float = 0.82
    thickness: float = 0.35
    curve_error: float = 0.075
    arch: float = 0.70
    ellipse_error: float = 0.18
    axis_ratio: float = 4.0
    hole_offset: float = 0.30
    hole_size: float = 0.92


class Contours:
    """Contours of many shapes: x and y of all points, first point and number of points of each contour, its shape."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, shape: np.ndarray, closed: np.ndarray):
        self.x, self.y, self.sizes, self.shape, self.closed = x, y, sizes, shape, closed
        self.first = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)

    @classmethod
    def of_column(cls, column: pa.Array) -> Contours:
        """From a column of type CONTOURS; contours without points are left out, null points are no points."""
        outer = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        points, closed = (pa.compute.struct_field(flat, i) for i in (0, 1))
        sizes = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        all_points = points.flatten()
        x, y = (pa.compute.struct_field(all_points, i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
        full = sizes > 0
        return cls(x, y, sizes[full], np.repeat(np.arange(len(column)), outer)[full], closed.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)[full])

    def take(self, which: np.ndarray, drop_last: np.ndarray | None = None) -> Contours:
        """Some contours, without the last point of those that drop_last names."""
        sizes = self.sizes[which] - (0 if drop_last is None else drop_last.astype(np.int64))
        at = np.arange(int(sizes.sum())) + np.repeat(self.first[which] - (np.cumsum(sizes) - sizes), sizes)
        return Contours(self.x[at], self.y[at], sizes, self.shape[which], self.closed[which])

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0)

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values, self.first) if len(self.first) else np.zeros(0)

    def most(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.first) if len(self.first) else np.zeros(0)

    def ends(self) -> tuple[np.ndarray, ...]:
        """x and y of the first point, x and y of the last, of each contour."""
        last = self.first + self.sizes - 1
        return self.x[self.first], self.y[self.first], self.x[last], self.y[last]

    def moments(self) -> tuple[np.ndarray, ...]:
        """Mean x, mean y and the covariances xx, xy, yy."""
        cx, cy = self.total(self.x) / self.sizes, self.total(self.y) / self.sizes
        dx, dy = self.x - cx[self.of], self.y - cy[self.of]
        return cx, cy, self.total(dx * dx) / self.sizes, self.total(dx * dy) / self.sizes, self.total(dy * dy) / self.sizes

    def area(self) -> np.ndarray:
        """Without sign, of the closed polygon through the points."""
        after = np.arange(1, len(self.x) + 1)
        after[self.first + self.sizes - 1] = self.first
        area = np.abs(self.total(self.x * self.y[after] - self.x[after] * self.y)) / 2
        return np.where(self.sizes < 3, 0.0, area)

    def lengths(self) -> np.ndarray:
        """How far each point is along its contour."""
        step = np.hypot(np.diff(self.x, prepend=0.0), np.diff(self.y, prepend=0.0))
        step[self.first] = 0.0
        along = np.cumsum(step)
        return along - along[self.first][self.of]

    def resampled(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x and y of count points at equal distances along each contour, as rows; and the contours' lengths."""
        along = self.lengths()
        last = self.first + self.sizes - 1
        whole = along[last]
        target = whole[:, None] * np.arange(count) / (count - 1)
        lift = np.cumsum(whole + 1) - (whole + 1)  # contours one after the other on one axis
        at = np.searchsorted(along + lift[self.of], target + lift[:, None], "left")
        at = np.clip(at, self.first[:, None] + 1, last[:, None])
        span = along[at] - along[at - 1]
        t = np.where(span > 1e-12, (target - along[at - 1]) / np.where(span > 1e-12, span, 1.0), 0.0)
        return self.x[at - 1] + (self.x[at] - self.x[at - 1]) * t, self.y[at - 1] + (self.y[at] - self.y[at - 1]) * t, whole

    def farthest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each contour the numbers of the two points that are farthest apart; of equal pairs the first."""
        a, b = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64)
        for n in np.unique(self.sizes):
            which = np.flatnonzero(self.sizes == n)
            if n > 512:
                for c in which:
                    own = slice(self.first[c], self.first[c] + n)
                    hull = _hull(self.x[own], self.y[own])
                    i, j = _farthest(self.x[own][hull][None], self.y[own][hull][None])
                    a[c], b[c] = sorted((hull[i[0]], hull[j[0]]))
                continue
            for part in np.array_split(which, -(-len(which) * int(n) ** 2 // (1 << 21))):
                at = self.first[part][:, None] + np.arange(n)
                a[part], b[part] = _farthest(self.x[at], self.y[at])
        return a, b


def _farthest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(x.shape[1], 1)
    best = np.argmax((x[:, i] - x[:, j]) ** 2 + (y[:, i] - y[:, j]) ** 2, axis=1)
    return i[best], j[best]


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers, rising, of points that hold both ends of the longest distance."""
    order = np.lexsort((np.arange(len(x)), y, x))
    new = np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))
    order = order[new]
    found: set[int] = set()
    for walk in (order, order[::-1]):
        chain: list[int] = []
        for p in walk.tolist():
            while len(chain) > 1 and (x[chain[-1]] - x[chain[-2]]) * (y[p] - y[chain[-2]]) < (y[chain[-1]] - y[chain[-2]]) * (x[p] - x[chain[-2]]):
                chain.pop()
            chain.append(p)
        found.update(chain)
    return np.array(sorted(found), np.int64)


def _first_reason(n: int, rules: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """The reason of the first rule that holds, '' if none does."""
    return np.select([hit for _, hit in rules], [reason for reason, _ in rules], "").astype(object) if n else np.zeros(0, object)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b > 0, b, 1.0)


def strokes_of(c: Contours, width: np.ndarray, t: Thresholds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of single contours: x1, y1, x2, y2, width as rows, whether it is a stroke, and why it is one or not."""
    n = len(c.sizes)
    sx, sy, ex, ey = c.ends()
    chord = np.hypot(ex - sx, ey - sy)
    cx, cy, xx, xy, yy = c.moments()
    spread = np.sqrt((xx - yy) ** 2 + 4 * xy * xy)
    ax, ay = xy, (xx + yy + spread) / 2 - xx
    norm = np.hypot(ax, ay)
    flat = norm <= 1e-12
    ax = np.where(flat, np.where(xx >= yy, 1.0, 0.0), _ratio(ax, norm))
    ay = np.where(flat, np.where(xx >= yy, 0.0, 1.0), _ratio(ay, norm))
    dx, dy = c.x - cx[c.of], c.y - cy[c.of]
    along, across = dx * ax[c.of] + dy * ay[c.of], dy * ax[c.of] - dx * ay[c.of]
    low, high, left, right = c.least(along), c.most(along), c.least(across), c.most(across)
    length, thick = high - low, right - left
    effective = np.maximum(thick, width)
    elongation = _ratio(length, effective)
    fill = c.area() / np.maximum(length * np.maximum(thick, 1e-9), 1e-300)
    straight = (elongation >= t.elongation) & (thick <= np.maximum(2 * width, t.straight * length))
    path = c.lengths()[c.first + c.sizes - 1] if n else np.zeros(0)
    away = np.abs((ex - sx)[c.of] * (c.y - sy[c.of]) - (ey - sy)[c.of] * (c.x - sx[c.of]))
    bent = _ratio(_ratio(c.most(away), chord), chord)
    is_open = ~c.closed
    exact = is_open & (c.sizes == 2) & (chord > 1e-9)
    reason = _first_reason(n, [
        ("too few points", c.sizes < 2),
        ("two-point open contour", exact),
        ("degenerate geometry", (length <= 1e-9) | (effective <= 1e-9)),
        ("elongation too low", c.closed & (elongation < t.elongation)),
        ("closed contour fill too low", c.closed & (fill < t.fill)),
        ("elongated filled contour", c.closed),
        ("straight open contour", straight),
        ("not a sampled polyline", c.sizes < 3),
        ("degenerate chord", chord <= 1e-9),
        ("polyline detour too large", _ratio(path, chord) > t.detour),
        ("polyline bends too far from chord", bent > t.deviation),
        ("approximately straight open polyline", is_open),
    ])
    by_axis = np.isin(reason, ["elongated filled contour", "straight open contour"])
    by_ends = np.isin(reason, ["two-point open contour", "approximately straight open polyline"])
    mid = (left + right) / 2
    point = lambda far: (cx + ax * far - ay * mid, cy + ay * far + ax * mid)
    (ax1, ay1), (ax2, ay2) = point(low), point(high)
    x1, y1, x2, y2 = np.where(by_axis, ax1, sx), np.where(by_axis, ay1, sy), np.where(by_axis, ax2, ex), np.where(by_axis, ay2, ey)
    turned = (x1 > x2) | ((np.abs(x1 - x2) < 1e-9) & (y1 > y2))
    x1, y1, x2, y2 = np.where(turned, x2, x1), np.where(turned, y2, y1), np.where(turned, x1, x2), np.where(turned, y1, y2)
    return np.stack([x1, y1, x2, y2, np.where(by_axis, effective, np.maximum(width, 1.0))], axis=1), by_axis | by_ends, reason


def _ribbons(c: Contours, t: Thresholds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Midline x and y, widths, and whether both sides have a length, of closed contours of 7 points or more: cut at the
    two points that are farthest apart, both sides sampled, and halved between."""
    a, b = c.farthest()
    n = c.sizes
    sides = []
    for start, size in ((a, b - a + 1), (b, a - b + n + 1)):
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        at = c.first.repeat(size) + (start.repeat(size) + at) % n.repeat(size)
        sides.append(Contours(c.x[at], c.y[at], size, c.shape, c.closed).resampled(t.samples))
    (xa, ya, wa), (xb, yb, wb) = sides
    xb, yb = xb[:, ::-1], yb[:, ::-1]
    return (xa + xb) / 2, (ya + yb) / 2, np.hypot(xa - xb, ya - yb), (wa > 1e-9) & (wb > 1e-9)


def curves_of(c: Contours, width: np.ndarray, t: Thresholds) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of single contours: centreline, widths, bend and fit as arrays of a row each, whether it is a curve, and why."""
    n, m = len(c.sizes), t.samples
    sx, sy, ex, ey = c.ends()
    repeated = c.closed & (np.hypot(ex - sx, ey - sy) < 1e-6)
    kept = c.take(np.arange(n), repeated)
    fit = np.where(c.closed, (c.sizes >= 8) & (kept.sizes >= 7), c.sizes >= 4)
    x, y, w = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m))
    sampled = np.zeros(n, bool)
    for which, of in ((np.flatnonzero(fit & ~c.closed), None), (np.flatnonzero(fit & c.closed), _ribbons)):
        if not len(which):
            continue
        if of is None:
            x[which], y[which], whole = c.take(which).resampled(m)
            w[which], sampled[which] = np.maximum(width[which], 1.0)[:, None], whole > 1e-9
        else:
            x[which], y[which], w[which], sampled[which] = of(kept.take(which), t)
    chord = np.hypot(x[:, -1] - x[:, 0], y[:, -1] - y[:, 0])
    d = ((x[:, -1:] - x[:, :1]) * (y - y[:, :1]) - (y[:, -1:] - y[:, :1]) * (x - x[:, :1])) / np.where(chord > 1e-12, chord, 1.0)[:, None]
    d[chord <= 1e-12] = 0.0
    height = np.abs(d)
    body = np.sort(w[:, 3:-3], axis=1)
    thick = _ratio(body[:, body.shape[1] // 2], chord)
    bend = _ratio(height[:, 1:-1].max(axis=1, initial=0.0), chord)
    peak = height.argmax(axis=1)
    side = np.where(d[np.arange(n), peak] >= 0, 1.0, -1.0)
    tells = height[:, 2:-2] > 0.005 * chord[:, None]
    same = _ratio(((d[:, 2:-2] * side[:, None] > 0) & tells).sum(axis=1), tells.sum(axis=1))
    step, slack = np.diff(height, axis=1), 0.04 * height.max(axis=1, initial=0.0)[:, None]
    rising = np.arange(m - 1) < peak[:, None]
    agree = np.where(rising, step > 0, step < 0) | (np.abs(step) <= slack)
    rise, fall = (np.where(part.any(axis=1), _ratio((agree & part).sum(axis=1), part.sum(axis=1)), 1.0) for part in (rising, ~rising))
    s = np.arange(m) / (m - 1)
    k = (2 * (1 - s) * s)[1:-1]
    base = lambda v: (1 - s) ** 2 * v[:, :1] + s**2 * v[:, -1:]
    qx, qy = (((v - base(v))[:, 1:-1] * k).sum(axis=1) / (k * k).sum() for v in (x, y))
    off = np.hypot(x - base(x) - 2 * (1 - s) * s * qx[:, None], y - base(y) - 2 * (1 - s) * s * qy[:, None])
    error = _ratio(np.sqrt((off * off).mean(axis=1)), chord)
    reason = _first_reason(n, [
        ("not a sufficiently sampled closed contour", c.closed & (c.sizes < 8)),
        ("too few contour points", c.closed & (kept.sizes < 7)),
        ("too few points", ~fit),
        ("could not resample both sides", ~sampled & c.closed),
        ("could not resample centreline", ~sampled),
        ("degenerate chord", chord <= 1e-6),
        ("too thick", c.closed & (thick > t.thickness)),
        ("bend below minimum", bend < t.least_bend),
        ("bend above maximum", bend > t.most_bend),
        ("no meaningful bend samples", ~tells.any(axis=1)),
        ("centreline changes side", same < t.same_side),
        ("bend peak too close to endpoint", (peak < 3) | (peak > m - 4)),
        ("bend profile is not a single arch", (rise < t.arch) | (fall < t.arch)),
        ("centreline not regular enough", error > t.curve_error),
    ])
    accepted = reason == ""
    reason[accepted] = np.where(c.closed, "curved stroke", "open curved centreline")[accepted]
    return {"x": x, "y": y, "widths": w, "bend": bend, "same_side": same, "control_x": qx, "control_y": qy, "fit_error": error}, accepted, reason


def ellipses_of(c: Contours, shapes: int, t: Thresholds) -> tuple[np.ndarray, np.ndarray]:
    """Per shape cx, cy, major, minor, rotation, hole ratio (NaN without a hole) and error; and whether it is one. The
    largest fitted contour must be an ellipse; a smaller ellipse well inside makes it hollow."""
    out, found = np.full((shapes, 7), np.nan), np.zeros(shapes, bool)
    c = c.take(np.flatnonzero(c.closed & (c.sizes >= 8)))
    sx, sy, ex, ey = c.ends()
    c = c.take(np.arange(len(c.sizes)), np.hypot(ex - sx, ey - sy) < 1e-7)
    if not len(c.sizes):
        return out, found
    cx, cy, xx, xy, yy = c.moments()
    angle = 0.5 * np.arctan2(2 * xy, xx - yy)
    dx, dy = c.x - cx[c.of], c.y - cy[c.of]
    turned = lambda g: (dx * np.cos(g)[c.of] + dy * np.sin(g)[c.of], dy * np.cos(g)[c.of] - dx * np.sin(g)[c.of])
    u, v = turned(angle)
    ru, rv = (c.most(u) - c.least(u)) / 2, (c.most(v) - c.least(v)) / 2
    usable = (c.sizes >= 6) & (ru > 1e-6) & (rv > 1e-6)
    swap = rv > ru
    angle = angle + np.where(swap, np.pi / 2, 0.0)
    major, minor = np.where(swap, rv, ru), np.where(swap, ru, rv)
    u, v = turned(angle)
    off = np.hypot(u / np.where(usable, major, 1.0)[c.of], v / np.where(usable, minor, 1.0)[c.of]) - 1
    error = np.sqrt(c.total(off * off) / c.sizes)
    good = usable & (error <= t.ellipse_error) & (_ratio(major, np.maximum(minor, 1e-9)) <= t.axis_ratio)
    area = np.pi * major * minor
    order = np.lexsort((np.arange(len(area)), -area, c.shape))
    order = order[usable[order]]
    lead = order[np.append(True, np.diff(c.shape[order]) != 0)] if len(order) else order
    outer = np.full(shapes, -1)
    outer[c.shape[lead]] = lead
    found[c.shape[lead]] = good[lead]
    own = outer[c.shape[order]]
    gx, gy = cx[order] - cx[own], cy[order] - cy[own]
    co, si = np.cos(angle[own]), np.sin(angle[own])
    inside = ((gx * co + gy * si) / major[own]) ** 2 + ((gy * co - gx * si) / minor[own]) ** 2 < 1
    hole = (order != own) & good[order] & inside & (np.hypot(gx, gy) / np.maximum(major[own], 1e-9) <= t.hole_offset)
    hole &= (major[order] < t.hole_size * major[own]) & (minor[order] < t.hole_size * minor[own])
    out[c.shape[lead]] = np.stack([cx[lead], cy[lead], major[lead], minor[lead], angle[lead], np.full(len(lead), np.nan), error[lead]], axis=1)
    holes = order[hole]
    first = np.append(True, np.diff(c.shape[holes]) != 0) if len(holes) else np.zeros(0, bool)
    at = c.shape[holes[first]]
    out[at, 5] = area[holes[first]] / area[outer[at]]
    return out, found


def _struct(arrays: list[pa.Array], names: list[str], there: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays(arrays, names, mask=pa.array(~there))


def _lists(rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array(np.arange(0, rows.size + 1, rows.shape[1] if rows.size else 1, dtype=np.int32)), pa.array(rows.ravel())


def _typed(thresholds: Thresholds, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 2048):
                yield _type_batch(whole.slice(start, 2048), thresholds, keys)

    return run


def _type_batch(batch: pa.RecordBatch, t: Thresholds, keys: list[str]) -> pa.RecordBatch:
    n = len(batch)
    c = Contours.of_column(batch.column("contours"))
    width = batch.column("stroke_width").fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
    per = np.bincount(c.shape, minlength=n)
    single = np.flatnonzero(per[c.shape] == 1)
    one = c.take(single)
    at = one.shape
    stroke_reason, curve_reason = np.full(n, "multiple contours", object), np.full(n, "not a single contour", object)
    line, is_line, why = strokes_of(one, width[at], t)
    stroke_reason[at] = why
    kind = np.full(n, "residual", object)
    kind[at[is_line]] = "stroke"
    lines = np.zeros((n, 5))
    lines[at] = line
    bent, is_bent, why = curves_of(one, width[at], t)
    curve_reason[at] = why
    row_of = np.zeros(n, np.int64)
    row_of[at] = np.arange(len(at))
    curved = np.zeros(n, bool)
    curved[at] = is_bent
    kind[curved & (kind == "residual")] = "curve"
    curve_reason[kind == "stroke"] = None
    oval, is_oval = ellipses_of(c, n, t)
    kind[is_oval & (kind == "residual")] = "ellipse"
    is_stroke, is_curve, is_ellipse = (kind == k for k in ("stroke", "curve", "ellipse"))
    rows = row_of[is_curve]
    lengths = np.where(is_curve, t.samples, 0)
    cuts = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(bent[v][rows].ravel()) for v in "xy"], ["x", "y"])
    spread = lambda name: pa.array(_placed(bent[name][rows], is_curve))
    curve = _struct(
        [pa.ListArray.from_arrays(cuts, points), pa.ListArray.from_arrays(cuts, pa.array(bent["widths"][rows].ravel())), *map(spread, ("bend", "same_side", "control_x", "control_y", "fit_error"))],
        ["centerline", "widths", "bend", "same_side", "control_x", "control_y", "fit_error"], is_curve,
    )
    hollow = ~np.isnan(oval[:, 5])
    ellipse = _struct(
        [*(pa.array(oval[:, i]) for i in range(5)), pa.array(hollow), pa.array(oval[:, 5], mask=~hollow), pa.array(oval[:, 6])],
        ["cx", "cy", "major", "minor", "rotation", "is_hollow", "hole_ratio", "fit_error"], is_ellipse,
    )
    stroke = _struct([pa.array(lines[:, i]) for i in range(5)], ["x1", "y1", "x2", "y2", "width"], is_stroke)
    text = lambda v: pa.array(v.tolist(), pa.string())
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), text(kind), stroke, curve, ellipse, text(stroke_reason), text(curve_reason)], [*keys, "kind", "stroke", "curve", "ellipse", "stroke_reason", "curve_reason"])


def _placed(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where))
    out[where] = values
    return out


def type_primitives(shapes: DataFrame, keys: list[str], thresholds: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Per row of shapes (keys, contours, stroke_width): keys, kind (stroke, curve, ellipse, residual), the struct of its
    kind (the others are null), stroke_reason and curve_reason.

    Contours without points do not count; a null stroke_width is 0. A shape of one contour can be a stroke or a curve, one
    of several an ellipse or residual; a shape without points is residual. Equal distances, areas and peaks go to the
    first in order. Columns other than keys are left out.
    """
    kinds = dict(shapes.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = shapes.select(*keys, F.coalesce(F.col("contours"), F.array().cast(CONTOURS)).cast(CONTOURS).alias("contours"), F.col("stroke_width").cast("double").alias("stroke_width"))
    return rows.mapInArrow(_typed(thresholds, keys), f"{schema}, kind string, stroke {STROKE}, curve {CURVE}, ellipse {ELLIPSE}, stroke_reason string, curve_reason string")


def of_kind(typed: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """The table of one kind: keys and its fields."""
    return typed.where(F.col("kind") == kind).select(*keys, f"{kind}.*") if kind != "residual" else typed.where("kind = 'residual'").select(*keys)


def reject_counts(typed: DataFrame) -> DataFrame:
    """(rule, reason, n): why shapes are no strokes, and of those why they are no curves."""
    stroke = typed.where("kind <> 'stroke'").select(F.lit("stroke").alias("rule"), F.col("stroke_reason").alias("reason"))
    curve = typed.where("kind IN ('ellipse', 'residual')").select(F.lit("curve").alias("rule"), F.col("curve_reason").alias("reason"))
    return stroke.union(curve).groupBy("rule", "reason").agg(F.count("*").alias("n"))


def bounds(contours: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y> of all points; nulls without any."""
    flat = F.flatten(F.transform(contours, lambda c: c["points"]))
    of = lambda f, axis: f(F.transform(flat, lambda p: p[axis]))
    return F.struct(of(F.array_min, "x").alias("min_x"), of(F.array_min, "y").alias("min_y"), of(F.array_max, "x").alias("max_x"), of(F.array_max, "y").alias("max_y"))


def _inside(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> bool:
    """Whether any point (x, y) is in the polygon (px, py) or on its edge."""
    if len(px) < 3:
        return False
    ax, ay, bx, by = px, py, np.roll(px, 1), np.roll(py, 1)
    x, y, eps = x[:, None], y[:, None], 1e-9
    on = np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= eps
    on &= (x + eps >= np.minimum(ax, bx)) & (x - eps <= np.maximum(ax, bx)) & (y + eps >= np.minimum(ay, by)) & (y - eps <= np.maximum(ay, by))
    crosses = (ay > y) != (by > y)
    at = np.divide((bx - ax) * (y - ay), by - ay, out=np.zeros_like(on, float), where=crosses) + ax
    return bool((on.any(axis=1) | ((crosses & (x < at)).sum(axis=1) % 2 == 1)).any())


def _components(contours: list[dict]) -> list[list[int]]:
    """Contours that belong together, by the first of each: closed ones of which one holds a point of the other."""
    points = [(np.array([p["x"] for p in c["points"]]), np.array([p["y"] for p in c["points"]])) for c in contours]
    box = np.array([(x.min(), y.min(), x.max(), y.max()) for x, y in points])
    closed = np.array([bool(c["is_closed"]) for c in contours])
    root = list(range(len(contours)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(closed).tolist():
        after = box[i + 1 :]
        near = closed[i + 1 :] & (box[i, 2] + 1e-9 >= after[:, 0]) & (after[:, 2] + 1e-9 >= box[i, 0]) & (box[i, 3] + 1e-9 >= after[:, 1]) & (after[:, 3] + 1e-9 >= box[i, 1])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if find(i) != find(j) and (_inside(*points[j], *points[i]) or _inside(*points[i], *points[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups: dict[int, list[int]] = {}
    for i in range(len(contours)):
        groups.setdefault(find(i), []).append(i)
    return [groups[k] for k in sorted(groups)]


def split_compounds(shapes: DataFrame, shape_id: str = "shape_id") -> DataFrame:
    """shapes (shape_id, contours and other columns) with each shape of separate contours as several, named id.1, id.2, …
    in the order of their first contours. Closed contours that hold each other, or through others, stay together; open
    ones stand alone. Contours of fewer than two points go where a shape is split; other shapes stay as they are. is_closed,
    if there, is that of a single contour."""
    names = shapes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, ids, kept, parts = [], [], [], []
            for i, (name, contours) in enumerate(zip(batch.column(shape_id).to_pylist(), batch.column("contours").to_pylist(), strict=True)):
                real = [c for c in contours or [] if len(c["points"] or []) >= 2]
                groups = _components(real) if len(real) > 1 else [[]]
                whole = len(groups) == 1
                for k, group in enumerate(groups):
                    take.append(i)
                    ids.append(name if whole else f"{name}.{k + 1}")
                    kept.append(contours if whole else [real[j] for j in group])
                    parts.append(None if whole else len(group) == 1 and bool(real[group[0]]["is_closed"]))
            out = batch.take(pa.array(take, pa.int64()))
            columns = {c: out.column(c) for c in names} | {shape_id: pa.array(ids, pa.string()), "contours": pa.array(kept, batch.schema.field("contours").type)}
            if "is_closed" in names:
                columns["is_closed"] = pa.array([old if new is None else new for new, old in zip(parts, out.column("is_closed").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    found = shapes.mapInArrow(run, shapes.schema)
    return found.withColumn("bounds", bounds(F.col("contours"))) if "bounds" in names else found
