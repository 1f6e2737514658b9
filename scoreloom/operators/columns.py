"""Augmentation dots and the noteheads they lengthen.

Dots that stand above each other are matched to a column of heads as a whole: a monotone alignment by a dynamic program,
most matches first, then the best score. What is left goes dot by dot. Columns are islands of overlapping extents; a
staff's measure is a group, and only such with dots are walked through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequences
from .groupwise import Columns, each_group

_STAFF = ["score_id", "measure_no", "staff"]
#: Fixed values, in staff spacings.
GAP, SPACE_OFFSET, LINE_OFFSET, LINE_EXPECTED = (-0.15, 1.20), 0.34, (0.18, 0.78), 0.50
VERTICAL_SCALE, HORIZONTAL_SCALE, EPSILON = 0.34, 1.20, 1e-9
Match = tuple[float, float, float]  # score, vertical error, horizontal gap


def _offset(dot: dict, head: dict) -> tuple[float, float] | None:
    """(how far the dot is from where it should be, share of the room): a head on a line has its dot in a space beside it,
    one in a space at its own height."""
    off = abs(dot["y"] - head["y"]) / dot["spacing"]
    if head["step"] % 2 == 0:
        if not LINE_OFFSET[0] <= off <= LINE_OFFSET[1]:
            return None
        error = abs(off - LINE_EXPECTED)
        return error, max(0.0, 1 - error / max(LINE_EXPECTED - LINE_OFFSET[0], LINE_OFFSET[1] - LINE_EXPECTED))
    return (off, max(0.0, 1 - off / SPACE_OFFSET)) if off <= SPACE_OFFSET else None


def _gap(dot: dict, head: dict) -> float:
    return (dot["x"] - dot["radius"] - head["x"] - head["radius"]) / dot["spacing"]


def local_score(dot: dict, head: dict) -> float | None:
    """Of a dot and a head by themselves; None if the dot is not right beside the head."""
    gap, offset = _gap(dot, head), _offset(dot, head)
    if not GAP[0] <= gap <= GAP[1] or dot["x"] <= head["x"] or offset is None:
        return None
    return 0.48 * min(1.0, 1 - max(0.0, gap) / GAP[1]) + 0.52 * offset[1]


def column_match(dot: dict, head: dict) -> Match | None:
    """Inside columns that are beside each other: height decides, the gap hardly counts."""
    offset = _offset(dot, head)
    if dot["x"] <= head["x"] or offset is None:
        return None
    gap = _gap(dot, head)
    share = lambda v, scale: min(1.0, max(0.0, 1 - v / scale))
    return 0.95 * share(offset[0], VERTICAL_SCALE) + 0.05 * share(max(0.0, gap), HORIZONTAL_SCALE), offset[0], abs(gap)


def monotone_alignment(n: int, m: int, match: Callable[[int, int], Match | None]) -> tuple[tuple[int, float, float, float], list[tuple[int, int]]]:
    """The best pairs (i, j) of 0..n-1 and 0..m-1, both rising: most pairs, then the highest sum of scores, then the least
    error, then the least gap. ((pairs, score, error, gap), pairs)."""

    def better(a: tuple, b: tuple | None) -> bool:
        if b is None or a[0] != b[0]:
            return b is None or a[0] > b[0]
        for k, sign in ((1, 1), (2, -1), (3, -1)):
            if abs(a[k] - b[k]) > EPSILON:
                return (a[k] - b[k]) * sign > 0
        return False

    best: list[list[tuple | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0, 0.0, 0.0, 0.0, None)
    for i in range(n + 1):
        for j in range(m + 1):
            now = best[i][j]
            steps = [(i + 1, j, now), (i, j + 1, now)]
            if i < n and j < m and (found := match(i, j)) is not None:
                steps.append((i + 1, j + 1, (now[0] + 1, now[1] + found[0], now[2] + found[1], now[3] + found[2], (now[4], (i, j)))))
            for a, b, state in steps:
                if a <= n and b <= m and better(state, best[a][b]):
                    best[a][b] = state
    *value, chain = best[n][m]
    pairs = []
    while chain is not None:
        chain, pair = chain
        pairs.append(pair)
    return tuple(value), pairs[::-1]


def _rows(columns: Columns, side: str) -> list[dict]:
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True) if row[list(columns).index("side")] == side]


def _solve(columns: Columns) -> list[tuple]:
    dots, heads = _rows(columns, "dot"), _rows(columns, "head")
    by_column = lambda rows: {c: sorted((r for r in rows if r["island"] == c), key=lambda r: (r["y"], r["id"])) for c in sorted({r["island"] for r in rows})}
    edges = lambda rows: (min(r["x"] - r["radius"] for r in rows), max(r["x"] + r["radius"] for r in rows))
    head_columns = by_column(heads)
    found: dict[str, tuple[str, float, str]] = {}
    barred: dict[str, set[str]] = {}
    for own in by_column(dots).values():
        if len(own) < 2:
            continue
        left, right = edges(own)
        spacing = sum(d["spacing"] for d in own) / len(own)
        used: set[str] = set()
        rest = own
        while len(rest) >= 2:
            options = []
            for column in head_columns.values():
                low, high = edges(column)
                gap = (left - high) / max(spacing, 0.001)
                free = [h for h in column if h["id"] not in used]
                if len(free) < 2 or left + right <= low + high or not GAP[0] <= gap <= GAP[1]:
                    continue
                value, pairs = monotone_alignment(len(free), len(rest), lambda i, j: column_match(rest[j], free[i]))  # noqa: B023
                if value[0] >= 2:
                    options.append(((-value[0], -value[1], value[2], abs(gap), low + high), free, pairs))
            if not options:
                break
            _, free, pairs = min(options, key=lambda o: o[0])
            for i, j in pairs:
                pair = local_score(rest[j], free[i])
                found[rest[j]["id"]] = (free[i]["id"], column_match(rest[j], free[i])[0] if pair is None else pair, "column")
                used.add(free[i]["id"])
            rest = [d for d in rest if d["id"] not in found]
        for d in rest:
            barred[d["id"]] = used
    for d in dots:
        if d["id"] not in found:
            options = [(-score, _gap(d, h), h["id"]) for h in heads if h["id"] not in barred.get(d["id"], ()) and (score := local_score(d, h)) is not None]
            if options:
                score, _, head = min(options)
                found[d["id"]] = (head, -score, "single")
    key = [columns[k][0] for k in _STAFF]
    return [(*key, d["id"], *found.get(d["id"], (None, None, "no head"))) for d in dots]


def attach_dots(dots: DataFrame, heads: DataFrame) -> DataFrame:
    """score_id, measure_no, staff, dot_id, note_id, score, how ('column', 'single', 'no head') of every dot.

    dots: score_id, measure_no, staff, dot_id, x, y, radius, spacing; heads: score_id, measure_no, staff, note_id, x, y,
    radius, step (from the top line, even on lines), fill. Heads of one fill whose extents overlap are a column, dots
    likewise. A column of two dots or more takes the column of heads with most matches, then another one for what is left;
    a head of such a match takes no dot of the column's rest. Equal dots go to the smaller gap, then the smaller id.
    """
    side = lambda df, name, extra: df.select(*_STAFF, F.col(name).alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "radius")), *extra)
    d = side(dots, "dot_id", [F.lit("dot").alias("side"), F.lit("").alias("fill"), F.lit(0).alias("step"), F.greatest(F.col("spacing").cast("double"), F.lit(0.001)).alias("spacing")])
    h = side(heads, "note_id", [F.lit("head").alias("side"), F.coalesce("fill", F.lit("")).alias("fill"), F.abs("step").cast("int").alias("step"), F.lit(None).cast("double").alias("spacing")])
    rows = d.unionByName(h.join(d.select(*_STAFF).distinct(), _STAFF, "left_semi")).withColumns({"_low": F.col("x") - F.col("radius"), "_high": F.col("x") + F.col("radius")})
    rows = sequences.overlap_islands(rows, [*_STAFF, "side", "fill"], "_low", "_high", ["id"])
    rows = rows.withColumn("island", F.concat_ws("/", "side", "fill", F.lpad(F.col("island").cast("string"), 9, "0"))).drop("_low", "_high", "fill")
    kinds = dict(dots.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in _STAFF), f"dot_id {kinds['dot_id']}", f"note_id {dict(heads.dtypes)['note_id']}", "score double", "how string"])
    return each_group(rows, _STAFF, ["side", "x", "y", "id"], _solve, schema)
