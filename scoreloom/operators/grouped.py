"""Order-dependent operators inside small groups (a measure, a page): one grouped map each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groupwise import Columns, each_group


def leader_cluster(df: DataFrame, by: Sequence[str], item: str, vector: str, threshold: float) -> DataFrame:
    """by, item, leader, distance: items in order of id join the nearest leader within threshold (then the first), or
    lead a cluster of their own. Distance: Euclidean. Each group is one task's; leaders.leader_scan
    finds the same leaders in groups of any size."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item, kind="stable")
        vectors = np.array(rows[vector].tolist(), float)
        leaders: list[int] = []
        out = []
        for i in range(len(rows)):
            best, at = np.inf, i
            if leaders:
                d = np.linalg.norm(vectors[leaders] - vectors[i], axis=1)
                best, at = float(d.min()), leaders[int(d.argmin())]
            if best > threshold:
                leaders.append(i)
                best, at = 0.0, i
            out.append((rows[item].iloc[at], best))
        found = rows[[*by, item]].copy()
        found["leader"], found["distance"] = [o[0] for o in out], [o[1] for o in out]
        return found

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"{item} {kinds[item]}", f"leader {kinds[item]}", "distance double"])
    return df.select(*by, item, vector).groupBy(*by).applyInPandas(solve, schema)


def capacity_lanes(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, capacity: int, max_lanes: int = 4, prefer: str | None = None) -> DataFrame:
    """by, order, size, lane, at: items of overfull groups dealt to as few lanes as hold them, none over capacity.

    Lanes: ceil(total / capacity), at most max_lanes. Items that fill a lane go first, the rest in order. A lane in
    which an item fits scores 8 if preferred, 4 if it took the last item, and its fill share; the best takes the item,
    then the first. What fits nowhere has no lane. `at` is where the item begins in its lane. Groups that are not
    overfull keep lane 1.
    """

    def solve(rows: Columns) -> list[tuple]:
        sizes = rows[size]
        n = len(sizes)
        lanes = min(max(1, -(-int(sum(sizes)) // capacity)), max_lanes)
        fill, lane, at, last = [0] * lanes, [None] * n, [None] * n, None
        for i in sorted(range(n), key=lambda i: sizes[i] != capacity):
            fits = [k for k in range(lanes) if fill[k] + sizes[i] <= capacity]
            if not fits:
                continue
            wanted = None if prefer is None or rows[prefer][i] is None else int(rows[prefer][i]) - 1
            best = max(fits, key=lambda k: (8 * (k == wanted) + 4 * (k == last) + fill[k] / capacity, -k))  # noqa: B023
            lane[i], at[i], last = best + 1, fill[best], best
            fill[best] += int(sizes[i])
        return list(zip(*(rows[c] for c in [*by, *order, size]), lane, at, strict=True))

    kinds = dict(df.dtypes)
    extra = [prefer] if prefer and prefer not in order else []
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*by, *order, size]), "lane int", "at long"])
    return each_group(df.select(*by, *order, size, *extra), by, order, solve, schema)


def greedy_lines(df: DataFrame, by: Sequence[str], item: str, y: str, tolerance: float) -> DataFrame:
    """by, item, line: items in order of y join the current line while within tolerance of its running mean."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([y, item], kind="stable")
        line, mean, n, out = 0, 0.0, 0, []
        for value in rows[y]:
            if n and abs(value - mean) <= tolerance:
                mean, n = (mean * n + value) / (n + 1), n + 1
            else:
                line, mean, n = line + 1, value, 1
            out.append(line)
        rows["line"] = out
        return rows[[*by, item, "line"]]

    kinds = dict(df.dtypes)
    return df.select(*by, item, y).groupBy(*by).applyInPandas(solve, ", ".join([*(f"{c} {kinds[c]}" for c in [*by, item]), "line int"]))


def scan_staffs(lines: DataFrame, by: Sequence[str], max_uneven: float = 0.22, min_common: float = 0.72, min_ratio: float = 0.75) -> DataFrame:
    """by, staff, first_line, spacing, top, bottom, x_start, x_end: five consecutive lines (line, y, x_start, x_end)
    with even gaps, a common span and similar lengths make a staff; lines of a staff are not used again."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "line"], kind="stable").reset_index(drop=True)
        i, out = 0, []
        while i + 5 <= len(rows):
            five = rows.iloc[i : i + 5]
            gaps = np.diff(five["y"])
            spacing, lengths = gaps.mean(), (five["x_end"] - five["x_start"])
            common = five["x_end"].min() - five["x_start"].max()
            if spacing > 0 and np.abs(gaps - spacing).max() <= max_uneven * spacing and common >= min_common * lengths.max() and lengths.min() >= min_ratio * lengths.max():
                head = [five[b].iloc[0] for b in by]
                out.append((*head, len(out) + 1, int(five["line"].iloc[0]), spacing, five["y"].iloc[0], five["y"].iloc[4], five["x_start"].max(), five["x_end"].min()))
                i += 5
            else:
                i += 1
        return pd.DataFrame(out, columns=[*by, "staff", "first_line", "spacing", "top", "bottom", "x_start", "x_end"])

    kinds = dict(lines.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "staff int, first_line int, spacing double, top double, bottom double, x_start double, x_end double"])
    return lines.groupBy(*by).applyInPandas(solve, schema)


def score_prototypes(instances: DataFrame, prototype: str, features: str, score) -> DataFrame:
    """instances with label and confidence: score(list of features) -> (labels, confidences) sees each distinct
    prototype once, and the result is joined back."""
    kind = dict(instances.dtypes)[prototype]
    distinct = instances.groupBy(prototype).agg(F.any_value(features).alias(features))

    def run(batches):
        for rows in batches:
            labels, confidences = score(rows[features].tolist())
            yield pd.DataFrame({prototype: rows[prototype], "label": labels, "confidence": confidences})

    scored = distinct.mapInPandas(run, f"{prototype} {kind}, label string, confidence double")
    return instances.join(scored, prototype, "left")
