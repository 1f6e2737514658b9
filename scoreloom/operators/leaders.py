"""Leader clusters of a whole corpus, with the leaders that one scan in order would find.

An item leads if no earlier leader is within the threshold. Near items share a cell or lie in cells side by side, so
items meet in a join on cells. Items are taken in runs of rising order: a run is settled by itself, its leaders take all
later items within their reach, and what is left goes on. A dense place is thus emptied by its first leader, before its
items could meet each other.

Of long vectors no few numbers tell which are near, so those meet without cells: in blocks, whose distances a matrix product
bounds; the pairs that the bound leaves are computed one coordinate after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import materialize

#: Items of the first run; a run is twice as long as the last if few of its items met.
FIRST = 1024
Distance = Callable[[Column, Column], Column]


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))))


def _meet(a: DataFrame, b: DataFrame, by: Sequence[str], distance: Distance, threshold: float) -> DataFrame:
    """(a_item, item, distance) of the pairs of a and b within the threshold, the one of a earlier. a goes to all cells
    beside its own."""
    cells = [c for c in a.columns if c.startswith("_cell")]
    wide = a.select(*by, F.col("_item").alias("a_item"), F.col("_value").alias("a_value"), *cells)
    for c in cells:
        wide = wide.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    pairs = wide.join(b, [*by, *cells]).where("a_item < _item").withColumn("distance", distance(F.col("a_value"), F.col("_value")))
    return pairs.where(F.col("distance") <= threshold).select(*by, "a_item", F.col("_item").alias("item"), "distance")


def _settle(run: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of a run's items those that lead: whoever has no undecided earlier neighbour leads, and its neighbours do not."""
    key = [*by, "_item"]
    rename = lambda df, c: df.select(*by, F.col(c).alias("_item")).distinct()
    lead, open_items = None, materialize(run.select(*key), "open")
    while not open_items.isEmpty():
        new = materialize(open_items.join(rename(edges, "item"), key, "left_anti"), "lead")
        lead = new if lead is None else lead.unionByName(new)
        taken = edges.join(new.select(*by, F.col("_item").alias("a_item")), [*by, "a_item"], "left_semi")
        gone = rename(taken, "item")
        open_items = materialize(open_items.join(new, key, "left_anti").join(gone, key, "left_anti"), "open")
        left = open_items.select(*by, F.col("_item").alias("a_item"))
        edges = materialize(edges.join(left, [*by, "a_item"], "left_semi").join(gone.withColumnRenamed("_item", "item"), [*by, "item"], "left_anti"), "edges")
    return lead if lead is not None else run.select(*key)


def leader_scan(df: DataFrame, by: Sequence[str], item: str, value: str, cells: Sequence[tuple[Column, float]], distance: Distance, threshold: float, first: int = FIRST) -> DataFrame:
    """by, item, leader, distance of every row of df with an item and a value.

    item is a number that orders a group's items and names them. cells: numbers of a row and by how much they differ at
    most where values are within the threshold. An item joins the nearest earlier leader within the threshold, of equal
    ones the first, or leads. Equal values are settled once, by their first item; rows that repeat an item are one.
    """
    names = [f"_cell{i}" for i in range(len(cells))]
    rows = df.where(F.col(item).isNotNull() & F.col(value).isNotNull()).groupBy(*by, F.col(item).alias("_item")).agg(F.min(F.struct(F.col(value).alias("v"), *(F.floor(c / width).alias(n) for (c, width), n in zip(cells, names, strict=True)))).alias("r"))
    rows = materialize(rows.select(*by, "_item", F.col("r.v").alias("_value"), *(F.col(f"r.{n}").alias(n) for n in names)), "items")
    open_items = materialize(rows.groupBy(*by, "_value", *names).agg(F.min("_item").alias("_item")), "open")
    key, leaders, size = [*by, "_item"], [], first
    while n := open_items.count():
        cut = open_items.approxQuantile("_item", [min(1.0, size / n)], 0.001)[0] if size < n else None
        run = open_items if cut is None else open_items.where(F.col("_item") <= cut)
        edges = materialize(_meet(run, run, by, distance, threshold), "edges")
        lead = materialize(run.join(_settle(run, edges, by), key, "left_semi"), "leaders")
        leaders.append(lead)
        later = open_items.where(F.col("_item") > cut) if cut is not None else open_items.limit(0)
        covered = _meet(lead, later, by, distance, threshold).select(*by, F.col("item").alias("_item")).distinct()
        size = size * 2 if edges.count() <= 8 * size else size
        open_items = materialize(later.join(covered, key, "left_anti"), "open")
    every = reduce(DataFrame.unionByName, leaders) if leaders else open_items
    near = _meet(every, rows, by, distance, threshold).groupBy(*by, F.col("item").alias("_item")).agg(F.min(F.struct("distance", "a_item")).alias("n"))
    found = rows.join(every.select(*key, F.lit(True).alias("_leads")), key, "left").join(near, key, "left")
    leader = F.when(F.col("_leads"), F.col("_item")).otherwise(F.col("n.a_item"))
    return found.select(*by, F.col("_item").alias(item), leader.alias("leader"), F.when(F.col("_leads"), 0.0).otherwise(F.col("n.distance")).alias("distance"))


# --- vectors -------------------------------------------------------------------------------------------------------

#: Items of a run of vectors, the leaders and the rows of a block, and how many rows are compared at once.
RUN, LEADERS, ROWS, STEP = 1 << 14, 1 << 10, 1 << 12, 256


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which are there) of arrays of doubles, a row each; 0 where one is null or its array is shorter."""
    arrays = column.combine_chunks()
    size = np.diff(arrays.offsets.to_numpy()) if len(arrays) else np.zeros(0, np.int64)
    given = np.arange(size.max(initial=0)) < size[:, None]
    found, flat = np.zeros(given.shape), arrays.flatten()
    found[given] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    given[given] = flat.is_valid().to_numpy(zero_copy_only=False)
    return found, given


class _Vectors:
    """Vectors and which of their numbers are there. A number that one of a pair lacks adds nothing to their distance."""

    def __init__(self, values: np.ndarray, given: np.ndarray):
        self.values, self.given = values, given

    def take(self, rows: np.ndarray) -> _Vectors:
        return _Vectors(self.values[rows], self.given[rows])

    def narrow(self, width: int) -> _Vectors:
        return _Vectors(self.values[:, :width], self.given[:, :width])

    def squares(self, other: _Vectors) -> tuple[np.ndarray, np.ndarray]:
        """(rows of self, rows of other): squared distances, and by how much they differ at most from those of `exact`.
        Both are NaN where that is not known."""
        with np.errstate(all="ignore"):
            x, y = self.values**2, other.values**2
            if self.given.all() and other.given.all():
                norms = x.sum(axis=1)[:, None] + y.sum(axis=1)
            else:
                norms = x @ other.given.T + self.given @ y.T
            return norms - 2 * (self.values @ other.values.T), 16 * (x.shape[1] + 8) * np.finfo(float).eps * (x.sum(axis=1)[:, None] + y.sum(axis=1))

    def exact(self, other: _Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the rows i of self and j of other, summed in the order of `euclidean`."""
        total = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for k in range(self.values.shape[1]):
                d = self.values[i, k] - other.values[j, k]
                total += np.where(self.given[i, k] & other.given[j, k], d * d, 0.0)
            return np.sqrt(total)


def _alike(a: _Vectors, b: _Vectors) -> tuple[_Vectors, _Vectors]:
    """Both as wide as the narrower one: what lies beyond adds nothing."""
    width = min(a.values.shape[1], b.values.shape[1])
    return a.narrow(width), b.narrow(width)


def _nearest(rows: _Vectors, leaders: _Vectors, threshold: float, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first of its nearest leaders within the threshold, -1 if there is none, and the distance. earlier (rows, leaders):
    which leaders a row may have. Leaders come in order."""
    place, distance = np.full(len(rows.values), -1), np.full(len(rows.values), np.inf)
    rows, leaders = _alike(rows, leaders)
    for lo in range(0, len(place) if len(leaders.values) else 0, STEP):
        part = _Vectors(rows.values[lo : lo + STEP], rows.given[lo : lo + STEP])
        square, error = part.squares(leaders)
        may = ~(square > threshold * threshold + error)
        if earlier is not None:
            may &= earlier[lo : lo + STEP]
        least = np.fmin.reduce(np.where(may, square + error, np.inf), axis=1)
        i, j = np.nonzero(may & ~(square - error > least[:, None]))
        d = part.exact(leaders, i, j)
        good = d <= threshold
        i, j, d = i[good], j[good], d[good]
        best = np.lexsort((j, d, i))
        best = best[np.diff(i[best], prepend=-1) != 0]
        place[lo + i[best]], distance[lo + i[best]] = j[best], d[best]
    return place, distance


def _lead(vectors: _Vectors, threshold: float) -> np.ndarray:
    """Which of the vectors, in order, lead."""
    found = np.zeros(0, np.int64)
    for lo in range(0, len(vectors.values), STEP):
        part = np.arange(lo, min(lo + STEP, len(vectors.values)))
        part = part[_nearest(vectors.take(part), vectors.take(found), threshold)[0] < 0]
        own = vectors.take(part)
        square, error = own.squares(own)
        i, j = np.nonzero(np.triu(~(square > threshold * threshold + error), 1))
        close = np.zeros((len(part), len(part)), bool)
        close[i, j] = own.exact(own, i, j) <= threshold
        gone = np.zeros(len(part), bool)
        for k in range(len(part)):
            if not gone[k]:
                gone |= close[k]
        found = np.concatenate((found, part[~gone]))
    return found


def _run_leaders(run: DataFrame, threshold: float) -> DataFrame:
    """Those rows of a run that lead; a run has about RUN rows at most, and a task has those of one group."""

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_item")
        return rows.take(pa.array(_lead(_Vectors(*_matrix(rows.column("_value"))), threshold)))

    return run.groupBy("_by").applyInArrow(settle, run.schema)


def _near_leaders(lead: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """_by, _item, distance, a_item: rows and their nearest earlier leader of each block of leaders, where one is within the
    threshold. A task has blocks of LEADERS and ROWS or so."""

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("_by").agg(F.ceil(F.count("*") / size).alias(name))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return df.join(sizes, "_by").select("_by", "_item", "_value", F.pmod(F.xxhash64("_item"), F.col(own)).alias(f"_{own}"), every.alias(f"_{other}"))

    def compare(leaders: pa.Table, part: pa.Table) -> pa.Table:
        leaders = leaders.sort_by("_item")
        items, own = part.column("_item").to_numpy(), leaders.column("_item").to_numpy()
        place, distance = _nearest(_Vectors(*_matrix(part.column("_value"))), _Vectors(*_matrix(leaders.column("_value"))), threshold, own < items[:, None])
        good = np.flatnonzero(place >= 0)
        found = part.select(["_by", "_item"]).take(pa.array(good))
        return found.append_column("distance", pa.array(distance[good])).append_column("a_item", pa.array(own[place[good]], pa.int64()))

    sizes = materialize(blocks(lead, LEADERS, "a").join(blocks(rows, ROWS, "b"), "_by"), "sizes")
    pairs = dealt(lead, "a", "b").groupBy("_by", "_a", "_b").cogroup(dealt(rows, "b", "a").groupBy("_by", "_a", "_b"))
    kind = rows.select("_by", "_item", F.lit(0.0).alias("distance"), F.col("_item").alias("a_item")).schema
    return pairs.applyInArrow(compare, kind)


def vector_leaders(df: DataFrame, by: Sequence[str], item: str, value: str, threshold: float, run: int = RUN) -> DataFrame:
    """by, item, leader, distance as leader_scan gives them with `euclidean`, of vectors (arrays of numbers) for which there are
    no cells. item is a whole number and comes back as a long; null is a group of its own.

    The next `run` items, in order, are settled at once, one task a group; their leaders take what they reach among all later
    items, block by block.
    """
    key = ["_by", "_item"]
    named = df.select(F.struct(*by).alias("_by"), F.col(item).cast("long").alias("_item"), F.col(value).cast("array<double>").alias("_value"))
    rows = materialize(named.where("_item IS NOT NULL AND _value IS NOT NULL").groupBy(*key).agg(F.min("_value").alias("_value")), "items")
    open_items, every = rows, None
    while n := open_items.count():
        cut = open_items.approxQuantile("_item", [run / n], min(0.001, run / n / 4))[0] if run < n else None
        lead = materialize(_run_leaders(open_items if cut is None else open_items.where(F.col("_item") <= cut), threshold), "leaders")
        every = lead if every is None else every.unionByName(lead)
        if cut is None:
            break
        later = open_items.where(F.col("_item") > cut)
        open_items = materialize(later.join(_near_leaders(lead, later, threshold).select(*key).distinct(), key, "left_anti"), "open")
    every = materialize(rows, "leaders") if every is None else every
    near = _near_leaders(every, rows, threshold).groupBy(*key).agg(F.min(F.struct("distance", "a_item")).alias("n"))
    found = rows.select(*key).join(every.select(*key, F.lit(True).alias("_leads")), key, "left").join(near, key, "left")
    leads = F.col("_leads").isNotNull()
    leader, distance = F.when(leads, F.col("_item")).otherwise(F.col("n.a_item")), F.when(leads, 0.0).otherwise(F.col("n.distance"))
    return found.select("_by.*", F.col("_item").alias(item), leader.alias("leader"), distance.alias("distance"))


# --- shapes --------------------------------------------------------------------------------------------------------


def describe(points: Column) -> Column:
    """struct<log_aspect, area, points>: a shape's points in its box, scaled to 1 by 1, and what the scale hides."""
    of = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    x0, y0 = of(F.array_min, "x"), of(F.array_min, "y")
    width, height = F.greatest(of(F.array_max, "x") - x0, F.lit(1e-9)), F.greatest(of(F.array_max, "y") - y0, F.lit(1e-9))
    scaled = F.transform(points, lambda p: F.struct(((p["x"] - x0) / width).alias("x"), ((p["y"] - y0) / height).alias("y")))
    crosses = lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.slice(s, 1, 1)), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    area = F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(crosses(scaled), F.lit(0.0), lambda s, v: s + v)) / 2)
    return F.when(F.size(points) > 0, F.struct(F.log(F.greatest(width / height, F.lit(1e-9))).alias("log_aspect"), area.alias("area"), scaled.alias("points")))


def descriptor_distance(a: Column, b: Column) -> Column:
    """Root mean square of the points' distances, sampled to as many as the shorter has, with a quarter of the difference of
    the logarithms of the aspects and 0.15 of that of the areas."""
    n = F.least(F.size(a["points"]), F.size(b["points"]))

    def sample(points: Column, i: Column) -> Column:
        place = F.when((n <= 1) | (F.size(points) == 1), 0.0).otherwise(i * (F.size(points) - 1) / F.greatest(n - 1, F.lit(1)).cast("double"))
        low = F.floor(place).cast("int")
        p, q = F.get(points, low), F.get(points, F.least(low + 1, F.size(points) - 1))
        return F.struct((p["x"] + (q["x"] - p["x"]) * (place - low)).alias("x"), (p["y"] + (q["y"] - p["y"]) * (place - low)).alias("y"))

    steps = F.sequence(F.lit(0), n - 1)
    square = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.pow(sample(a["points"], i)["x"] - sample(b["points"], i)["x"], 2) + F.pow(sample(a["points"], i)["y"] - sample(b["points"], i)["y"], 2))
    return F.sqrt(square / n) + 0.25 * F.abs(a["log_aspect"] - b["log_aspect"]) + 0.15 * F.abs(a["area"] - b["area"])


def shape_prototypes(shapes: DataFrame, by: Sequence[str], item: str, points: str, threshold: float = 0.035) -> DataFrame:
    """by, item, leader, distance: residual shapes (points: array<struct<x, y>>) and their prototypes, the first of each
    kind. Shapes without points have none."""
    rows = shapes.select(*by, item, describe(F.col(points)).alias("_shape"))
    cells = [(F.col("_shape.log_aspect"), threshold / 0.25), (F.col("_shape.area"), threshold / 0.15)]
    return leader_scan(rows, by, item, "_shape", cells, descriptor_distance, threshold)
