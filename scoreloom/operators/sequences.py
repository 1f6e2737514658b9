"""Operators on ordered rows: cursors, state carried forward, start/stop pairs, runs and islands.

`by` names the partition columns and `order` the columns of a total order inside a partition. Rows are never gathered
on one task beyond a partition of `by`; with scores that is a part, a voice or a measure.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def _window(by: Cols, order: Cols):
    return Window.partitionBy(*by).orderBy(*order)


def _before(by: Cols, order: Cols):
    return _window(by, order).rowsBetween(Window.unboundedPreceding, -1)


def _until(by: Cols, order: Cols):
    return _window(by, order).rowsBetween(Window.unboundedPreceding, 0)


def running_cursor(df: DataFrame, by: Cols, order: Cols, delta: Column | str, name: str = "cursor") -> DataFrame:
    """Adds where each row begins: the sum of delta over the rows before it, 0 for the first."""
    delta = F.col(delta) if isinstance(delta, str) else delta
    return df.withColumn("_delta", delta).withColumn(name, F.coalesce(F.sum("_delta").over(_before(by, order)), F.lit(0))).drop("_delta")


def carry_forward(df: DataFrame, by: Cols, order: Cols, cols: Cols, suffix: str = "") -> DataFrame:
    """Each column's last value that isn't null, up to and with the row itself."""
    over = _until(by, order)
    return df.withColumns({f"{c}{suffix}": F.last(c, ignorenulls=True).over(over) for c in cols})


def asof_state(rows: DataFrame, states: DataFrame, by: Cols, order: Cols, values: Cols) -> DataFrame:
    """rows with the values of the last state at or before them: union and carry, no range join.

    Both sides have `by` and `order`; at equal order a state comes first. Rows before any state get nulls. Of states
    that tie in order, the one with the largest values holds.
    """
    state = F.struct(*values)
    marked = states.select(*by, *order, state.alias("_state"), F.lit(0).alias("_side"))
    kind = marked.schema["_state"].dataType
    both = rows.withColumn("_state", F.lit(None).cast(kind)).withColumn("_side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    over = Window.partitionBy(*by).orderBy(*order, "_side", "_state").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_state", ignorenulls=True).over(over)).where("_side = 1")
    return found.select(*rows.columns, *(F.col("_last")[v].alias(v) for v in values))


def until_next(df: DataFrame, by: Cols, order: Cols, name: str = "until") -> DataFrame:
    """Adds the first order column of the next row, where a row's effect ends; null for the last."""
    return df.withColumn(name, F.lead(order[0]).over(_window(by, order)))


def interval_join(points: DataFrame, spans: DataFrame, by: Cols, at: str, start: str, end: str) -> DataFrame:
    """Points joined to the spans with start <= at < end on the same keys; a null end is open. Spans of one key must
    not overlap, so one as-of lookup finds the only span that can hold a point."""
    cols = [c for c in spans.columns if c not in by]
    found = asof_state(points.withColumn("_at", F.col(at)), spans.withColumn("_at", F.col(start)), by, ["_at"], cols).drop("_at")
    return found.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def pair_spans(df: DataFrame, by: Cols, order: Cols, is_start: Column, is_stop: Column, carried: Cols = ()) -> DataFrame:
    """A row for each stop whose closest earlier start or stop is a start: by, order and carried columns of both.

    The latest open start wins, a start closes at its first stop, stops without an open start are dropped.
    """
    over = _window(by, order)
    marks = df.select(*by, *order, *carried, is_start.alias("_start"), is_stop.alias("_stop")).where("_start OR _stop")
    names = [*order, *carried]
    marks = marks.withColumns({"_opens": F.lag("_start").over(over), **{f"start_{c}": F.lag(c).over(over) for c in names}})
    return marks.where("_stop AND NOT _start AND _opens").select(*by, *(f"start_{c}" for c in names), *(F.col(c).alias(f"stop_{c}") for c in names))


def group_runs(df: DataFrame, by: Cols, order: Cols, begins: Column, ends: Column, name: str = "run") -> DataFrame:
    """Numbers the rows of each run that begins and ends: all rows from a begin to the first end after it. Rows of a
    run without end, and rows outside runs, are dropped; a begin inside an open run starts it over."""
    over = _until(by, order)
    numbered = df.withColumns({"_begin": begins, "_end": ends})
    numbered = numbered.withColumn(name, F.sum(F.col("_begin").cast("int")).over(over)).where(F.col(name) > 0)
    closed = F.coalesce(F.sum(F.col("_end").cast("int")).over(_before([*by, name], order)), F.lit(0))
    inside = numbered.withColumn("_closed", closed).where("_closed = 0")
    whole = F.max(F.col("_end").cast("int")).over(Window.partitionBy(*by, name))
    return inside.withColumn("_whole", whole).where("_whole = 1").drop("_begin", "_end", "_closed", "_whole")


def gap_islands(df: DataFrame, by: Cols, order: Cols, gap: Column, name: str = "island") -> DataFrame:
    """Numbers islands from 1. gap: true where a row is cut off from the one before, as of `lag` columns."""
    over = _window(by, order)
    cut = F.when(F.row_number().over(over) == 1, 1).otherwise(F.coalesce(gap, F.lit(False)).cast("int"))
    return df.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(_until(by, order))).drop("_cut")


def previous(col: str, by: Cols, order: Cols) -> Column:
    return F.lag(col).over(_window(by, order))


def overlap_islands(df: DataFrame, by: Cols, low: str, high: str, tie: Cols = (), name: str = "island") -> DataFrame:
    """Numbers groups of intervals that overlap or touch, directly or through others."""
    order = [low, high, *tie]
    reach = F.max(high).over(_before(by, order))
    return df.withColumn("_reach", reach).withColumn("_cut", F.coalesce(F.col(low) > F.col("_reach"), F.lit(True)).cast("int")).withColumn(
        name, F.sum("_cut").over(_until(by, order))
    ).drop("_reach", "_cut")


def trim_trailing(df: DataFrame, by: Cols, order: Cols, empty: Column) -> DataFrame:
    """Without the last rows that are empty; a partition of empty rows keeps its first."""
    after = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    kept = F.max((~empty).cast("int")).over(after)
    first = F.row_number().over(_window(by, order))
    return df.withColumns({"_kept": kept, "_first": first}).where("_kept = 1 OR _first = 1").drop("_kept", "_first")


def concat_offsets(lengths: DataFrame, by: Cols, order: Cols, length: str, name: str = "offset") -> DataFrame:
    """Where each piece begins once all are put in a row: the lengths before it."""
    return lengths.withColumn(name, F.coalesce(F.sum(length).over(_before(by, order)), F.lit(0)))


def largest_gap_split(df: DataFrame, by: Cols, col: str, min_ratio: float, max_share: float) -> DataFrame:
    """Where sorted sizes break into small and large: by, small_max, large_min, n_small, n, threshold.

    The break has the largest ratio of neighbouring distinct values, at least min_ratio, with at most max_share of the
    rows below; ties go to the smaller value. threshold is the geometric mean of its edges. Values up to 0 and nulls
    don't take part; partitions without such a break have no row.
    """
    sizes = df.where(F.col(col) > 0).groupBy(*by, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_v")
    sizes = sizes.withColumns({
        "_before": F.lag("_v").over(over),
        "_below": F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)),
        "_all": F.sum("_n").over(Window.partitionBy(*by)),
    })
    fits = sizes.where((F.col("_v") >= F.col("_before") * min_ratio) & (F.col("_below") <= F.col("_all") * max_share))
    best = fits.groupBy(*by).agg(F.min(F.struct((-(F.col("_v") / F.col("_before"))).alias("r"), "_v", "_before", "_below", "_all")).alias("b"))
    return best.select(
        *by, F.col("b._before").alias("small_max"), F.col("b._v").alias("large_min"), F.col("b._below").alias("n_small"),
        F.col("b._all").alias("n"), F.sqrt(F.col("b._before") * F.col("b._v")).alias("threshold"),
    )


@dataclass(frozen=True)
class SplitRules:
    """What makes a break between small and large sizes: the least ratio at the break, the most share of small ones, the
    most ratio of the medians, the ranges of both medians, the most ratio inside the small ones and how much its logarithm
    counts, and how many large ones there must be."""

    gap: float
    share: float
    medians: float
    small: tuple[float, float] = (0.0, float("inf"))
    large: tuple[float, float] = (0.0, float("inf"))
    spread: float = float("inf")
    spread_weight: float = 0.0
    least_large: int = 1


#: Fixed values, sizes in staff spacings: dots against noteheads, and grace notes against others.
DOT_RULES = SplitRules(1.35, 0.45, 0.68, large=(0.55, 1.60))
GRACE_RULES = SplitRules(1.25, 0.25, 0.82, (0.60, 0.95), (0.90, 1.60), 1.18, 0.25, 2)


def size_split(df: DataFrame, by: Cols, item: str, size: str, rules: SplitRules) -> DataFrame:
    """by, threshold, n_small, n_large, small_median, large_median of partitions of three rows or more with a break by the
    rules: the one with the highest logarithm of its ratio, less the weighted one of the spread; then the smaller one.
    threshold is the geometric mean of its edges. Sizes up to 0 and nulls don't take part; others have no row.

    Only places with a ratio high enough look up the medians on both sides, by the numbers of their rows.
    """
    order, every = Window.partitionBy(*by).orderBy(size, item), Window.partitionBy(*by)
    rows = df.where(F.col(size) > 0).select(*by, F.col(item).alias("_item"), F.col(size).cast("double").alias("_v"), F.row_number().over(order).alias("_r"), F.count("*").over(every).alias("_n"), F.min(F.col(size).cast("double")).over(every).alias("_least"))
    sorted_ = Window.partitionBy(*by).orderBy("_r")
    cuts = rows.withColumns({"_low": F.lag("_v").over(sorted_), "_k": (F.col("_r") - 1).cast("long")})
    spread = F.col("_low") / F.greatest(F.col("_least"), F.lit(0.001))
    gap = F.col("_v") / F.greatest(F.col("_low"), F.lit(0.001))
    cuts = cuts.where((F.col("_n") >= 3) & (F.col("_k") >= 1) & (gap >= rules.gap) & (F.col("_k") / F.col("_n") <= rules.share) & (F.col("_n") - F.col("_k") >= rules.least_large) & (spread <= rules.spread))
    half = lambda base, n: F.array(base + F.floor((n + 1) / 2), base + F.floor((n + 2) / 2))
    k, rest = F.col("_k"), F.col("_n") - F.col("_k")
    score = F.log(gap) - rules.spread_weight * F.log(F.greatest(spread, F.lit(1.0)))
    cuts = cuts.select(*by, "_k", "_n", F.sqrt(F.col("_low") * F.col("_v")).alias("threshold"), score.alias("_score"), F.explode(F.array(F.struct(F.lit(0).alias("side"), half(F.lit(0), k).alias("at")), F.struct(F.lit(1).alias("side"), half(k, rest).alias("at")))).alias("m"))
    cuts = cuts.select(*by, "_k", "_n", "threshold", "_score", "m.side", F.explode("m.at").alias("_r")).withColumn("_r", F.col("_r").cast("int")).join(rows.select(*by, "_r", "_v"), [*by, "_r"])
    median = lambda side: F.avg(F.when(F.col("side") == side, F.col("_v")))
    found = cuts.groupBy(*by, "_k", "_n", "threshold", "_score").agg(median(0).alias("small_median"), median(1).alias("large_median"))
    small, large = F.col("small_median"), F.col("large_median")
    found = found.where(small.between(*rules.small) & large.between(*rules.large) & (small <= large * rules.medians))
    best = found.groupBy(*by).agg(F.min(F.struct((-F.col("_score")).alias("s"), "_k", "_n", "threshold", "small_median", "large_median")).alias("b"))
    return best.select(*by, "b.threshold", F.col("b._k").alias("n_small"), (F.col("b._n") - F.col("b._k")).alias("n_large"), "b.small_median", "b.large_median")
