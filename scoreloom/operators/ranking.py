"""Top-k, best row, majority, medians, and issue rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key. order should be total, else ties are settled arbitrarily."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def best_by(df: DataFrame, by: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row with the largest rank of each key, as one aggregation with map-side combine; equal ranks go to the
    larger remaining columns."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max(F.struct(F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank))).alias("rank"), F.struct(*rest).alias("row"))).alias("b"))
    return best.select(*by, *(F.col("b.row")[c].alias(c) for c in rest))


def majority(df: DataFrame, by: Sequence[str], value: str, min_share: float = 0.0) -> DataFrame:
    """by, value, n, total: the most frequent value, then the smaller, if it has min_share of the key's rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    found = best.select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"), "total")
    return found.where(F.col("n") >= F.col("total") * min_share)


def upper_median(df: DataFrame, by: Sequence[str], col: str, fallback: float) -> DataFrame:
    """by, median: of the sorted positive values the one at n / 2 (rounded down, from 0); fallback without any."""
    over = Window.partitionBy(*by)
    good = F.col(col) > 0
    ranked = df.withColumn("_r", F.row_number().over(over.orderBy(F.when(good, 0).otherwise(1), col)) - 1)
    n = F.count(F.when(good, 1)).over(over)
    picked = F.max(F.when((F.col("_r") == F.floor(F.col("_n") / 2)) & good, F.col(col)))
    return ranked.withColumn("_n", n).groupBy(*by).agg(F.coalesce(picked, F.lit(fallback)).alias("median"))


def coef_variation(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """by, cv: population standard deviation over mean; null where the mean is 0."""
    mean = F.avg(col)
    return df.groupBy(*by).agg(F.when(mean != 0, F.stddev_pop(col) / mean).alias("cv"))


def agree_or_flag(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, agrees: whether all non-null values of a key are the same; the smallest one if not."""
    return df.groupBy(*by).agg(F.min(value).alias(value), (F.min(value) == F.max(value)).alias("agrees"))


def root_causes(issues: DataFrame, key: Column, category: str = "category", seq: str = "seq", summary: str = "message") -> DataFrame:
    """Issues grouped by what explains them: category, cause, n, first_seq, summary (of the first issue)."""
    grouped = issues.withColumn("cause", key).groupBy(category, "cause")
    return grouped.agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"), F.min_by(summary, seq).alias("summary"))


def breakdown(issues: DataFrame, dimensions: Sequence[str], case: str) -> DataFrame:
    """dimension, value, details, cases: rows and distinct cases of each value of each dimension, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    per_case = issues.select(F.col(case).alias("_case"), pairs.alias("p")).groupBy("p.dimension", "p.value", "_case").agg(F.count("*").alias("n"))
    return per_case.groupBy("dimension", "value").agg(F.sum("n").alias("details"), F.count("*").alias("cases"))
